"""Search the names, types and definitions of a catalog.

The catalog is held as inventory DataFrames. They can come from Spark's own
catalog, from a set of DataFrames, or from tables of metadata kept elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careweft.functions.names import qualified_name, quote_name
from careweft.functions.predicates import contains_text
from careweft.functions.predicates import name_like as matches
from careweft.functions.types import render_data_type, type_parts

# Columns of a hit and their types.
HIT = {
    "qualified_name": "string",
    "schema_name": "string",
    "table_name": "string",
    "view_name": "string",
    "synonym_name": "string",
    "synonym_object": "string",
    "column_name": "string",
    "data_type": "string",
    "foreign_key": "string",
    "parent_table": "string",
    "parent_column": "string",
    "row_count": "bigint",
    "size_kb": "bigint",
    "module_name": "string",
    "module_type": "string",
    "module_definition": "string",
    "created": "timestamp",
    "modified": "timestamp",
}
# Scopes and whether they are searched by default.
SCOPES = {
    "modules": False,
    "view_names": True,
    "view_columns": True,
    "view_column_types": False,
    "schema_names": False,
    "synonyms": True,
    "foreign_keys": True,
    "table_names": True,
    "table_columns": True,
    "table_column_types": False,
}


@dataclass
class Inventory:
    """Metadata tables; a scope needs only its own.

    schemas: schema_name
    tables, views: schema_name, table_name/view_name, row_count, size_kb, created, modified
    table_columns, view_columns: schema_name, table_name/view_name, column_name, data_type,
        row_count, created, modified
    modules: schema_name, module_name, module_type, module_definition, created, modified
    foreign_keys: schema_name, table_name, column_name, foreign_key, parent_table, parent_column
    synonyms: schema_name, synonym_name, synonym_object
    Columns other than names may be missing.
    """

    schemas: DataFrame | None = None
    tables: DataFrame | None = None
    views: DataFrame | None = None
    table_columns: DataFrame | None = None
    view_columns: DataFrame | None = None
    modules: DataFrame | None = None
    foreign_keys: DataFrame | None = None
    synonyms: DataFrame | None = None


def _hit_rows(df: DataFrame, name: Column) -> DataFrame:
    """Widen rows to the columns of a hit."""
    have = set(df.columns)
    return df.select(
        name.alias("qualified_name"),
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in HIT.items()
            if c != "qualified_name"
        ],
    )


def catalog_search(
    inventory: Inventory,
    pattern: str,
    scopes: Iterable[str] | None = None,
    problems: list[str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """All hits of a pattern in the chosen scopes, in one uniform table.

    Names match when they contain the pattern, ignoring case. A scope that
    cannot be searched is left out and named in `problems`; without that list
    it is an error.
    """
    chosen = set(SCOPES) if scopes is None else set(scopes)
    if scopes is None:
        chosen = {s for s, on in SCOPES.items() if on}
    unknown = chosen - set(SCOPES)
    if unknown:
        raise ValueError(f"unknown scopes: {sorted(unknown)}")

    def has(column: str) -> Column:
        return contains_text(column, pattern)

    def columns_branch(df: DataFrame, owner: str, names: bool, types: bool) -> DataFrame:
        tests = ([has("column_name")] if names else []) + ([has("data_type")] if types else [])
        hit = df.filter(reduce(lambda a, b: a | b, tests))
        return _hit_rows(hit, qualified_name("schema_name", owner, "column_name"))

    def foreign_branch(df: DataFrame) -> DataFrame:
        hit = df.filter(contains_text(F.concat_ws(".", "parent_table", "parent_column"), pattern))
        return _hit_rows(hit, qualified_name("schema_name", "parent_table", "parent_column"))

    def named(df: DataFrame, column: str) -> DataFrame:
        return _hit_rows(df.filter(has(column)), qualified_name("schema_name", column))

    branches = [
        (
            {"schema_names"}, "schemas",
            lambda d: _hit_rows(d.filter(has("schema_name")), qualified_name("schema_name")),
        ),
        ({"table_names"}, "tables", lambda d: named(d, "table_name")),
        ({"view_names"}, "views", lambda d: named(d, "view_name")),
        (
            {"synonyms"}, "synonyms",
            lambda d: _hit_rows(
                d.filter(has("synonym_name") | has("synonym_object")),
                qualified_name("schema_name", "synonym_name"),
            ),
        ),
        (
            {"table_columns", "table_column_types"}, "table_columns",
            lambda d: columns_branch(
                d, "table_name", "table_columns" in chosen, "table_column_types" in chosen
            ),
        ),
        (
            {"view_columns", "view_column_types"}, "view_columns",
            lambda d: columns_branch(
                d, "view_name", "view_columns" in chosen, "view_column_types" in chosen
            ),
        ),
        (
            {"modules"}, "modules",
            lambda d: _hit_rows(
                d.filter(has("module_name") | has("module_definition")),
                qualified_name("schema_name", "module_name"),
            ),
        ),
        ({"foreign_keys"}, "foreign_keys", foreign_branch),
    ]
    parts = []
    for wanted, source, build in branches:
        if not wanted & chosen:
            continue
        df = getattr(inventory, source)
        try:
            if df is None:
                raise ValueError(f"no inventory of {source}")
            parts.append(build(df))
        except (ValueError, AnalysisException) as error:
            if problems is None:
                raise
            problems.append(f"{source}: {error}")
    if not parts:
        raise ValueError("no scope could be searched")
    found = reduce(DataFrame.unionByName, parts)
    return found.orderBy("qualified_name") if ordered else found


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table, as one job over all of them."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in sorted(frames.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def table_sizes(listing: DataFrame, table: Column) -> DataFrame:
    """KB of the files of each table, and when they were written."""
    time = F.timestamp_millis("modification_time")
    return listing.groupBy(table.alias("table_name")).agg(
        F.ceil(F.sum("size") / 1024).alias("size_kb"),
        F.min(time).alias("created"),
        F.max(time).alias("modified"),
    )


def column_rows(spark: SparkSession, schema: str, frames: Mapping[str, DataFrame], owner: str):
    """Columns of each frame with rendered types. Schemas only: nothing is read."""
    rows = [
        (schema, name, f.name, *type_parts(f.dataType))
        for name, df in sorted(frames.items())
        for f in df.schema.fields
    ]
    parts = spark.createDataFrame(
        rows,
        f"schema_name string, {owner} string, column_name string, type string, "
        "precision int, scale int, length int",
    )
    return parts.withColumn(
        "data_type", render_data_type("type", "type", "precision", "scale", "length")
    ).drop("type", "precision", "scale", "length")


def inventory_of_frames(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    schema: str = "main",
    listing: DataFrame | None = None,
    table_of_file: Column | None = None,
    count_rows: bool = True,
) -> Inventory:
    """Inventory of a set of tables, with row counts and, from a file listing,
    sizes."""
    names = [(schema, n) for n in sorted(frames)]
    tables = spark.createDataFrame(names, "schema_name string, table_name string")
    columns = column_rows(spark, schema, frames, "table_name")
    if count_rows:
        counts = row_counts(frames)
        tables = tables.join(counts, "table_name", "left")
        columns = columns.join(counts, "table_name", "left")
    if listing is not None:
        tables = tables.join(table_sizes(listing, table_of_file), "table_name", "left")
    return Inventory(
        schemas=spark.createDataFrame([(schema,)], "schema_name string"),
        tables=tables,
        table_columns=columns,
    )


def inventory_of_catalog(
    spark: SparkSession,
    databases: Iterable[str] | None = None,
    count_rows: bool = False,
    name_like: str = "%",
) -> Inventory:
    """Inventory of the session catalog: databases, tables, views, definitions.

    `name_like` limits it to some tables and views. Only metadata comes to the
    driver. Counting rows reads the tables.
    """
    names = list(databases) if databases else [d.name for d in spark.catalog.listDatabases()]
    tables, views, modules = [], [], []
    table_frames, view_frames = {}, {}
    for db in names:
        for t in spark.catalog.listTables(db):
            if t.isTemporary or not matches(t.name, name_like):
                continue
            full = f"{quote_name(db)}.{quote_name(t.name)}"
            details = {
                r["col_name"]: r["data_type"]
                for r in spark.sql(f"DESCRIBE TABLE EXTENDED {full}").collect()
            }
            if t.tableType == "VIEW":
                views.append((db, t.name))
                modules.append((db, t.name, "VIEW", details.get("View Text")))
                view_frames[(db, t.name)] = spark.table(full)
            else:
                tables.append((db, t.name))
                table_frames[(db, t.name)] = spark.table(full)

    def stacked(frames, owner):
        by_db = {}
        for (db, name), df in frames.items():
            by_db.setdefault(db, {})[name] = df
        parts = [column_rows(spark, db, group, owner) for db, group in by_db.items()]
        if not parts:
            empty = f"schema_name string, {owner} string, column_name string, data_type string"
            return spark.createDataFrame([], empty)
        return reduce(DataFrame.unionByName, parts)

    table_rows = spark.createDataFrame(tables, "schema_name string, table_name string")
    table_columns = stacked(table_frames, "table_name")
    if count_rows and table_frames:
        counts = reduce(
            DataFrame.unionByName,
            [
                row_counts({name: df}).withColumn("schema_name", F.lit(db))
                for (db, name), df in table_frames.items()
            ],
        )
        table_rows = table_rows.join(counts, ["schema_name", "table_name"], "left")
        table_columns = table_columns.join(counts, ["schema_name", "table_name"], "left")
    return Inventory(
        schemas=spark.createDataFrame([(n,) for n in names], "schema_name string"),
        tables=table_rows,
        views=spark.createDataFrame(views, "schema_name string, view_name string"),
        table_columns=table_columns,
        view_columns=stacked(view_frames, "view_name"),
        modules=spark.createDataFrame(
            modules,
            "schema_name string, module_name string, module_type string, "
            "module_definition string",
        ),
    )
