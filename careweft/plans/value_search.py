"""Find values in the contents of many tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careweft.functions.names import quote_name
from careweft.functions.predicates import contains_text, name_like


def is_numeric_pattern(pattern: str) -> bool:
    """Whether the pattern is a number once wildcards and dashes are taken out."""
    try:
        float(re.sub(r"[%_\[\]-]", "", pattern))
    except ValueError:
        return False
    return True


def searchable_columns(
    df: DataFrame,
    pattern: str,
    column_like: str = "%",
    nested: bool = False,
    floats: bool = False,
    dates: bool = False,
    booleans: bool = False,
) -> dict[str, Column]:
    """Columns a pattern is looked for in, with their text form.

    Text and binary always (binary as hex), whole and decimal numbers for a
    numeric pattern, nested values on request; floats, dates and booleans are
    left out unless asked for.
    """
    number = is_numeric_pattern(pattern)
    found = {}
    for f in df.schema.fields:
        c, kind = F.col(quote_name(f.name)), f.dataType
        if not name_like(f.name, column_like):
            continue
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            found[f.name] = c
        elif isinstance(kind, T.BinaryType):
            found[f.name] = F.concat(F.lit("0x"), F.lower(F.hex(c)))
        elif isinstance(kind, (T.IntegralType, T.DecimalType)):
            if number:
                found[f.name] = c.cast("string")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            if number and floats:
                found[f.name] = c.cast("string")
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            if nested:
                found[f.name] = F.to_json(c)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            if dates:
                found[f.name] = c.cast("string")
        elif isinstance(kind, T.BooleanType) and booleans:
            found[f.name] = c.cast("string")
    return found


def _hits(df: DataFrame, pattern: str, columns: Mapping[str, Column], extra: Sequence[Column]):
    """One row per matching (row, column).

    Columns become rows first and the test runs on those rows, so each value is tested
    once; what is taken from the row besides is computed for hits only.
    """
    pairs = [
        F.struct(
            F.lit(name).alias("column_name"),
            text.alias("column_value"),
            F.lit(df.schema[name].dataType.simpleString()).alias("column_type"),
        )
        for name, text in columns.items()
    ]
    rows = df.select(*extra, F.explode(F.array(*pairs)).alias("_hit"))
    return rows.filter(contains_text(F.col("_hit.column_value"), pattern)).select("*", "_hit.*").drop("_hit")


def _matching(tables: Mapping[str, DataFrame], pattern: str, table_like: str, options: dict):
    for name in sorted(tables):
        if name_like(name, table_like):
            columns = searchable_columns(tables[name], pattern, **options)
            if columns:
                yield name, tables[name], columns


def _stack(parts: list[DataFrame], tables: Mapping[str, DataFrame], schema: str) -> DataFrame:
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], schema)
    # In pairs: each union is analysed anew with all that is below it.
    while len(parts) > 1:
        halves = zip(parts[::2], [*parts[1::2], None])
        parts = [a if b is None else a.union(b) for a, b in halves]
    return parts[0]


def search_values(
    tables: Mapping[str, DataFrame],
    pattern: str,
    table_like: str = "%",
    column_like: str = "%",
    nested: bool = False,
    order: str | None = None,
    shown: int | None = None,
    **types: bool,
) -> DataFrame:
    """Distinct values that contain the pattern, with their number of rows.

    Each table is scanned once for all of its columns. Whole values are searched
    and told apart; `shown` cuts them for the report only, after they are counted.
    `order` is `count` (most frequent first) or `name`.
    """
    options = {"column_like": column_like, "nested": nested, **types}
    keys = ["table_name", "column_name", "column_value", "column_type"]
    parts = [
        _hits(df, pattern, columns, [F.lit(name).alias("table_name")])
        for name, df, columns in _matching(tables, pattern, table_like, options)
    ]
    hits = _stack(parts, tables, ", ".join(f"{k} string" for k in keys))
    found = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    if shown is not None:
        found = found.withColumn("column_value", F.substring("column_value", 1, shown))
    if order == "count":
        return found.orderBy(F.col("row_count").desc(), *keys[:3])
    return found.orderBy(*keys[:3]) if order == "name" else found


def search_full_rows(
    tables: Mapping[str, DataFrame],
    pattern: str,
    rows: int = 3,
    table_like: str = "%",
    column_like: str = "%",
    nested: bool = False,
    order: Mapping[str, Sequence[str]] | None = None,
    **types: bool,
) -> DataFrame:
    """Whole rows with a match, as JSON, up to `rows` per table and column.

    0 gives all of them. Rows are taken in the order of the columns named for
    the table, else of all its columns. The row limit runs before the shuffle.
    """
    options = {"column_like": column_like, "nested": nested, **types}
    parts = []
    for name, df, columns in _matching(tables, pattern, table_like, options):
        by = list((order or {}).get(name) or df.columns)
        extra = [
            F.lit(name).alias("table_found"),
            F.to_json(F.struct(*[F.col(quote_name(c)) for c in df.columns])).alias("row_json"),
            F.struct(*[F.col(quote_name(c)) for c in by]).alias("_order"),
        ]
        hits = _hits(df, pattern, columns, extra).withColumnRenamed("column_name", "column_found")
        if rows > 0:
            w = Window.partitionBy("column_found").orderBy("_order", "row_json")
            hits = hits.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= rows)
        parts.append(hits.select("table_found", "column_found", "row_json"))
    return _stack(parts, tables, "table_found string, column_found string, row_json string")
