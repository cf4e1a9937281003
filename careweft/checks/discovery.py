"""Profile, value search and catalog search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from careweft.checks.common import Registry, as_types, table
from careweft.functions.types import render_data_type
from careweft.plans.branches import search_each
from careweft.plans.catalog_search import (
    Inventory,
    catalog_search,
    inventory_of_catalog,
    inventory_of_frames,
    row_counts,
)
from careweft.plans.profile import profile_table
from careweft.plans.signatures import files_to_read, search_files, update_signatures
from careweft.plans.sketches import SCHEMA as SKETCHES, current, united_profile, update_sketches
from careweft.plans.value_search import search_full_rows, search_values
from careweft.session import staging_path
from careweft.sources.listing import list_files
from careweft.sources.tables import create_view, replace_table

REGISTRY = Registry()

TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation "
    "orders pages part region supplier"
).split()


def frames(spark, sf_dir, names=TABLES):
    return {n: table(spark, sf_dir, n) for n in names}


def _profile_sql(name: str, columns: list[tuple[str, str]], where: str = "") -> str:
    """One select per column; kind is 'whole', 'number', 'text' or 'other'."""
    parts = []
    source = f"(SELECT * FROM {name} {where})"
    for i, (c, kind) in enumerate(columns, 1):
        number = kind in ("number", "whole")
        exact = [f"CAST({f}({c}) AS VARCHAR)" if kind == "whole" else "CAST(NULL AS VARCHAR)" for f in ("min", "max")]
        lo = f"CAST(min({c}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        hi = f"CAST(max({c}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        avg = f"round(avg(CAST({c} AS DOUBLE)), 4)" if number else "CAST(NULL AS DOUBLE)"
        empty = f"nullif({c}, '') IS NULL" if kind == "text" else f"{c} IS NULL"
        groups = f"(SELECT count(*) AS n FROM {source} GROUP BY {c})"
        parts.append(
            f"""SELECT '{c}' AS column_name, {i} AS ordinal_position, count(*) AS total_count,
            count(DISTINCT {c}) AS distinct_count,
            (SELECT count(*) FROM {groups} WHERE n = 1) AS unique_count,
            count(*) FILTER (WHERE {c} IS NULL) AS null_count,
            count(*) FILTER (WHERE {empty}) AS empty_count,
            {lo} AS min_value, {hi} AS max_value, {avg} AS average,
            (SELECT max(n) FROM {groups}) AS mode_frequency,
            (SELECT min(n) FROM {groups}) AS anti_mode_frequency,
            min(length(CAST({c} AS VARCHAR))) AS min_length,
            max(length(CAST({c} AS VARCHAR))) AS max_length,
            round(avg(length(CAST({c} AS VARCHAR))), 4) AS average_length,
            {exact[0]} AS min_text, {exact[1]} AS max_text
            FROM {source}"""
        )
    return "\nUNION ALL\n".join(parts)


def _profiled(df):
    rounded = {c: F.round(c, 4) for c in ("average", "average_length")}
    profile = profile_table(df).drop("data_type").withColumns(rounded)
    return as_types(profile, min_length="long", max_length="long")


ORDER_COLUMNS = [
    ("o_orderkey", "whole"), ("o_custkey", "whole"), ("o_orderstatus", "text"),
    ("o_totalprice", "number"), ("o_orderdate", "other"), ("o_orderpriority", "text"),
]
CUSTOMER_COLUMNS = [
    ("c_custkey", "whole"), ("c_name", "text"), ("c_nationkey", "whole"),
    ("c_acctbal", "number"), ("c_mktsegment", "text"),
]
DOCUMENT_COLUMNS = [
    ("doc_id", "whole"), ("text", "text"), ("lang", "text"), ("source", "text"),
    ("n_chars", "whole"),
]


@REGISTRY.add("profile_table", _profile_sql("orders", ORDER_COLUMNS))
def profile_orders(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "orders"))


@REGISTRY.add("profile_customer", _profile_sql("customer", CUSTOMER_COLUMNS))
def profile_customer(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "customer"))


@REGISTRY.add("profile_documents", _profile_sql("documents", DOCUMENT_COLUMNS))
def profile_documents(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "documents"))


@REGISTRY.add(
    "profile_empty_table", _profile_sql("customer", CUSTOMER_COLUMNS, "WHERE c_acctbal > 1e12")
)
def profile_empty_table(spark, sf_dir):
    return _profiled(table(spark, sf_dir, "customer").filter("c_acctbal > 1e12"))


def _search_sql(columns: list[tuple[str, str, str]], like: str) -> str:
    parts = [
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
        CAST({c} AS VARCHAR) AS column_value, '{kind}' AS column_type
        FROM {t} WHERE lower(CAST({c} AS VARCHAR)) LIKE '{like}'"""
        for t, c, kind in columns
    ]
    return (
        "SELECT table_name, column_name, column_value, column_type, count(*) AS row_count FROM ("
        + "\nUNION ALL\n".join(parts)
        + ") GROUP BY ALL"
    )


SKETCHED = {"orders": ("o_orderkey", ORDER_COLUMNS), "documents": ("doc_id", DOCUMENT_COLUMNS)}


def _sketched_sql() -> str:
    """Exact values; the last two columns say that an estimate is near enough."""
    parts = []
    for t, (_, columns) in SKETCHED.items():
        for c, kind in columns:
            number = kind in ("number", "whole")
            lo, hi, avg = (f"{f}(CAST({c} AS DOUBLE))" if number else "CAST(NULL AS DOUBLE)" for f in ("min", "max", "avg"))
            empty = f"nullif({c}, '') IS NULL" if kind == "text" else f"{c} IS NULL"
            length = "19" if kind == "other" else f"length(CAST({c} AS VARCHAR))"
            parts.append(
                f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_count,
                count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE {empty}) AS empty_count,
                {lo} AS min_value, {hi} AS max_value, round({avg}, 4) AS average,
                CAST(min({length}) AS BIGINT) AS min_length, CAST(max({length}) AS BIGINT) AS max_length,
                TRUE AS distinct_within_3_percent, TRUE AS quartiles_within_2_percent FROM {t}"""
            )
    return "\nUNION ALL\n".join(parts)


@REGISTRY.add("profile_sketches", _sketched_sql())
def profile_sketches(spark, sf_dir):
    """Tables that grow in two steps, each file profiled once; estimates are held against exact counts."""
    paths, store, exact = {}, staging_path(spark, "sketches"), []
    for half in (0, 1):
        for name, (key, columns) in SKETCHED.items():
            paths.setdefault(name, staging_path(spark, name))
            rows = table(spark, sf_dir, name).select(*[c for c, _ in columns])
            rows.filter(F.pmod(F.col(key), F.lit(2)) == half).repartition(4, key).write.mode("append").parquet(paths[name])
        update_sketches(spark, paths, store)
    found = united_profile(current(spark, paths, spark.read.schema(SKETCHES).parquet(store)))
    # The estimates are a row per column.
    quartiles = {(r["table_name"], r["column_name"]): r["quantiles"] for r in found.collect()}
    for name, (_, columns) in SKETCHED.items():
        whole, near = table(spark, sf_dir, name), []
        for c, kind in columns:
            below = [F.avg((F.col(c) < q).cast("double")) for q in quartiles[name, c] or []]
            upto = [F.avg((F.col(c) <= q).cast("double")) for q in quartiles[name, c] or []]
            tests = [(a <= want + 0.02) & (b >= want - 0.02) for a, b, want in zip(below, upto, (0.25, 0.5, 0.75))]
            near.append(F.struct(F.lit(c).alias("c"), F.count_distinct(F.col(c)).alias("n"), F.forall(F.array(F.lit(True), *tests), lambda x: x).alias("ok")))
        exact.append(whole.agg(F.array(*near).alias("_x")).select(F.lit(name).alias("t"), F.inline("_x")))
    joined = found.join(F.broadcast(exact[0].union(exact[1])), (F.col("t") == F.col("table_name")) & (F.col("c") == F.col("column_name")))
    counts = ["total_count", "null_count", "empty_count"]
    return joined.select(
        "table_name", "column_name", *counts, "min_value", "max_value", F.round("average", 4).alias("average"),
        F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"),
        (F.abs(F.col("distinct_estimate") - F.col("n")) <= F.lit(0.03) * F.col("n")).alias("distinct_within_3_percent"),
        F.col("ok").alias("quartiles_within_2_percent"),
    )


LARGE_SQL = """WITH k AS (SELECT 9007199254740993 + o_orderkey AS k FROM orders)
  SELECT 'large_key' AS column_name, CAST(min(k) AS VARCHAR) AS min_text, CAST(max(k) AS VARCHAR) AS max_text FROM k
  UNION ALL
  SELECT 'amount', CAST(CAST(min(12345678901234567890.12::DECIMAL(22,2) + (o_orderkey % 7)::DECIMAL(22,2)) AS DECIMAL(22,2)) AS VARCHAR),
    CAST(CAST(max(12345678901234567890.12::DECIMAL(22,2) + (o_orderkey % 7)::DECIMAL(22,2)) AS DECIMAL(22,2)) AS VARCHAR) FROM orders"""


@REGISTRY.add("profile_large_numbers", LARGE_SQL)
def profile_large_numbers(spark, sf_dir):
    """Keys above 2**53 and 22-digit amounts keep all their digits."""
    orders = table(spark, sf_dir, "orders")
    amount = F.expr("CAST(12345678901234567890.12BD + CAST(o_orderkey % 7 AS DECIMAL(22,2)) AS DECIMAL(22,2))")
    large = orders.select((F.col("o_orderkey") + F.lit(9007199254740993)).alias("large_key"), amount.alias("amount"))
    return profile_table(large).select("column_name", "min_text", "max_text")


TEXT_COLUMNS = [
    ("region", "r_name", "string"), ("nation", "n_name", "string"),
    ("supplier", "s_name", "string"), ("customer", "c_name", "string"),
    ("customer", "c_mktsegment", "string"), ("part", "p_name", "string"),
    ("part", "p_brand", "string"), ("part", "p_type", "string"),
    ("orders", "o_orderstatus", "string"), ("orders", "o_orderpriority", "string"),
    ("lineitem", "l_returnflag", "string"), ("lineitem", "l_linestatus", "string"),
    ("events", "event_type", "string"), ("events", "props", "string"),
    ("documents", "text", "string"), ("documents", "lang", "string"),
    ("documents", "source", "string"), ("pages", "url", "string"), ("pages", "html", "string"),
    ("benchmark", "text", "string"), ("conversations", "role", "string"),
    ("conversations", "text", "string"),
]
NUMBER_COLUMNS = [
    ("region", "r_regionkey", "int"), ("nation", "n_nationkey", "int"),
    ("nation", "n_regionkey", "int"), ("supplier", "s_suppkey", "bigint"),
    ("supplier", "s_nationkey", "int"), ("customer", "c_custkey", "bigint"),
    ("customer", "c_nationkey", "int"), ("part", "p_partkey", "bigint"),
    ("part", "p_size", "int"), ("orders", "o_orderkey", "bigint"),
    ("orders", "o_custkey", "bigint"), ("lineitem", "l_orderkey", "bigint"),
    ("lineitem", "l_partkey", "bigint"), ("lineitem", "l_suppkey", "bigint"),
    ("lineitem", "l_linenumber", "int"), ("events", "event_id", "bigint"),
    ("events", "user_id", "bigint"), ("documents", "doc_id", "bigint"),
    ("documents", "n_chars", "bigint"), ("embeddings", "vec_id", "bigint"),
    ("embeddings", "label", "int"), ("pages", "page_id", "bigint"),
    ("benchmark", "item_id", "bigint"), ("labels", "doc_id", "bigint"),
    ("labels", "quality", "int"), ("labels", "toxic", "int"),
    ("conversations", "conv_id", "bigint"), ("conversations", "turn", "bigint"),
]


@REGISTRY.add("value_search", _search_sql(TEXT_COLUMNS, "%in%"))
def value_search(spark, sf_dir):
    return search_values(frames(spark, sf_dir), "IN")


@REGISTRY.add("value_search_numeric", _search_sql(TEXT_COLUMNS + NUMBER_COLUMNS, "%1_7%"))
def value_search_numeric(spark, sf_dir):
    return search_values(frames(spark, sf_dir), "1_7")


@REGISTRY.add(
    "value_search_all_texts",
    _search_sql(
        [
            ("documents", "text", "string"), ("conversations", "text", "string"),
            ("benchmark", "text", "string"), ("pages", "html", "string"),
        ],
        "%license%",
    ),
)
def value_search_all_texts(spark, sf_dir):
    whole = search_values(frames(spark, sf_dir), "license", column_like="te_t")
    return whole.unionByName(search_values(frames(spark, sf_dir), "license", column_like="html"))


@REGISTRY.add("value_search_nested")
def value_search_nested(spark, sf_dir):
    found = search_values(frames(spark, sf_dir, ["embeddings"]), "0.12", nested=True)
    return found.groupBy("table_name", "column_name", "column_type").agg(
        F.sum("row_count").alias("row_count")
    )


@REGISTRY.add(
    "value_search_nested_words",
    """SELECT 'conversations' AS table_name, 'words' AS column_name,
              'array<string>' AS column_type, count(*) AS row_count
       FROM conversations
       WHERE lower(CAST(to_json(string_split(text, ' ')) AS VARCHAR)) LIKE '%","the","%'
       HAVING count(*) > 0""",
)
def value_search_nested_words(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "role", F.split("text", " ").alias("words")
    )
    found = search_values({"conversations": turns}, '","the","', nested=True)
    return found.groupBy("table_name", "column_name", "column_type").agg(
        F.sum("row_count").alias("row_count")
    )


@REGISTRY.add(
    "value_search_full_rows",
    """WITH hits AS (
      SELECT 'customer' AS table_found, 'c_name' AS column_found, c_custkey AS id,
             c_mktsegment AS label,
             row_number() OVER (ORDER BY c_custkey) AS rn
      FROM customer WHERE lower(c_name) LIKE '%e_%'
      UNION ALL
      SELECT 'customer', 'c_mktsegment', c_custkey, c_mktsegment,
             row_number() OVER (ORDER BY c_custkey)
      FROM customer WHERE lower(c_mktsegment) LIKE '%e_%'
      UNION ALL
      SELECT 'supplier', 's_name', s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey)
      FROM supplier WHERE lower(s_name) LIKE '%e_%')
    SELECT table_found, column_found, id, label FROM hits WHERE rn <= 3""",
)
def value_search_full_rows(spark, sf_dir):
    found = search_full_rows(
        frames(spark, sf_dir, ["customer", "supplier"]),
        "e_",
        order={"customer": ["c_custkey"], "supplier": ["s_suppkey"]},
    )

    def field(*names):
        return F.coalesce(*[F.get_json_object("row_json", f"$.{n}") for n in names])

    return found.select(
        "table_found",
        "column_found",
        field("c_custkey", "s_suppkey").cast("long").alias("id"),
        field("c_mktsegment", "s_name").alias("label"),
    )


# Tables that are written as eight files by key, their text columns, and a pattern.
IN_FILES = {"documents": "doc_id", "customer": "c_custkey", "pages": "page_id", "conversations": "conv_id"}
IN_FILES_PATTERN = "license"


def _files_sql(pattern: str) -> str:
    """A file has to be read when one of its columns holds all strings of three letters of the pattern."""
    parts = []
    for t, key in IN_FILES.items():
        columns = [c for name, c, _ in TEXT_COLUMNS if name == t]
        held = [[f"bool_or(contains(lower({c}), '{pattern[i:i + 3]}'))" for i in range(len(pattern) - 2)] for c in columns]
        may_hold = " OR ".join("(" + " AND ".join(tests) + ")" for tests in held)
        holds = " OR ".join(f"bool_or(contains(lower({c}), '{pattern}'))" for c in columns)
        parts.append(
            f"""SELECT '{t}' AS table_name, count(*) AS files_there, count(*) FILTER (WHERE may_hold) AS files_read,
            count(*) FILTER (WHERE holds) AS files_with_hits
            FROM (SELECT {key} % 8, {may_hold} AS may_hold, {holds} AS holds FROM {t} GROUP BY 1)"""
        )
    return "\nUNION ALL\n".join(parts)


def _in_files(spark, sf_dir):
    """Paths of the tables as eight files each, and their signatures."""
    paths = {}
    for name, key in IN_FILES.items():
        paths[name] = staging_path(spark, name)
        rows = table(spark, sf_dir, name).withColumn("part", F.pmod(F.col(key), F.lit(8)))
        rows.repartition(8, "part").write.partitionBy("part").parquet(paths[name])
    sidecar = staging_path(spark, "signatures")
    update_signatures(spark, paths, sidecar)
    return paths, spark.read.parquet(sidecar)


@REGISTRY.add(
    "value_search_indexed",
    _search_sql([c for c in TEXT_COLUMNS if c[0] in IN_FILES], f"%{IN_FILES_PATTERN}%"),
)
def value_search_indexed(spark, sf_dir):
    paths, sidecar = _in_files(spark, sf_dir)
    return search_files(spark, paths, sidecar, IN_FILES_PATTERN)


@REGISTRY.add("value_search_files", _files_sql(IN_FILES_PATTERN))
def value_search_files(spark, sf_dir):
    """Files there, files that the signatures let be read, and files that hold a hit."""
    paths, sidecar = _in_files(spark, sf_dir)
    files = files_to_read(spark, paths, sidecar, IN_FILES_PATTERN)
    read = files.groupBy("table_name").agg(F.count(F.lit(1)).alias("files_there"), F.count_if("read").alias("files_read"))
    frames_ = {n: spark.read.parquet(p).withColumn("_file", F.col("_metadata.file_path")) for n, p in paths.items()}
    found = search_full_rows(frames_, IN_FILES_PATTERN, rows=0, column_like="%")
    found = found.filter(F.col("column_found") != "_file").groupBy("table_found").agg(
        F.count_distinct(F.get_json_object("row_json", "$._file")).alias("files_with_hits")
    )
    return read.join(found, read["table_name"] == found["table_found"], "left").select(
        "table_name", "files_there", "files_read", F.coalesce("files_with_hits", F.lit(0)).cast("long").alias("files_with_hits")
    )


@REGISTRY.add(
    "value_search_isolated",
    f"""WITH hits AS ({_search_sql(TEXT_COLUMNS, "%in%")}),
    found AS (SELECT table_name, sum(row_count) AS hits FROM hits GROUP BY 1)
    SELECT t.table_name, 'searched' AS outcome, CAST(coalesce(hits, 0) AS BIGINT) AS hits
    FROM (SELECT unnest({TABLES!r}) AS table_name) t LEFT JOIN found USING (table_name)
    UNION ALL SELECT 'unreadable', 'failed', 0""",
)
def value_search_isolated(spark, sf_dir):
    """All tables and one more whose file is no table: a problem of its own, found while it is read."""
    broken = staging_path(spark, "unreadable")
    table(spark, sf_dir, "region").select("r_name").write.text(broken)
    tables = {name: lambda name=name: table(spark, sf_dir, name) for name in TABLES}
    tables["unreadable"] = lambda: spark.read.schema("r_name string").parquet(broken)
    hits, problems = search_each(spark, tables, "IN")
    names = spark.createDataFrame([(n,) for n in tables], "table_name string")
    counted = hits.groupBy("table_name").agg(F.sum("row_count").alias("hits"))
    failed = problems.select(F.col("branch").alias("table_name"), F.lit("failed").alias("failed"))
    joined = names.join(counted, "table_name", "left").join(failed, "table_name", "left")
    return joined.select(
        "table_name", F.coalesce("failed", F.lit("searched")).alias("outcome"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits")
    )


COUNTS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES
)
PLACED_SQL = "WITH hits AS ({search}) SELECT table_name, column_name, column_value, row_count, row_number() OVER (ORDER BY {order}) AS place FROM hits"


def _placed(found):
    """Rows with their place in the order they come in; at most a few hundred."""
    rows = found.select("table_name", "column_name", "column_value", "row_count").collect()
    schema = "table_name string, column_name string, column_value string, row_count long, place long"
    return found.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], schema)


@REGISTRY.add(
    "value_search_by_count",
    PLACED_SQL.format(
        search=_search_sql([c for c in TEXT_COLUMNS if c[0] in ("region", "nation", "orders", "lineitem")], "%r%"),
        order="row_count DESC, table_name, column_name, column_value",
    ),
)
def value_search_by_count(spark, sf_dir):
    tables = frames(spark, sf_dir, ["region", "nation", "orders", "lineitem"])
    return _placed(search_values(tables, "R", order="count"))


@REGISTRY.add(
    "value_search_by_name",
    PLACED_SQL.format(
        search=_search_sql([c for c in TEXT_COLUMNS if c[0] in ("region", "nation", "orders", "lineitem")], "%r%"),
        order="table_name, column_name, column_value",
    ),
)
def value_search_by_name(spark, sf_dir):
    tables = frames(spark, sf_dir, ["region", "nation", "orders", "lineitem"])
    return _placed(search_values(tables, "R", order="name"))


SHORT_HIT = ["qualified_name", "schema_name", "table_name", "column_name", "row_count"]


@REGISTRY.add(
    "catalog_search",
    f"""WITH counts AS ({COUNTS_SQL}),
    columns AS (SELECT DISTINCT table_name, column_name FROM information_schema.columns
                WHERE table_name IN (SELECT table_name FROM counts))
    SELECT '`main`.`' || table_name || '`' AS qualified_name, 'main' AS schema_name, table_name,
           CAST(NULL AS VARCHAR) AS column_name, row_count
    FROM counts WHERE table_name LIKE '%or%'
    UNION ALL
    SELECT '`main`.`' || table_name || '`.`' || column_name || '`', 'main', table_name,
           column_name, row_count
    FROM columns JOIN counts USING (table_name) WHERE lower(column_name) LIKE '%or%'""",
)
def catalog_hits(spark, sf_dir):
    inventory = inventory_of_frames(spark, frames(spark, sf_dir))
    found = catalog_search(inventory, "OR", ["table_names", "table_columns", "schema_names"])
    return found.select(*SHORT_HIT)


@REGISTRY.add(
    "catalog_columns",
    f"""WITH counts AS ({COUNTS_SQL})
    SELECT '`main`.`' || table_name || '`.`' || column_name || '`' AS qualified_name,
           'main' AS schema_name, table_name, column_name, row_count
    FROM (SELECT DISTINCT table_name, column_name, data_type FROM information_schema.columns)
    JOIN counts USING (table_name)
    WHERE lower(column_name) LIKE '%double%' OR data_type = 'DOUBLE'""",
)
def catalog_columns(spark, sf_dir):
    inventory = inventory_of_frames(spark, frames(spark, sf_dir))
    found = catalog_search(inventory, "double", ["table_columns", "table_column_types"])
    return found.select(*SHORT_HIT)


@REGISTRY.add("catalog_row_counts", COUNTS_SQL)
def catalog_row_counts(spark, sf_dir):
    return row_counts(frames(spark, sf_dir))


@REGISTRY.add("catalog_table_sizes")
def catalog_table_sizes(spark, sf_dir):
    listing = list_files(spark, sf_dir, pattern="*.parquet")
    name = F.regexp_replace("name", r"\.parquet$", "")
    inventory = inventory_of_frames(spark, frames(spark, sf_dir), "main", listing, name)
    found = catalog_search(inventory, "%", ["table_names"])
    return found.select("qualified_name", "table_name", "row_count", "size_kb")


@REGISTRY.add(
    "catalog_session_search",
    """SELECT 'table' AS kind, 'careweft_cat_orders' AS object_name,
              CAST(NULL AS VARCHAR) AS column_name, count(*) AS row_count FROM orders
       UNION ALL
       SELECT 'table', 'careweft_cat_orders', 'cat_priority', count(*) FROM orders
       UNION ALL SELECT 'table', 'careweft_cat_customer', NULL, count(*) FROM customer
       UNION ALL SELECT 'view', 'careweft_cat_view', NULL, NULL
       UNION ALL SELECT 'view', 'careweft_cat_view', 'cat_orders', NULL
       UNION ALL SELECT 'module', 'careweft_cat_view', NULL, NULL""",
)
def catalog_session_search(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("cat_priority")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    replace_table(customer, "careweft_cat_customer", path=staging_path(spark, "cat_customer"))
    name = "careweft_cat_orders"
    replace_table(orders, name, path=staging_path(spark, name))
    sql = f"SELECT count(*) AS cat_orders FROM {name}"
    create_view(spark, "careweft_cat_view", sql, "orders, counted")
    inventory = inventory_of_catalog(
        spark, [spark.catalog.currentDatabase()], count_rows=True, name_like="careweft_cat_%"
    )
    scopes = ["table_names", "table_columns", "view_names", "view_columns", "modules"]
    found = catalog_search(inventory, "CAT[_]", scopes)
    kind = (
        F.when(F.col("module_name").isNotNull(), "module")
        .when(F.col("view_name").isNotNull(), "view")
        .otherwise("table")
    )
    return found.select(
        kind.alias("kind"),
        F.coalesce("module_name", "view_name", "table_name").alias("object_name"),
        "column_name",
        "row_count",
    )


@REGISTRY.add(
    "definition_search",
    """SELECT '`' || lang || '`.`' || 'doc_' || doc_id || '`' AS qualified_name,
              lang AS schema_name, 'doc_' || doc_id AS module_name, length(text) AS size
       FROM documents
       WHERE lower('doc_' || doc_id) LIKE '%licensed under%' OR lower(text) LIKE '%licensed under%'""",
)
def definition_search(spark, sf_dir):
    modules = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("schema_name"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("module_name"),
        F.lit("TEXT").alias("module_type"),
        F.col("text").alias("module_definition"),
    )
    found = catalog_search(Inventory(modules=modules), "Licensed Under", ["modules"])
    return found.select(
        "qualified_name",
        "schema_name",
        "module_name",
        F.length("module_definition").cast("long").alias("size"),
    )


LINKS = [
    ("main", "nation", "n_regionkey", "fk_nation_region", "region", "r_regionkey"),
    ("main", "customer", "c_nationkey", "fk_customer_nation", "nation", "n_nationkey"),
    ("main", "supplier", "s_nationkey", "fk_supplier_nation", "nation", "n_nationkey"),
    ("main", "orders", "o_custkey", "fk_orders_customer", "customer", "c_custkey"),
    ("main", "lineitem", "l_orderkey", "fk_lineitem_orders", "orders", "o_orderkey"),
]


@REGISTRY.add(
    "relationship_search",
    f"""WITH counts AS ({COUNTS_SQL}),
    links(schema_name, table_name, column_name, foreign_key, parent_table, parent_column) AS
      (VALUES {", ".join(str(r) for r in LINKS)})
    SELECT '`main`.`' || parent_table || '`.`' || parent_column || '`' AS qualified_name,
           table_name, column_name, foreign_key, parent_table, parent_column, row_count
    FROM links JOIN counts USING (table_name)
    WHERE lower(parent_table) || '.' || lower(parent_column) LIKE '%n.n%'""",
)
def relationship_search(spark, sf_dir):
    links = spark.createDataFrame(
        LINKS,
        "schema_name string, table_name string, column_name string, foreign_key string, "
        "parent_table string, parent_column string",
    )
    children = frames(spark, sf_dir, sorted({r[1] for r in LINKS}))
    links = links.join(F.broadcast(row_counts(children)), "table_name", "left")
    found = catalog_search(Inventory(foreign_keys=links), "N.N", ["foreign_keys"])
    return found.select(
        "qualified_name", "table_name", "column_name", "foreign_key", "parent_table",
        "parent_column", "row_count",
    )


@REGISTRY.add(
    "render_data_type",
    """WITH t AS (
      SELECT p_partkey,
             ['decimal', 'numeric', 'float', 'varchar', 'nvarchar', 'int', 'xml', 'char'][p_partkey % 8 + 1]
               AS base,
             CAST(p_size AS INTEGER) AS p, CAST(p_size % 4 AS INTEGER) AS s,
             CASE WHEN p_partkey % 8 IN (3, 4, 6)
                  THEN CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END
                  WHEN p_partkey % 8 = 7 THEN p_size ELSE 0 END AS len
      FROM part)
    SELECT p_partkey,
      CASE WHEN base IN ('decimal', 'numeric') THEN base || '(' || p || ', ' || s || ')'
           WHEN base = 'float' THEN base || '(' || p || ')'
           WHEN base = 'int' THEN base
           WHEN len = -1 THEN base || '(max)'
           ELSE base || '(' || len || ')' END AS data_type
    FROM t""",
)
def rendered_types(spark, sf_dir):
    names = F.array(
        *[F.lit(n) for n in "decimal numeric float varchar nvarchar int xml char".split()]
    )
    kind = F.col("p_partkey") % 8
    base = F.element_at(names, (kind + 1).cast("int"))
    length = (
        F.when(kind.isin(3, 4, 6), F.when(F.col("p_size") % 5 == 0, -1).otherwise(F.col("p_size")))
        .when(kind == 7, F.col("p_size"))
        .otherwise(0)
    )
    text = render_data_type(base, base, F.col("p_size"), F.col("p_size") % 4, length)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("data_type"))
