"""Scalar function queries: text, dates, lists, literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from careweft.checks.common import Registry, table
from careweft.functions.names import quoted
from careweft.functions.predicates import date_range
from careweft.functions.text import last_position, row_literal
from careweft.functions.times import format_epoch_ms

REGISTRY = Registry()


@REGISTRY.add(
    "scalar_strings",
    """SELECT p_partkey, lower(p_name) AS lowered, p_name LIKE '%a%' AS has_a,
      p_type ILIKE '%STEEL' AS ilike_steel, p_brand || '/' || p_type AS joined,
      concat_ws('-', p_brand, NULL, p_type) AS joined_ws, substr(p_name, 2, 3) AS middle,
      left(p_name, 3) AS lead3, right(p_name, 3) AS tail3,
      replace(replace(p_type, 'A', '4'), 'E', '3') AS swapped,
      regexp_replace(regexp_replace(p_name, '[- _]+', '_', 'g'), '[^A-Za-z0-9_]+', '', 'g') AS cleaned,
      CASE WHEN strpos(p_type, 'E') = 0 THEN 0
           ELSE length(p_type) - strpos(reverse(p_type), 'E') + 1 END AS last_e,
      length(p_name) AS name_length, split_part(p_name, ' ', 1) AS first_word,
      starts_with(p_brand, 'Brand') AS begins, contains(p_name, 're') AS holds,
      suffix(p_type, 'R') AS ends, trim('  ' || p_brand || ' ') AS trimmed,
      repeat('=', CAST(p_size % 5 AS BIGINT)) AS bars, '`' || p_name || '`' AS quoted,
      split_part('main.' || p_brand, '.', 2) AS second_part,
      TRY_CAST(substr(p_brand, 7) AS DOUBLE) IS NOT NULL AS is_number,
      hex(p_brand) AS hexed, p_brand || chr(9) || p_type || chr(13) || chr(10) AS controls,
      coalesce(nullif(p_brand, 'Brand#1'), 'none') AS no_brand1,
      CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS word,
      CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS size_double
    FROM part""",
)
def scalar_strings(spark, sf_dir):
    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    cleaned = F.regexp_replace(F.regexp_replace(name, "[- _]+", "_"), r"[^A-Za-z0-9_]+", "")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower(name).alias("lowered"),
        name.like("%a%").alias("has_a"),
        kind.ilike("%STEEL").alias("ilike_steel"),
        F.concat(brand, F.lit("/"), kind).alias("joined"),
        F.concat_ws("-", brand, F.lit(None).cast("string"), kind).alias("joined_ws"),
        F.substring(name, 2, 3).alias("middle"),
        F.left(name, F.lit(3)).alias("lead3"),
        F.right(name, F.lit(3)).alias("tail3"),
        F.replace(F.replace(kind, F.lit("A"), F.lit("4")), F.lit("E"), F.lit("3")).alias("swapped"),
        cleaned.alias("cleaned"),
        last_position(kind, "E").cast("long").alias("last_e"),
        F.length(name).cast("long").alias("name_length"),
        F.element_at(F.split(name, " "), 1).alias("first_word"),
        brand.startswith("Brand").alias("begins"),
        name.contains("re").alias("holds"),
        kind.endswith("R").alias("ends"),
        F.trim(F.concat(F.lit("  "), brand, F.lit(" "))).alias("trimmed"),
        F.repeat(F.lit("="), size % 5).alias("bars"),
        quoted(name).alias("quoted"),
        F.split_part(F.concat(F.lit("main."), brand), F.lit("."), F.lit(2)).alias("second_part"),
        F.substring(brand, 7, 100).try_cast("double").isNotNull().alias("is_number"),
        F.hex(brand).alias("hexed"),
        F.concat(brand, F.char(F.lit(9)), kind, F.char(F.lit(13)), F.char(F.lit(10))).alias(
            "controls"
        ),
        F.coalesce(F.nullif(brand, F.lit("Brand#1")), F.lit("none")).alias("no_brand1"),
        F.when(size % 3 == 0, "zero").when(size % 3 == 1, "one").alias("word"),
        size.cast("string").cast("double").alias("size_double"),
    )


@REGISTRY.add(
    "scalar_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
      strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS order_year,
      date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS days_since,
      CAST(o_orderdate AS DATE) - 61 AS before_61, CAST(o_orderdate AS DATE) + 32 AS after_32,
      date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS epoch_day,
      coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END,
               DATE '2000-01-01') AS even_date
    FROM orders""",
)
def scalar_dates(spark, sf_dir):
    date = F.col("o_orderdate").cast("date")
    origin = F.lit("1995-06-17").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.year("o_orderdate").cast("long").alias("order_year"),
        F.datediff(date, origin).cast("long").alias("days_since"),
        F.date_add(date, -61).alias("before_61"),
        F.date_add(date, 32).alias("after_32"),
        F.unix_date(date).cast("long").alias("epoch_day"),
        F.coalesce(
            F.when(F.col("o_orderkey") % 2 == 0, date), F.lit("2000-01-01").cast("date")
        ).alias("even_date"),
    )


@REGISTRY.add(
    "scalar_lists",
    """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations)
    SELECT conv_id, turn, len(words) AS n, words[1] AS first_word, words[-1] AS last_word,
      array_to_string(list_transform(words, lambda x: lower(x)), '|') AS mapped,
      len(list_filter(words, lambda x: length(x) > 12)) > 0 AS any_long,
      CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS letters,
      CAST(list_sum(range(1, len(words) + 1)) AS BIGINT) AS sequence_sum,
      array_to_string(words[2:], ' ') AS without_first,
      list_contains(words, 'the') AS has_the,
      len(list_filter(words, lambda x: x <> 'the')) AS without_the,
      len(list_concat(words, ['a', 'b'])) AS plus_two,
      try_cast(words[1] AS BIGINT) AS as_number
    FROM w""",
)
def scalar_lists(spark, sf_dir):
    words = F.col("words")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.split("text", " ").alias("words")
    )
    zero = F.lit(0).cast("long")
    return rows.select(
        "conv_id",
        "turn",
        F.size(words).cast("long").alias("n"),
        F.element_at(words, 1).alias("first_word"),
        F.element_at(words, -1).alias("last_word"),
        F.array_join(F.transform(words, F.lower), "|").alias("mapped"),
        F.exists(words, lambda x: F.length(x) > 12).alias("any_long"),
        F.aggregate(words, zero, lambda acc, x: acc + F.length(x)).alias("letters"),
        F.aggregate(
            F.sequence(F.lit(1), F.size(words)), zero, lambda acc, x: acc + x
        ).alias("sequence_sum"),
        F.array_join(F.slice(words, F.lit(2), F.size(words)), " ").alias("without_first"),
        F.array_contains(words, "the").alias("has_the"),
        F.size(F.array_remove(words, "the")).cast("long").alias("without_the"),
        F.size(F.flatten(F.array(words, F.array(F.lit("a"), F.lit("b"))))).cast("long").alias(
            "plus_two"
        ),
        F.element_at(words, 1).try_cast("bigint").alias("as_number"),
    )


@REGISTRY.add(
    "scalar_records",
    """WITH w AS (SELECT conv_id, unnest(list_transform(list_distinct(string_split(text, ' ')),
                     lambda x: {'word': x, 'size': length(x)})) AS r FROM conversations)
    SELECT conv_id, r.word AS word, CAST(r.size AS BIGINT) AS size, count(*) AS turns
    FROM w GROUP BY ALL""",
)
def scalar_records(spark, sf_dir):
    words = F.array_distinct(F.split("text", " "))
    records = F.transform(
        words, lambda x: F.struct(x.alias("word"), F.length(x).cast("long").alias("size"))
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.inline(records))
    return rows.groupBy("conv_id", "word", "size").agg(F.count(F.lit(1)).alias("turns"))


@REGISTRY.add(
    "half_open_range",
    """SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09'
    GROUP BY event_type""",
)
def half_open_range(spark, sf_dir):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-02", "2024-01-09"))
    found = table(spark, sf_dir, "events").filter(date_range("ts", start, end))
    return found.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


@REGISTRY.add(
    "row_sql_literal",
    """SELECT o_orderkey, '(' || o_orderkey || ', ''' || o_orderstatus || ''', '
      || CASE WHEN o_orderpriority = '5-LOW' THEN 'null'
              ELSE '''' || replace(o_orderpriority || '''s', '''', '''''') || '''' END
      || ', ''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''', '''
      || strftime(o_orderdate, '%Y-%m-%d') || ''', null, true)' AS literal
    FROM orders""",
)
def row_sql_literal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(
            F.col("o_orderpriority") != "5-LOW", F.concat("o_orderpriority", F.lit("'s"))
        ).alias("priority"),
        "o_orderdate",
        F.col("o_orderdate").cast("date").alias("day"),
        F.array(F.lit(1)).alias("list"),
        F.lit(True).alias("flag"),
    )
    return rows.select("o_orderkey", row_literal(rows).alias("literal"))


@REGISTRY.add(
    "epoch_tz_label",
    """SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || ' EST' AS est,
      strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' PDT' AS pdt,
      CASE WHEN ts >= TIMESTAMP '2024-03-10 08:00:00' AND ts < TIMESTAMP '2024-11-03 07:00:00'
           THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || ' CDT'
           ELSE strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') || ' CST' END AS chicago
    FROM events""",
)
def epoch_tz_label(spark, sf_dir):
    # Milliseconds since 1970 without the session's time zone.
    ms = F.expr(
        "cast(unix_date(cast(ts as date)) as bigint) * 86400000 + hour(ts) * 3600000L"
        " + minute(ts) * 60000L + cast(floor(extract(second from ts) * 1000) as bigint)"
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        format_epoch_ms(ms, "EST").alias("est"),
        format_epoch_ms(ms, "PDT").alias("pdt"),
        format_epoch_ms(ms, "America/Chicago").alias("chicago"),
    )
