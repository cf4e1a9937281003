"""Text pieces, tab stops, literals, time labels, catalog and value search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from careweft.functions.text import (
    chunk_text,
    expand_tabs,
    module_banner,
    row_literal,
    text_pieces,
)
from careweft.functions.times import eastern_label, format_epoch_ms
from careweft.functions.types import render_data_type
from careweft.plans.catalog_search import Inventory, catalog_search, inventory_of_catalog
from careweft.plans.value_search import is_numeric_pattern, search_full_rows, search_values


def brute_pieces(text, size, line_break):
    out = []
    while len(text) > size:
        at = text[:size].rfind(line_break)
        cut = size + 1 if at < 0 else at + len(line_break)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_pieces_are_the_rule(spark, line_break):
    rng = random.Random(3)
    texts = ["", "a", "x" * 10, "x" * 11, "x" * 22, "\n" * 40, "é" * 35, "a\r\n" * 12]
    texts += ["".join(rng.choice("ab\n\r ") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", text_pieces("t", 10, line_break).alias("p")).collect()}
    assert got == {i: brute_pieces(t, 10, line_break) for i, t in enumerate(texts)}


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "ab\ncd\nef"), (2, ""), (3, None)], "i int, t string")
    rows = chunk_text(df, "t", 4).orderBy("i", "chunk_no").collect()
    assert [(r["i"], r["chunk_no"], r["chunk"]) for r in rows] == [
        (1, 1, "ab\n"), (1, 2, "cd\n"), (1, 3, "ef"),
    ]


def test_banner_shows_24_hours(spark):
    df = spark.createDataFrame(
        [("m", dt.datetime(2024, 1, 2, 15, 4, 5), None)],
        "n string, c timestamp_ntz, m timestamp_ntz",
    )
    text = df.select(module_banner("n", "c", "m")).first()[0]
    assert text == "--\tModule:\tm\n--\tCreated:\t2024-01-02 15:04:05\n--\tModified:\t\n"


@pytest.mark.parametrize(
    "text, plain, kept",
    [
        ("a\tbc\td", "a   bc  d", "a\tbc\td"),
        ("\tx\n\ty", "    x\n    y", "\tx\n    y"),
        ("abcd\te\r\nf\tg", "abcd    e\n\nf   g", "abcd\te\n\nf   g"),
        ("", "", ""),
        ("é\t1\t", "é   1   ", "é\t1\t"),
    ],
)
def test_expand_tabs(spark, text, plain, kept):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(expand_tabs("t")).first()[0] == plain
    assert df.select(expand_tabs("t", keep_first_line=True)).first()[0] == kept


def test_expand_tabs_options(spark):
    df = spark.createDataFrame([("a\r\nb\tc",), (None,)], "t string")
    got = [r[0] for r in df.select(expand_tabs("t", width=8, normalise_crlf=True)).collect()]
    assert got == ["a\nb       c", None]


def test_row_literal(spark):
    df = spark.createDataFrame(
        [(1, "it's", 2.5, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 13, 0), True, b"x", None)],
        "i int, t string, d double, day date, ts timestamp_ntz, b boolean, bin binary, n string",
    )
    assert df.select(row_literal(df)).first()[0] == (
        "(1, 'it''s', 2.5, '2024-01-02', '2024-01-02 13:00:00', true, null, null)"
    )


def test_epoch_labels(spark):
    winter, summer = 1_704_110_400_123, 1_719_835_200_999  # 2024-01-01 12:00, 2024-07-01 12:00
    df = spark.createDataFrame([(winter,), (summer,)], "ms long")
    got = {z: [r[0] for r in df.select(format_epoch_ms("ms", z)).collect()]
           for z in ("EST", "PDT", "America/New_York")}
    assert got["EST"] == ["2024-01-01 07:00:00 EST", "2024-07-01 07:00:00 EST"]
    assert got["PDT"][0] == "2024-01-01 05:00:00 PDT"
    assert got["America/New_York"] == ["2024-01-01 07:00:00 EST", "2024-07-01 08:00:00 EDT"]
    assert eastern_label(dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)) == "EDT"
    assert eastern_label(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)) == "EST"
    with pytest.raises(ValueError):
        format_epoch_ms("ms", "UTC")


def test_epoch_label_ignores_session_zone(spark):
    df = spark.createDataFrame([(1_710_054_000_000,)], "ms long")  # 2024-03-10 07:00 UTC
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(format_epoch_ms("ms", "EST")).first()[0] == "2024-03-10 02:00:00 EST"
        assert df.select(format_epoch_ms("ms", "America/New_York")).first()[0] == (
            "2024-03-10 03:00:00 EDT"
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_render_types(spark):
    rows = [
        ("decimal", "decimal", 10, 2, 9, "decimal(10, 2)"), ("float", "float", 53, 0, 8, "float(53)"),
        ("varchar", "varchar", 0, 0, -1, "varchar(max)"), ("char", "char", 0, 0, 5, "char(5)"),
        ("int", "int", 10, 0, 4, "int"), ("ssn", "varchar", 0, 0, 11, "ssn(11)"),
        ("xml", "xml", 0, 0, 0, "xml0"), ("geo", "geo", 0, 0, -1, "geomax"),
    ]
    df = spark.createDataFrame(rows, "n string, b string, p int, s int, l int, want string")
    out = df.select("want", render_data_type("n", "b", "p", "s", "l").alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_numeric_pattern():
    assert [is_numeric_pattern(p) for p in ("12", "%1_2%", "[0-9]", "-5", "1.5", "", "a1", "%")] == [
        True, True, True, True, True, False, False, False,
    ]


def test_value_search_types(spark):
    df = spark.createDataFrame(
        [(1, "x12", 12.0, bytearray(b"\x12"), ["12"], dt.date(2012, 1, 1), True)],
        "i int, t string, d double, b binary, l array<string>, day date, f boolean",
    )
    find = lambda **o: {
        r["column_name"] for r in search_values({"t": df}, "12", **o).collect()
    }
    assert find() == {"t", "b"}
    assert find(nested=True, floats=True, dates=True) == {"t", "b", "l", "d", "day"}
    assert find(column_like="b%") == {"b"} and find(table_like="x%") == set()
    assert {r["column_name"] for r in search_values({"t": df}, "1").collect()} == {"i", "t", "b"}
    rows = search_values({"t": df, "s": df}, "12", order="count").collect()
    assert [r["table_name"] for r in rows] == ["s", "s", "t", "t"]


def test_long_values_are_searched_whole(spark):
    df = spark.createDataFrame([("a" * 5000 + "needle",)], "t string")
    row = search_values({"x": df}, "NEEDLE", shown=4096).first()
    assert row["column_value"] == "a" * 4096 and row["row_count"] == 1


def test_long_values_with_one_beginning_stay_apart(spark):
    df = spark.createDataFrame([("a" * 5000 + "one",), ("a" * 5000 + "two",)], "t string")
    assert {r["row_count"] for r in search_values({"x": df}, "aaa").collect()} == {1}
    assert search_values({"x": df}, "aaa", shown=10).count() == 2


def test_full_rows_limit(spark):
    df = spark.range(10).select("id", F.lit("hit").alias("t"), F.lit("hit").alias("u"))
    count = lambda n: search_full_rows({"x": df}, "hit", n, order={"x": ["id"]}).groupBy(
        "column_found").count().collect()
    assert {r["column_found"]: r["count"] for r in count(3)} == {"t": 3, "u": 3}
    assert {r["count"] for r in count(0)} == {10}


def test_catalog(spark):
    spark.range(4).toDF("order_id").write.mode("overwrite").saveAsTable("cat_orders")
    spark.sql("CREATE OR REPLACE VIEW cat_view AS SELECT order_id AS oid FROM cat_orders")
    inventory = inventory_of_catalog(spark, ["default"], count_rows=True)
    hits = catalog_search(inventory, "CAT_", problems=(problems := []), ordered=True).collect()
    names = [r["qualified_name"] for r in hits]
    assert "`default`.`cat_orders`" in names and "`default`.`cat_view`" in names
    assert {r["row_count"] for r in hits if r["table_name"] == "cat_orders"} == {4}
    assert sorted(p.split(":")[0] for p in problems) == ["foreign_keys", "synonyms"]
    text = catalog_search(inventory, "from cat_orders", ["modules"]).collect()
    assert [r["module_name"] for r in text] == ["cat_view"]
    kinds = catalog_search(inventory, "bigint", ["view_column_types"]).collect()
    assert "oid" in {r["column_name"] for r in kinds}
    with pytest.raises(ValueError):
        catalog_search(Inventory(), "x", ["synonyms"])
    with pytest.raises(ValueError):
        catalog_search(inventory, "x", ["nonsense"])


def test_synonyms(spark):
    syn = spark.createDataFrame(
        [("dbo", "people", "crm.person"), ("dbo", "x", "y")],
        "schema_name string, synonym_name string, synonym_object string",
    )
    rows = catalog_search(Inventory(synonyms=syn), "PERSON", ["synonyms"]).collect()
    assert [r["qualified_name"] for r in rows] == ["`dbo`.`people`"] and len(rows[0]) == 18
