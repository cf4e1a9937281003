"""Signatures of files: no hit is lost, and files without the pattern are not read."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from careweft.plans import signatures
from careweft.plans.value_search import search_values

ROWS = [
    (1, "Alpha beta", "x", 10.5, ["one", "two"], b"\x01\xff"),
    (2, "gamma\ndelta", None, None, None, None),
    (3, "Äpfel und Birnen 100%", "ab", 3.25, [], b""),
    (4, "", "abc", -1.0, ["Alphabet"], b"\xab\xcd\xef"),
    (5, "the alpha-beta test", "b_c", 77.0, ["x"], None),
    (6, None, None, None, None, None),
]
SCHEMA = "id int, words string, code string, number double, list array<string>, raw binary"
PATTERNS = [
    "alpha", "ALPHA BETA", "a%beta", "al_ha", "[ab]lpha", "[^x]lpha-b", "äpf", "a", "ab", "%", "_", "", "zzz",
    "100", "0xab", "3.2", "7", "delta", "a\ndel", "birnen 1", "pha%100", "beta test", "eta", "[", "et",
]


@pytest.fixture
def indexed(spark, tmp_path):
    path, side = str(tmp_path / "t"), str(tmp_path / "side")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3, "id").write.option("maxRecordsPerFile", 1).parquet(path)
    signatures.update_signatures(spark, {"t": path}, side)
    return {"t": path}, side


def same(spark, paths, side, pattern, **options) -> list:
    want = search_values({n: spark.read.parquet(p) for n, p in paths.items()}, pattern, **options)
    got = signatures.search_files(spark, paths, spark.read.schema(signatures.SCHEMA).parquet(side), pattern, **options)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())), pattern
    files = signatures.files_to_read(spark, paths, spark.read.parquet(side), pattern, **{k: v for k, v in options.items() if k != "order"})
    return [r["read"] for r in files.collect()]


def test_same_rows_whatever_the_pattern(spark, indexed):
    paths, side = indexed
    for pattern in PATTERNS:
        read = same(spark, paths, side, pattern)
        if not signatures.needed_strings(pattern):
            assert all(read)


def test_nested_and_other_types(spark, indexed):
    paths, side = indexed
    for pattern in ("alphabet", "10.5", "-1.0", "two"):
        same(spark, paths, side, pattern, nested=True, floats=True)


def test_files_without_the_pattern_are_not_read(spark, indexed):
    paths, side = indexed
    assert sum(same(spark, paths, side, "alpha-beta")) == 1
    assert sum(same(spark, paths, side, "alphabet")) < 6
    assert sum(same(spark, paths, side, "no such text")) == 0
    assert sum(same(spark, paths, side, "alpha", column_like="code")) == 0
    assert sum(same(spark, paths, side, "alpha", column_like="nothing")) == 0


def test_new_and_changed_files_are_read_until_they_are_indexed(spark, indexed):
    paths, side = indexed
    new = spark.createDataFrame([(7, "quite new", None, None, None, None)], SCHEMA)
    new.coalesce(1).write.mode("append").parquet(paths["t"])
    before = spark.read.parquet(side).count()
    assert sum(same(spark, paths, side, "quite new")) == 1
    assert sum(same(spark, paths, side, "no such text")) == 1
    signatures.update_signatures(spark, paths, side)
    assert spark.read.parquet(side).count() > before
    assert sum(same(spark, paths, side, "no such text")) == 0
    grown = spark.read.parquet(side).count()
    signatures.update_signatures(spark, paths, side)
    assert spark.read.parquet(side).count() == grown
    # Rewritten in place: the old signatures say nothing about it any more.
    spark.createDataFrame([(8, "rewritten", None, None, None, None)], SCHEMA).write.mode("overwrite").parquet(paths["t"])
    assert sum(same(spark, paths, side, "rewritten")) >= 1


def test_a_column_that_is_not_indexed_is_read(spark, indexed):
    paths, side = indexed
    part = spark.read.parquet(side).filter(F.col("column_name") != "words")
    files = signatures.files_to_read(spark, paths, part, "no such text").collect()
    assert all(r["read"] for r in files)


def test_bits_are_those_of_the_built_in_functions(spark, indexed):
    _, side = indexed
    words = spark.createDataFrame(ROWS, SCHEMA).select(F.lower("words").cast("binary").alias("v")).collect()
    want = {r.v[i] << 16 | r.v[i + 1] << 8 | r.v[i + 2] for r in words if r.v for i in range(len(r.v) - 2)}
    stored = spark.read.parquet(side).filter("bucket >= 0 AND column_name = 'words'")
    united = stored.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    assert united.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(want)


@pytest.mark.parametrize("block", [4, 7, 1 << 22])
def test_strings_do_not_cross_values(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(signatures, "BLOCK", block)
    values = [b"abcd", None, b"", b"xy", b"zabc", b"12345678"]
    want = sorted({v[i] << 16 | v[i + 1] << 8 | v[i + 2] for v in values if v for i in range(len(v) - 2)})
    for kind in (pa.binary(), pa.large_binary()):
        for cut in range(3):
            part = pa.array([b"qqqq"] * cut + values, kind).slice(cut)
            seen = np.zeros(1 << 24, bool)
            assert signatures.strings_in(part, seen).tolist() == want and not seen.any()
