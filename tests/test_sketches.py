"""Profiles united from files, and long population lists."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from careweft.operators.intervals import event_rows
from careweft.plans import sketches
from careweft.plans.profile import profile_table
from careweft.sources.values import in_population, sift

SCHEMA = "id long, name string, price decimal(12,2), weight double, nothing int, tags array<string>"


def frame(spark, low, high):
    rows = [
        (i, None if i % 5 == 0 else "" if i % 7 == 0 else f"name {i % 1000}", Decimal(i % 300) / 4, None if i % 3 else float(i), None, ["a"] * (i % 4))
        for i in range(low, high)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, path):
    return spark.read.schema(sketches.SCHEMA).parquet(path)


def profile(spark, paths, side):
    return sketches.united_profile(sketches.current(spark, paths, store(spark, side))).orderBy("ordinal_position").collect()


@pytest.fixture
def grown(spark, tmp_path):
    paths, side = {"t": str(tmp_path / "t")}, str(tmp_path / "side")
    for low, high in ((0, 1500), (1500, 4000)):
        frame(spark, low, high).repartition(3).write.mode("append").parquet(paths["t"])
        sketches.update_sketches(spark, paths, side)
    return paths, side


def test_united_parts_equal_the_whole(spark, grown, tmp_path):
    paths, side = grown
    assert store(spark, side).count() == 6 * 6  # each file once
    whole = {"t": str(tmp_path / "whole")}
    frame(spark, 0, 4000).coalesce(1).write.parquet(whole["t"])
    sketches.update_sketches(spark, whole, str(tmp_path / "other"))
    one, parts = profile(spark, whole, str(tmp_path / "other")), profile(spark, paths, side)
    assert [r.asDict() | {"quantiles": None, "distinct_estimate": 0} for r in one] == [r.asDict() | {"quantiles": None, "distinct_estimate": 0} for r in parts]
    exact = profile_table(frame(spark, 0, 4000)).orderBy("ordinal_position").collect()
    for got, want in zip(parts, exact, strict=True):
        for c in ("total_count", "null_count", "empty_count", "min_value", "max_value", "min_length", "max_length", "average", "average_length"):
            assert got[c] == want[c] or abs(got[c] - want[c]) < 1e-9
        assert abs(got["distinct_estimate"] - want["distinct_count"]) <= 0.03 * want["distinct_count"]
        assert (got["quantiles"] is None) == (got["min_value"] is None)
    assert all(abs(q - w) <= 80 for q, w in zip(parts[0]["quantiles"], (1000, 2000, 3000)))


def test_files_that_are_gone_do_not_count(spark, grown):
    paths, side = grown
    frame(spark, 0, 10).coalesce(1).write.mode("overwrite").parquet(paths["t"])
    sketches.update_sketches(spark, paths, side)
    assert profile(spark, paths, side)[0]["total_count"] == 10


def test_many_distinct_values(spark, tmp_path):
    paths, side = {"t": str(tmp_path / "t")}, str(tmp_path / "side")
    spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("v")).repartition(4).write.parquet(paths["t"])
    sketches.update_sketches(spark, paths, side)
    (row,) = profile(spark, paths, side)
    assert abs(row["distinct_estimate"] - 200_000) <= 6_000


def test_sift_lets_all_members_and_few_others_pass(spark):
    facts = spark.range(200_000).select((F.col("id") % 100_000).alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("s"))
    keys = spark.range(0, 100_000, 100).select(F.col("id").alias("k"))
    kept = sift(facts, keys, ["k"])
    assert kept.columns == facts.columns
    passed = kept.count()
    assert 2000 <= passed <= 2020  # one per cent and hardly a row more
    got = in_population(facts, keys, ["k"], small=10)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, facts.filter("k % 100 = 0").collect()))
    hot = spark.createDataFrame([("hot",), ("77",), (None,)], "s string")
    got = in_population(facts.withColumn("s", F.when(F.col("k") != 5, F.col("s"))), hot, ["s"], small=1)
    assert got.count() == facts.filter("k != 5 and s in ('hot', '77')").count()
    two = spark.createDataFrame([(3, "hot"), (4, "4"), (5, "no")], "k long, s string")
    assert sorted(map(tuple, in_population(facts, two, ["k", "s"], small=0).collect())) == sorted(map(tuple, facts.join(two, ["k", "s"]).collect()))
    assert in_population(facts, keys.limit(0), ["k"], small=-1).count() == 0


DAY = dt.date(2024, 1, 1)


def plain_rows(entities, events, lo, hi):
    return Counter(
        (*e, *v) for e in entities for v in events
        if e[0] is not None and e[0] == v[0] and e[2] and v[1] and lo <= (v[1] - e[2]).days <= hi
    )


@pytest.mark.parametrize("lo, hi", [(0, 0), (-30, 0), (2, 32), (0, 60)])
@pytest.mark.parametrize("floor", [7, 10**9])
def test_event_rows_are_a_range_join(spark, lo, hi, floor):
    rng = random.Random(hi)
    keys = [1, 1, 1, 2, 3, None]
    entities = [(rng.choice(keys), i, rng.choice([None, DAY + dt.timedelta(rng.randrange(-100, 200))])) for i in range(60)]
    events = [(rng.choice(keys), rng.choice([None, DAY + dt.timedelta(rng.choice([5, rng.randrange(-100, 200)]))]), rng.randrange(3)) for _ in range(300)]
    got = event_rows(
        spark.createDataFrame(entities, "k int, id int, day date"),
        spark.createDataFrame(events, "k int, day date, n int"), "k", "day", "day", lo, hi, floor=floor,
    )
    assert got.columns == ["k", "id", "day", "event_k", "event_day", "event_n"]
    assert Counter(map(tuple, got.collect())) == plain_rows(entities, events, lo, hi)


def test_one_key_and_day_is_dealt_over_tasks(spark):
    events = spark.range(1_000_000).select(F.lit(1).alias("k"), F.lit(DAY).alias("day"), F.lit("alike").alias("v"))
    entities = spark.createDataFrame([(1, DAY), (1, DAY - dt.timedelta(3)), (2, DAY)], "k int, day date")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = event_rows(entities, events, "k", "day", "day", 0, 10, floor=20_000)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 2_000_000 and len(sizes) == 4 and max(sizes) < 1_000_000


@pytest.mark.parametrize("lo, hi", [(0, 0), (-30, 0), (0, 60)])
@pytest.mark.parametrize("floor, key_events", [(10**9, 20), (9, 20), (10**9, 0)])
@pytest.mark.parametrize("key", ["int", "string"])
def test_event_rows_of_busy_and_other_keys(spark, lo, hi, floor, key_events, key):
    """Keys meet as they are or by buckets, those of two types too; rows that are alike stay as many."""
    rng = random.Random(hi)
    keys = [*[1] * 30, *range(2, 30), None]
    days = [None, *[DAY + dt.timedelta(d) for d in range(-100, 200)]]
    entities = [(rng.choice(keys), i // 2, rng.choice(days)) for i in range(300)] + [(5, 1, DAY)] * 2
    events = [(rng.choice(keys), rng.choice(days), rng.randrange(3)) for _ in range(400)] + [(5, DAY, 1)] * 3
    got = event_rows(
        spark.createDataFrame(entities, "k int, id int, day date"),
        spark.createDataFrame(events, "k int, day date, n int").withColumn("k", F.col("k").cast(key)),
        "k", "day", "day", lo, hi, floor=floor, key_events=key_events,
    )
    assert got.columns == ["k", "id", "day", "event_k", "event_day", "event_n"]
    rows = Counter((*r[:3], int(r[3]), *r[4:]) for r in got.collect())
    assert rows == plain_rows(entities, events, lo, hi) and len({r[0] for r in rows}) > 5
