"""Tables without a gap, and searches of which a part fails."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from careweft.plans.branches import run_branches, search_each
from careweft.plans.value_search import search_values
from careweft.sources.versions import current_version, publish, roll_back, versions_of


def numbers(df) -> list:
    return sorted(r[0] for r in df.collect())


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path / "v")
    publish(spark.range(5), "v_failed", root)
    half = spark.range(100, 140, 1, 4).select(
        F.when(F.col("id") < 135, F.col("id")).otherwise(F.raise_error(F.lit("half-way"))).alias("id")
    )
    with pytest.raises(PySparkException):
        publish(half, "v_failed", root)
    assert numbers(spark.table("v_failed")) == [0, 1, 2, 3, 4]
    assert len(versions_of(spark, "v_failed", root)) == 1
    assert numbers(publish(spark.range(7, 9), "v_failed", root)) == [7, 8]
    assert len(list(Path(root).iterdir())) == 2  # what the failed write left is gone


def test_readers_keep_what_they_opened(spark, tmp_path):
    root = str(tmp_path / "v")
    opened = publish(spark.range(3), "v_open", root)
    new = publish(spark.range(10).withColumn("more", F.lit("x")), "v_open", root)
    assert numbers(opened) == [0, 1, 2] and new.columns == ["id", "more"]
    assert spark.table("v_open").count() == 10
    # Rows may come from the name itself.
    assert publish(spark.table("v_open").filter("id > 7"), "v_open", root).count() == 2


def test_versions_are_kept_and_can_come_back(spark, tmp_path):
    root = str(tmp_path / "v")
    for n in range(1, 6):
        publish(spark.range(n), "v_back", root, keep=2)
    assert [Path(v).name < Path(current_version(spark, "v_back")).name for v in versions_of(spark, "v_back", root)] == [True, True, False]
    assert roll_back(spark, "v_back", root).count() == 4
    assert roll_back(spark, "v_back", root).count() == 3
    with pytest.raises(ValueError):
        roll_back(spark, "v_back", root)
    assert publish(spark.range(9), "v_back", root, keep=0).count() == 9
    assert len(versions_of(spark, "v_back", root)) == 1
    assert current_version(spark, "v_none") is None


def test_a_table_that_fails_while_it_is_read_is_one_problem(spark, tmp_path):
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"this is no parquet file")
    good = spark.createDataFrame([("a needle",), ("hay",)], "t string")
    tables = {
        "good": lambda: good,
        "broken": lambda: spark.read.schema("t string").parquet(str(broken)),
        "absent": lambda: spark.read.parquet(str(tmp_path / "absent")),
        "fails": lambda: good.select(F.when(F.col("t") == "hay", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("t")).alias("t")),
        "other": lambda: good.union(good),
    }
    hits, problems = search_each(spark, tables, "NEEDLE")
    want = search_values({n: tables[n]() for n in ("good", "other")}, "needle")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    found = {r["branch"]: r for r in problems.collect()}
    assert sorted(found) == ["absent", "broken", "fails"]
    assert all(r["error"] and r["message"] for r in found.values())
    hits, problems = search_each(spark, tables, "needle", table_like="o%", at_once=1)
    assert hits.count() == 1 and problems.count() == 0


def test_all_branches_fail_or_none_is_there(spark):
    def fails():
        return spark.table("no_such_table_at_all")

    rows, problems = run_branches(spark, {"a": fails, "b": fails}, "x int")
    assert rows.count() == 0 and rows.columns == ["x"] and problems.count() == 2
    rows, problems = run_branches(spark, {}, "x int")
    assert rows.count() == 0 and problems.count() == 0

    def mistaken():
        raise KeyError("a mistake of the caller")

    with pytest.raises(KeyError):
        run_branches(spark, {"a": mistaken}, "x int")
