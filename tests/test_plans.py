"""Properties of the plans that decide how a query scales."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from careweft.checks import claims as claim_checks
from careweft.checks import provider as provider_checks
from careweft.checks.common import table
from careweft.operators.intervals import event_rows
from careweft.operators.skew import hot_keys
from careweft.operators.slots import unpivot_slots
from careweft.plans import episodes as ep
from careweft.plans.profile import profile_table
from careweft.plans.value_search import search_values
from careweft.session import cut_lineage, size_shuffles, staging_path
from oracle import difference

ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return text.count("Exchange hashpartitioning")


def test_registry_needs_no_session():
    """Importing the entry and listing the queries starts no Spark."""
    code = "import __spark_entry__ as e; e.queries(); e.oracle_sql()"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
        env={**os.environ, "PYTHONPATH": str(ROOT)}, timeout=120,
    )
    assert done.returncode == 0, done.stderr


def test_episodes_take_one_shuffle(spark, sf_dir):
    path = staging_path(spark, "claims")
    claim_checks.claims(spark, sf_dir).write.parquet(path)
    built = ep.build_episodes(spark.read.parquet(path))
    text = plan(built)
    assert shuffles(text) == 1 and text.count("FileScan") == 1
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_slots_take_one_scan_and_no_shuffle(spark, sf_dir):
    path = staging_path(spark, "wide")
    provider_checks.wide_orders(spark, sf_dir).write.parquet(path)
    wide = spark.read.parquet(path)
    fields = {"part": "part_{i}", "supp": "supp_{i}"}
    text = plan(unpivot_slots(wide, ["NPI"], fields, 20).filter("NPI = '7'"))
    assert text.count("FileScan") == 1 and shuffles(text) == 0
    assert "PushedFilters: [IsNotNull(NPI), EqualTo(NPI,7)]" in text
    assert "flag_1" not in text


def test_latest_version_is_limited_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["latest_version_per_key"](spark, sf_dir))
    assert text.count("WindowGroupLimit") == 2 and shuffles(text) == 1


def test_full_rows_are_limited_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["value_search_full_rows"](spark, sf_dir))
    assert "WindowGroupLimit" in text


def test_profile_takes_one_scan(spark, sf_dir):
    text = plan(profile_table(table(spark, sf_dir, "orders")))
    # By value, by column and limb of the exact sums, by column; the last two move a few rows a task.
    assert text.count("FileScan") == 1 and shuffles(text) == 3


def test_value_search_reads_only_searched_columns(spark, sf_dir):
    found = search_values({"part": table(spark, sf_dir, "part")}, "x", column_like="p_brand")
    text = plan(found)
    assert "ReadSchema: struct<p_brand:string>" in text and shuffles(text) == 1


def test_population_is_broadcast(spark, sf_dir):
    text = plan(entry.queries()["values_population"](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_staged_table_keeps_schema(spark):
    df = spark.sql(
        "SELECT 1 AS a, timestamp_ntz'2024-01-01 00:00:00' AS t, cast(1.5 AS decimal(18,2)) AS d,"
        " array(named_struct('x y', 'é')) AS s, cast(NULL AS string) AS n"
    )
    staged = cut_lineage(df)
    assert staged.dtypes == df.dtypes and staged.collect() == df.collect()
    assert cut_lineage(df.filter("a > 1")).count() == 0


def test_size_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 10 << 40) == 81920
        assert size_shuffles(spark, 1) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def orders(spark, path, rows=6000):
    """A tenth of the orders are those of person 0."""
    made = spark.range(rows).select(
        F.col("id").alias("o_orderkey"),
        F.expr("if(id % 10 = 3, 10, id % 997 * 10 + 1 + id % 9)").alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        (F.col("id") * 1.25).alias("o_totalprice"),
        F.expr("timestamp_ntz '2000-01-01' + make_dt_interval(cast(id * 7919 % 1500 as int))").alias("o_orderdate"),
        F.expr("if(id % 4 = 3, '1-URGENT', '5-LOW')").alias("o_orderpriority"),
    )
    made.write.parquet(f"{path}/orders.parquet")
    return str(path)


def shuffled(df):
    """Rows that the exchanges of a collected table wrote."""
    def rows(node):
        kind = node.getClass().getSimpleName()
        if kind == "ReusedExchangeExec":
            return 0
        if kind == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return rows(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(rows(children.apply(i)) for i in range(children.size()))

    return rows(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("floor, most", [(10**9, 10_000), (100, 18_000)])
def test_window_event_rows_shuffle_an_ordinary_claim_once(spark, tmp_path, monkeypatch, floor, most):
    """Windows, stays and the meeting with events share a shuffle; large persons go apart."""
    at = orders(spark, tmp_path)
    counted = claim_checks.large_persons(spark, at, floor)
    assert (counted is None) == (floor == 10**9)
    monkeypatch.setattr(claim_checks, "large_persons", lambda *_: counted)
    found = claim_checks.window_event_rows(spark, at)
    assert difference(found, entry.oracle_sql()["window_event_rows"], at) is None
    assert 0 < len(found.collect()) and shuffled(found) <= most


def test_keys_are_counted_behind_a_sieve(spark):
    keys = spark.range(5000).select(F.expr("if(id % 7 = 0, null, if(id % 5 = 0, -1, id))").alias("k"))
    plain, sieved = (hot_keys(keys, ["k"], 500, sieve) for sieve in (False, True))
    want = {(None, 715), (-1, 857)}
    assert {tuple(r) for r in plain.table.collect()} == want == {tuple(r) for r in sieved.table.collect()}
    assert hot_keys(keys, ["k"], 900, True) is None


def test_event_rows_leave_dealt_entities_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = spark.range(1000).select((F.col("id") % 300).alias("k"), F.lit(dt.date(2024, 1, 1)).alias("day")).groupBy("k").agg(F.min("day").alias("day"))
        events = spark.range(3000).select((F.col("id") % 300).alias("k"), F.lit(dt.date(2024, 1, 1)).alias("day"), "id")
        found = event_rows(dealt, events, "k", "day", "day", 0, 60)
        text = plan(found)
        assert shuffles(text) == 2 and "Generate" not in text
        assert found.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
