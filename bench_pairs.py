"""Our form of an operation against the form it replaces: seconds and scans.

Both forms give the same rows (checked here). BENCH_SF_DIR and BENCH_CPUS as in
bench.py. Prints one JSON line per pair.
"""

from __future__ import annotations

import json
import os
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweft.checks import claims as claim_checks
from careweft.checks import discovery, provider as provider_checks
from careweft.checks.common import table
from careweft.functions.predicates import any_not_null, contains_text
from careweft.plans import episodes as ep
from careweft.plans import provider
from careweft.plans.profile import profile_table
from careweft.plans.value_search import search_values
from careweft.session import local_session, staging_path

RECURSIVE = """
WITH RECURSIVE walk AS (
  SELECT c.mbi, c.provider, c.seq, c.thru_dt, 1 AS stay_seq, 1 AS epsd_seq, c.days AS epsd_days
  FROM claims c LEFT ANTI JOIN claims p
    ON p.mbi = c.mbi AND p.provider = c.provider AND p.seq = c.seq - 1
   AND p.thru_dt >= date_add(c.from_dt, -61)
  UNION ALL
  SELECT c.mbi, c.provider, c.seq, c.thru_dt,
         CASE WHEN w.epsd_days + c.days > 60 THEN w.stay_seq + 1 ELSE w.stay_seq END,
         CASE WHEN w.epsd_days + c.days > 60 THEN 1 ELSE w.epsd_seq + 1 END,
         CASE WHEN w.epsd_days + c.days > 60 THEN c.days ELSE w.epsd_days + c.days END
  FROM walk w JOIN claims c
    ON w.mbi = c.mbi AND w.provider = c.provider AND w.seq = c.seq - 1
   AND w.thru_dt >= date_add(c.from_dt, -61))
SELECT mbi, seq, stay_seq, epsd_seq, epsd_days FROM walk
"""


def union_of_slots(wide: DataFrame, n: int) -> DataFrame:
    lead = "Other_Provider_Identifier_"
    parts = []
    for i in range(1, n + 1):
        columns = [F.col(f"{lead}{f}{i}") for f in ("", "Type_Code_", "State_", "Issuer_")]
        names = ["identifier", "identifier_type_code", "identifier_state", "identifier_issuer"]
        named = [c.alias(a) for c, a in zip(columns, names)]
        part = wide.filter(any_not_null(columns))
        number = F.lit(i).alias("identifier_number")
        parts.append(part.select(F.col("NPI").alias("npi"), number, *named))
    return reduce(DataFrame.unionAll, parts)


def self_join_counts(claims: DataFrame) -> DataFrame:
    claims.createOrReplaceTempView("claims")
    return claims.sparkSession.sql(
        """WITH run AS (SELECT mbi, seq, days,
                               sum(days) OVER (PARTITION BY mbi ORDER BY seq) AS upto FROM claims)
        SELECT a.mbi, a.seq, greatest(count(b.seq), 1) AS claim_count
        FROM run a LEFT JOIN run b
          ON b.mbi = a.mbi AND b.seq >= a.seq AND b.upto - (a.upto - a.days) <= 60
        GROUP BY a.mbi, a.seq"""
    )


def recursive_episodes(claims: DataFrame) -> DataFrame:
    claims.createOrReplaceTempView("claims")
    return claims.sparkSession.sql(RECURSIVE)


def profile_by_column(df: DataFrame) -> DataFrame:
    parts = []
    for i, name in enumerate(df.columns, 1):
        groups = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        one = groups.agg(
            F.count_if(F.col("n") == 1).alias("unique_count"),
            F.max("n").alias("mode_frequency"),
            F.min("n").alias("anti_mode_frequency"),
        )
        rest = df.agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_distinct(name).alias("distinct_count"),
            F.count_if(F.col(name).isNull()).alias("null_count"),
        )
        parts.append(rest.crossJoin(one).withColumn("ordinal_position", F.lit(i)))
    return reduce(DataFrame.unionByName, parts)


def search_by_column(tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    parts = []
    for name, df in tables.items():
        for f in df.schema.fields:
            if f.dataType.simpleString() == "string":
                hit = df.filter(contains_text(f.name, pattern)).select(
                    F.lit(name).alias("table_name"),
                    F.lit(f.name).alias("column_name"),
                    F.substring(f.name, 1, 4096).alias("column_value"),
                )
                parts.append(hit)
    stacked = reduce(DataFrame.unionAll, parts)
    return stacked.groupBy("table_name", "column_name", "column_value").agg(
        F.count(F.lit(1)).alias("row_count")
    )


def measure(make) -> dict:
    best, df = None, None
    for _ in range(2):
        start = time.perf_counter()
        df = make()
        df.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    return {
        "sec": round(best, 3),
        "scans": initial.count("FileScan"),
        "exchanges": initial.count("Exchange hashpartitioning"),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "careweft-pairs")
    spark.sparkContext.setLogLevel("ERROR")

    fields = {
        "Other_Provider_Identifier_{i}": "part",
        "Other_Provider_Identifier_Type_Code_{i}": "flag",
        "Other_Provider_Identifier_State_{i}": "status",
        "Other_Provider_Identifier_Issuer_{i}": "supp",
    }
    n = provider.IDENTIFIER_SLOTS
    path = staging_path(spark, "wide")
    provider_checks._renamed(
        provider_checks.wide_orders(spark, sf_dir), fields, n
    ).write.parquet(path)
    wide = spark.read.parquet(path)
    path = staging_path(spark, "claims")
    claim_checks.claims(spark, sf_dir).write.parquet(path)
    claims = spark.read.parquet(path)
    orders = table(spark, sf_dir, "orders")
    tables = discovery.frames(spark, sf_dir, discovery.SEARCHED)

    keys = ["mbi", "seq", "stay_seq", "epsd_seq", "epsd_days"]
    shown = [
        "ordinal_position", "total_count", "distinct_count", "unique_count", "null_count",
        "mode_frequency", "anti_mode_frequency",
    ]
    hits = ["table_name", "column_name", "column_value", "row_count"]
    pairs = {
        "slot_unpivot_50": (
            lambda: provider.provider_identifiers(wide), lambda: union_of_slots(wide, n), None
        ),
        "episodes_vs_recursive_sql": (
            lambda: ep.build_episodes(claims), lambda: recursive_episodes(claims), keys
        ),
        "claim_counts_vs_self_join": (
            lambda: ep.episode_claim_counts(claims, ["mbi"], "seq", "days"),
            lambda: self_join_counts(claims),
            ["mbi", "seq", "claim_count"],
        ),
        "profile_vs_per_column": (
            lambda: profile_table(orders), lambda: profile_by_column(orders), shown
        ),
        "value_search_vs_per_column": (
            lambda: search_values(tables, "in"), lambda: search_by_column(tables, "in"), hits
        ),
    }
    for name, (ours, other, columns) in pairs.items():
        a, b = ours(), other()
        columns = columns or sorted(a.columns)
        a, b = a.select(*columns), b.select(*columns)
        same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        print(
            json.dumps({"pair": name, "ours": measure(ours), "other": measure(other), "same": same}),
            flush=True,
        )
    spark.stop()


if __name__ == "__main__":
    main()
