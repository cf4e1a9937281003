"""Finding keys too large for one task, and taking them apart.

A window or a grouped fold puts all rows of a key in one task. Every operator
here that needs one first asks `hot_keys`; rows of keys above the floor then
take another, split way, all others the plain one. Nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careweft.session import cut_lineage

# Rows of one key that a single task may sort.
HOT_ROWS = 5_000_000
# Rows in one range of a hot key.
CHUNK_ROWS = 2_000_000
# Largest number of key rows held by the driver or broadcast.
SMALL_ROWS = 50_000
# Hashes of keys that a sieve counts by.
PLACES = 1 << 16
# Count keys when the operator is called.
AUTO = object()


@dataclass(frozen=True)
class HotKeys:
    """Keys above the floor, with their row counts in `_n`.

    `alone`: the rows at hand are of these keys only, see `apart`.
    """

    keys: tuple[str, ...]
    table: DataFrame
    rows: int
    small: bool
    alone: bool = False

    def _named(self) -> DataFrame:
        named = self.table.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(self.keys)])
        return F.broadcast(named) if self.small else named

    def _match(self) -> Column:
        tests = [F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(self.keys)]
        return reduce(lambda a, b: a & b, tests)

    def cold_part(self, df: DataFrame) -> DataFrame:
        return df.join(self._named(), self._match(), "left_anti")

    def hot_part(self, df: DataFrame) -> DataFrame:
        return df.join(self._named(), self._match(), "left_semi")

    def named_as(self, *keys: str) -> HotKeys:
        """The same keys for a table that has them under other names."""
        return replace(self, keys=keys, table=self.table.toDF(*keys, "_n"))


def hot_keys(
    df: DataFrame, keys: Sequence[str], floor: int = HOT_ROWS, sieve: bool = False
) -> HotKeys | None:
    """Keys with more than `floor` rows, or None when there are none.

    One job over the key columns, counted map-side before the shuffle; at most
    50,001 keys come to the driver. Keys are always counted: no size estimate
    says how many rows a plan gives. Operators take the result as `hot`, so that
    a base table is counted once for all operators over its keys; None says
    that no key is large.

    `sieve` is for base tables with keys of few rows mostly: rows are counted by a hash of
    their keys first, and keys by themselves only where more than `floor` rows have the hash. The table is
    read twice and hardly a key is shuffled. Keys that are equal must have one hash (floats may not).
    """
    if sieve:
        place = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(PLACES))
        full = df.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > floor)
        places = [r["_place"] for r in full.collect()]
        if not places:
            return None
        df = df.filter(place.isin(places))
    counted = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > floor)
    )
    # With an order the limit is one job; a bare one would try partition after partition.
    head = counted.orderBy(F.col("_n").desc()).limit(SMALL_ROWS + 1).collect()
    if not head:
        return None
    if len(head) <= SMALL_ROWS:
        table = df.sparkSession.createDataFrame(head, counted.schema)
        return HotKeys(tuple(keys), table, sum(r["_n"] for r in head), True)
    table = cut_lineage(counted)
    total = table.agg(F.sum("_n").alias("n")).first()["n"]
    return HotKeys(tuple(keys), table, int(total), False)


def apart(df: DataFrame, hot: HotKeys | None) -> list[tuple[DataFrame, HotKeys | None]]:
    """Rows of ordinary keys, then those of large keys, each with the `hot` that operators take for them.

    A union does not tell how its rows are dealt out, so every operator behind one shuffles anew.
    Several operators in a row are better run on each part, and the results united: rows of
    ordinary keys then take one shuffle for all of them, as without large keys.
    """
    if hot is None or hot.alone:
        return [(df, hot)]
    return [(hot.cold_part(df), None), (hot.hot_part(df), replace(hot, alone=True))]


def ordered_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rows: int,
    chunk_rows: int = CHUNK_ROWS,
    name: str = "_chunk",
) -> tuple[DataFrame, int]:
    """Cut rows in contiguous ranges of (keys, order) of about `chunk_rows` rows.

    The range number is the partition of a range shuffle. It depends on sampled
    bounds, so the result is written out: each later use, and each task run
    again after a lost executor, sees the same ranges. `order` should be total;
    equal rows stay in one range.
    """
    parts = max(1, math.ceil(rows / chunk_rows))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(name, F.spark_partition_id())), parts


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    right_on: Sequence[str] | None = None,
    floor: int = HOT_ROWS,
    salts: int = 256,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Join rows to a lookup of about one row per key, for left keys of any size.

    Without large keys this is a plain join. Rows of large keys meet a
    broadcast of the few lookup rows they need and are not shuffled. If even
    the list of large keys is long, rows are spread by a salt and the lookup
    rows of large keys are repeated for each salt. Null keys match each other.
    The lookup's key columns are dropped. `how`: left, inner, left_semi or
    left_anti.
    """
    right_on = list(right_on or on)
    named = right.withColumnsRenamed({c: f"_r_{i}" for i, c in enumerate(right_on)})
    tests = [F.col(c).eqNullSafe(F.col(f"_r_{i}")) for i, c in enumerate(on)]
    match = reduce(lambda a, b: a & b, tests)
    extra = [f"_r_{i}" for i in range(len(on))]

    hot = hot_keys(left, on, floor) if hot is AUTO else hot
    if hot is None:
        return left.join(named, match, how).drop(*extra)
    keys = hot.named_as(*extra)
    needed = keys.hot_part(named)
    cold = hot.cold_part(left).join(keys.cold_part(named), match, how).drop(*extra)
    if hot.small:
        many = hot.hot_part(left).join(F.broadcast(needed), match, how)
    else:
        salted = hot.hot_part(left).withColumn(
            "_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
        )
        repeated = needed.withColumn(
            "_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        )
        many = salted.join(repeated, match & (F.col("_salt") == F.col("_rsalt")), how)
        extra = [*extra, "_salt", "_rsalt"]
    return cold.unionByName(many.drop(*extra))
