"""Shards of nearly equal bytes by sampled splitters.

Documents are ordered by a hash of their text, so copies are neighbours, then by key. A sample in
which a row's chance grows with its size gives splitters at equal weights; they cut the order in ranges
that fit in a task. A range that came out too full is sampled again and
subdivided; a group of copies that fills ranges on its own is cut inside, every other group
stays whole. Running sums within the ranges and the totals of the ranges then give
each document its exact place in the order, and a shard is a stretch of it.

A document counts in a range with its share of the bytes and its share of the rows, so neither many
short nor few long ones overfill it. Documents above 1/256 of a shard (at most 256 a shard, whatever
the input) are dealt out one by one first, the longest to the emptiest shard; stretches then fill
what is left. A shard is off its equal share by at most 1/256 unless one document exceeds a shard.
Groups of copies up to 1/256 of a shard are never divided.

Only the narrow rows (key, size, checksum) are staged and shuffled. The driver holds the splitters
(`MOST_RANGES`, and as many again for each subdivision), `SAMPLED` rows for each, a total a range, and
the dealt documents.

Rows: null text counts as empty; a null key orders first; rows alike in key and text are told apart by
their place in the staged table; fewer rows than shards leave shards empty; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careweft.session import cut_lineage

RANGE_ROWS, MOST_RANGES, SAMPLED = 2_000_000, 4096, 32
#: A document or group above this share of a shard may be dealt or divided.
PARTS = 256
ORDER = ["key", "tie", "row"]
LEAST = np.iinfo("i8").min


def narrow_rows(docs: DataFrame) -> DataFrame:
    """`doc_id`, `size`, `text_crc32` and the order: hash of the text, key, place."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(doc_id, F.lit(int(LEAST)).cast("long")).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )


def places(bounds: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """How many bounds are at or below each row, comparing column by column; bounds are sorted."""
    low, high = (np.searchsorted(bounds[0], rows[0], side) for side in ("left", "right"))
    if len(rows) == 1:
        return high
    tied = np.flatnonzero(low < high)
    out = low.copy()
    for first in np.unique(low[tied]):
        at = tied[low[tied] == first]
        last = high[at[0]]
        out[at] += places([b[first:last] for b in bounds[1:]], [r[at] for r in rows[1:]])
    return out


@dataclass
class Splitters:
    """Sorted (key, tie, row) at which ranges begin."""

    points: list[tuple[int, int, int]]

    @classmethod
    def of(cls, points) -> Splitters:
        """A key with one point is not cut: its range begins with the key."""
        met = Counter(p[0] for p in set(points))
        return cls(sorted({p if met[p[0]] > 1 else (p[0], LEAST, LEAST) for p in points} | {(k, LEAST, LEAST) for k in met}))

    def assign(self, rows: DataFrame) -> DataFrame:
        """Adds `range`, and `cut`: splitters stand inside the row's group."""
        bounds = list(np.array(self.points, "i8").reshape(-1, 3).T)
        met = Counter(p[0] for p in self.points)
        cut = np.array(sorted(k for k, n in met.items() if n > 1), "i8")
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = [batch.column(c).to_numpy() for c in ORDER]
                new = [pa.array(places(bounds, order), pa.int32()), pa.array(np.isin(order[0], cut))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "range", "cut"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{fields}, range int, cut boolean")


def draw(rows: DataFrame, rate: float, seed: int) -> list[tuple]:
    """(key, tie, row, weight) of rows drawn with a chance of `rate` times their weight, in order; the
    weight of a drawn row counts the ones it stands for. Drawn by hash: a task run again draws the same."""
    chance = F.shiftrightunsigned(F.xxhash64(*ORDER, F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = rows.filter(chance < F.col("weight") * rate).select(*ORDER, F.greatest("weight", F.lit(1 / rate)))
    return sorted(tuple(r) for r in drawn.collect())


def quantiles(sample: list[tuple], parts: int) -> list[tuple[int, int, int]]:
    """Rows that begin parts of equal weight, but for the first."""
    if parts < 2 or not sample:
        return []
    total = np.cumsum([s[3] for s in sample])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return [sample[i][:3] for i in np.unique(at)]


def split_ranges(rows: DataFrame, parts: int) -> tuple[Splitters, DataFrame]:
    """Splitters for about `parts` ranges, and `rows` with `range` and `cut`. `rows` has a `weight` of 1 in all and is stored:
    it is read for each subdivision."""
    rate = float(SAMPLED * parts)
    splitters, tries = Splitters.of(quantiles(draw(rows, rate, 0), parts)), 0
    while True:
        ranged, tries = splitters.assign(rows), tries + 1
        weights = ranged.groupBy("range").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        full = [r for r in weights.filter((F.col("weight") > 2 / parts) & (F.col("n") > 1)).collect()]
        if not full:
            return splitters, ranged
        inside = ranged.filter(F.col("range").isin([r["range"] for r in full]))
        points = list(splitters.points)
        found: dict[int, list] = {}
        sample = draw(inside, rate * tries, tries)
        named = places(list(np.array(splitters.points, "i8").reshape(-1, 3).T), list(np.array([s[:3] for s in sample], "i8").reshape(-1, 3).T))
        for one, s in zip(named, sample, strict=True):
            found.setdefault(int(one), []).append(s)
        for r in full:
            points += quantiles(found.get(r["range"], []), int(np.ceil(r["weight"] * parts)))
        finer = Splitters.of(points)
        if finer.points == splitters.points:
            return splitters, ranged  # one document alone is too large
        splitters = finer


def deal(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each size (in descending order), the emptiest first, and the loads."""
    heap, loads, out = [(0, s) for s in range(shards)], [0] * shards, []
    for size in sizes:
        load, shard = heapq.heappop(heap)
        out.append(shard)
        loads[shard] = load + size
        heapq.heappush(heap, (load + size, shard))
    return out, loads


def capacities(total: int, loads: list[int]) -> np.ndarray:
    """Where in the bytes of all dealt-out rows' rest each shard ends."""
    equal = (total + sum(loads)) / len(loads)
    left = np.maximum(0, equal - np.array(loads, "f8"))
    return np.cumsum(left) * (total / left.sum() if left.sum() else 0)


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """`doc_id`, `size` (UTF-8 bytes and 8), `text_crc32`, `shard` and `slot`, its place in the shard from 0 on."""
    spark = docs.sparkSession
    rows = cut_lineage(narrow_rows(docs))
    n, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    out = ["doc_id", "size", "text_crc32", "shard", "slot"]
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*out)
    whole = max(1, size // (shards * PARTS))
    large = sorted(rows.filter(F.col("size") > whole).select("size", *ORDER).collect(), key=lambda r: (-r["size"], *r[1:]))
    dealt, loads = deal([r["size"] for r in large], shards)

    light = rows.filter(F.col("size") <= whole).withColumn("weight", F.col("size") / (2.0 * size) + F.lit(0.5 / n))
    parts = min(MOST_RANGES, max(4 * shards, -(-n // RANGE_ROWS)))
    _, ranged = split_ranges(light, parts)
    in_range, in_group = Window.partitionBy("range").orderBy(*ORDER), Window.partitionBy("range", "key")
    before = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    numbered = ranged.withColumns({"before": before, "nth": F.row_number().over(in_range)})
    numbered = numbered.withColumns({"group_before": F.min("before").over(in_group), "group_size": F.sum("size").over(in_group)})
    alone = F.col("cut") | (F.col("group_size") > whole)
    # Twice the middle of what stays together, counted from the beginning of the range.
    middle = F.when(alone, 2 * F.col("before") + F.col("size")).otherwise(2 * F.col("group_before") + F.col("group_size"))
    placed = cut_lineage(numbered.select("doc_id", "size", "text_crc32", "range", "nth", middle.alias("middle")))

    totals = sorted(placed.groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect())
    sums = np.cumsum([(0, 0)] + [(r[1], r[2]) for r in totals], axis=0)
    offsets = [(r[0], int(b), int(c)) for r, (b, c) in zip(totals, sums[:-1], strict=True)]
    ends = capacities(int(sums[-1][0]), loads)[:-1]
    offset = F.broadcast(spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long"))
    at = 2 * F.col("bytes_before") + F.col("middle")
    passed = F.filter(F.array(*[F.lit(float(2 * e)) for e in ends]).cast("array<double>"), lambda end: end <= F.col("at"))
    stretched = (
        placed.join(offset, "range").withColumn("at", at)
        .withColumns({"shard": F.size(passed), "number": F.col("rows_before") + F.col("nth") - 1})
    )
    firsts = stretched.groupBy("shard").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    first = F.broadcast(spark.createDataFrame([(r["shard"], r["first"]) for r in firsts], "shard int, first long"))
    slots = stretched.join(first, "shard").withColumn("slot", F.col("number") - F.col("first")).select(*out)
    if not large:
        return slots
    used, named = {r["shard"]: r["n"] for r in firsts}, []
    for r, shard in zip(large, dealt, strict=True):
        named.append((r["row"], shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + 1
    own = F.broadcast(spark.createDataFrame(named, "row long, shard int, slot long"))
    return slots.unionByName(rows.filter(F.col("size") > whole).join(own, "row").select(*out))
