"""Packing token sequences into as few bins as possible by minimum bin slack.

Only lengths matter for the plan, and there are at most `capacity` of them: the plan
is made from one count per length, whatever the number of pieces. For a
bin, the longest length left is set and a bitset subset-sum over the others finds the
fullest combination; that combination is taken as many times as the counts
allow, then the next one is sought. Pieces are numbered within their length
without gathering them (numbers per task, then running counts per length), and
the number tells bin and offset from the plan, which never exceeds a few
thousand combinations (`plan_rows` states the bound).

Rows: null text counts as empty and is a piece of the end id alone; repeated rows
and keys are packed one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careweft.llm.words import library_encoder
from careweft.session import cut_lineage


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination that comes closest to `room`, with few,
    long pieces. Bit b of a bitset: some combination is b long."""
    steps, bits = [], 1
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left > 0:
            take = min(batch, left)
            steps.append((bits, length, take))
            bits |= (bits << (length * take)) & mask
            left, batch = left - take, batch * 2
        if bits & goal:
            break
    at, used = bits.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, combination) for all pieces; `counts`: pieces by length."""
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        chosen = dict(fullest({n: c for n, c in others.items() if c}, capacity - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[n] // times for n, times in chosen.items())
        plan.append((bins, sorted(chosen.items(), reverse=True)))
        for n, times in chosen.items():
            left[n] -= times * bins
            if not left[n]:
                del left[n]
    return plan


def plan_rows(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length, rows (first piece, first bin, pieces a bin, offset in the bin).

    Every combination leaves fewer pieces of some length than it takes of it, and a length
    can fall so at most log2(capacity) times below what it takes: with capacity 1024 some 10,000
    combinations of at most 44 different lengths.
    """
    rows, first_bin, taken = {}, 0, {}
    for bins, chosen in plan:
        offset = 0
        for length, times in chosen:
            rows.setdefault(length, []).append((taken.get(length, 0), first_bin, times, offset))
            taken[length] = taken.get(length, 0) + bins * times
            offset += length * times
        first_bin += bins
    return {length: np.array(r, "i8") for length, r in rows.items()}


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Full pieces, before them what is left over."""
    full, rest = divmod(total, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Per piece: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, and its number `nth` among
    the pieces of its length in task `task`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        end, met = np.array([end_id], "<u4").tobytes(), {}
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts), strict=True):
                ids, start = ids + end, 0
                for piece, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    nth = met[length] = met.get(length, -1) + 1
                    rows.append((key, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, nth))
                    start += length
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with `length`, `task` and `nth` (0, 1, ... in
    each task and length). `pieces` must be a stored table: it is read twice."""
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length
    rows = plan_rows(plan_bins({r.length: r.n for r in totals}, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["length", "task"]).withColumn("nth", F.col("base") + F.col("nth")).drop("base", "task")
    kept = [c for c in numbered.columns if c != "nth"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.select(kept).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            bins, offsets = np.zeros(len(nth), "i8"), np.zeros(len(nth), "i8")
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                plan = rows[int(n)]
                first, first_bin, times, offset = plan[np.searchsorted(plan[:, 0], nth[at], side="right") - 1].T
                bin_of, place_of = np.divmod(nth[at] - first, times)
                bins[at], offsets[at] = first_bin + bin_of, offset + place_of * n
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(bins), pa.array(offsets)], names=[*kept, "sequence_id", "offset"]
            )

    return numbered.mapInArrow(place, f"{fields}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Cuts documents longer than `capacity` and packs all pieces."""
    return pack_pieces(cut_lineage(token_pieces(docs, tokenizer_path, end_id, capacity)), capacity)
