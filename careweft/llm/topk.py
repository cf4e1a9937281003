"""Exact top-k inner products with a vector-approximation file.

Vectors are stored in blocks of rows. A block of candidates is an approximation file: the cell of every component, one of
`2**bits` equal intervals between the dimension's least and greatest value in the block, a byte each, with where the cells of each
dimension start and how wide they are; the exact integers stand beside it. It is made once per block, before blocks meet. A
task takes one block of queries and one of candidates and scans the cells alone: their products with the queries, in single
precision, give each exact product up to an error bound that depends on the query, the cell widths and the rounding.
(A lookup table of partial products per dimension would give the same sums.) A
candidate whose upper bound is below the k-th best lower bound is out. Of the others
exact rows are read in falling order of their upper bounds until the k-th result beats every bound that is
left; `reads` tells how many. Each pair of blocks gives k rows a query at most, and the best k of them are kept.

The query set is stated (a divisor of the ids), so blocks of it meet all blocks of
candidates. Blocks are bounded (`QUERY_ROWS`, `CANDIDATE_ROWS`) and meet by explicit group
numbers, so the pairs spread over as many tasks as there are pairs. Nothing is sent to all
executors.

Rows: vectors that are null, empty or hold null, NaN or infinite components, and rows without
an id, take no part; rows of one id are candidates one by one, and queries that share
the k results of their id; vectors of different lengths do not meet; ties go to the smaller id; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 2048
CANDIDATE_ROWS = 4096
CELL_BITS = 6
MAX_TASKS = 100_000
CHUNK = 64


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """`vec_id`, `v`: floor(scale * x) of each component."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def narrow(values: np.ndarray) -> np.ndarray:
    """In the smallest signed integers that hold all values."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class Cells(NamedTuple):
    """The approximation of a block: cell numbers, and per dimension start and width."""

    number: np.ndarray
    low: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, exact: np.ndarray, bits: int = CELL_BITS) -> Cells:
        low, high = exact.min(axis=0).astype("f8"), exact.max(axis=0).astype("f8")
        width = (high - low) / (1 << bits)
        inner = np.where(width > 0, width, 1)
        return cls(np.minimum((exact - low) / inner, (1 << bits) - 1).astype("u1"), low, width)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with the cell centres (candidates x queries), and how far the exact
        product of each query can be from them."""
        queries = queries.astype("f8")
        size, most = np.abs(queries), float(self.number.max(initial=0))
        steps, base = queries * self.width, queries @ (self.low + self.width / 2)
        reach = most * np.abs(steps).sum(axis=1)
        kind = "f4" if reach.max(initial=0) < 1e37 else "f8"
        products = (self.number.astype(kind) @ steps.astype(kind).T).astype("f8") + base
        rounding = 2 * (self.number.shape[1] + 2) * float(np.finfo(kind).eps) * reach
        centres = np.maximum(np.abs(self.low), np.abs(self.low + self.width * (most + 1)))
        return products, size @ (self.width / 2) + rounding + 1e-9 * (size @ centres) + 1e-6


CELL_FIELDS = {"candidate_cells": pa.binary(), "candidate_low": pa.binary(), "candidate_width": pa.binary()}


def blocks(vectors: DataFrame, rows_per_block: int, name: str, approximate: bool = False) -> DataFrame:
    """Rows (dims, ids, matrix, its type): blocks of vectors of equal length as bytes, with their cells on request."""
    fields = {"dims": pa.int32(), f"{name}_ids": pa.binary(), f"{name}_rows": pa.binary(), f"{name}_type": pa.string()}
    fields |= CELL_FIELDS if approximate else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            sizes = lists.value_lengths().to_numpy()
            values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                for i in range(0, len(at), rows_per_block):
                    part = at[i : i + rows_per_block]
                    matrix = narrow(values[(ends[part] - dims)[:, None] + np.arange(dims)])
                    row = [int(dims), ids[part].astype("<i8").tobytes(), matrix.tobytes(), matrix.dtype.str]
                    row += [x.tobytes() for x in Cells.of(matrix)] if approximate else []
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, fields.values(), strict=True)], names=list(fields))

    kinds = {pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return vectors.mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in fields.items()))


def exact_products(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integers; by float arithmetic where that is exact."""
    most = float(np.abs(candidates).max(initial=0)) * float(np.abs(query).max(initial=0)) * candidates.shape[1]
    if most < 2**53:
        return (candidates.astype("f8") @ query.astype("f8")).astype("i8")
    return candidates @ query


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, exact: np.ndarray, cells: Cells, k: int) -> tuple[np.ndarray, ...]:
    """(place of the query, id, score) of the k best candidates of this block for each query, and how many exact rows
    each query has read."""
    products, error = cells.bounds(queries)
    n_read = np.zeros(len(query_ids), "i8")
    at, found_ids, found = [], [], []
    for q in range(len(query_ids)):
        centre = products[:, q]
        allowed = min(k + int((ids == query_ids[q]).sum()), len(ids))
        floor = np.partition(centre, len(ids) - allowed)[len(ids) - allowed] - error[q] if allowed else -np.inf
        left = np.flatnonzero(centre + error[q] >= floor)
        left = left[ids[left] != query_ids[q]]
        left = left[np.argsort(-centre[left], kind="stable")]
        scores, certain = np.zeros(0, "i8"), 0
        while certain < len(left):
            part = left[certain : certain + max(CHUNK, k)]
            scores = np.concatenate([scores, exact_products(exact[part].astype("i8"), queries[q])])
            certain += len(part)
            if len(scores) >= k and certain < len(left):
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                if kth > centre[left[certain]] + error[q]:
                    break
        n_read[q] = len(scores)
        best = np.lexsort((ids[left[: len(scores)]], -scores))[:k]
        at.append(np.full(len(best), q))
        found_ids.append(ids[left[best]])
        found.append(scores[best])
    return *(np.concatenate(x) if x else np.zeros(0, "i8") for x in (at, found_ids, found)), n_read


def block_pairs(rows: DataFrame, divisor: int, scale: int) -> DataFrame:
    """Every block of queries beside every block of candidates of the same length."""
    vectors = scaled(rows, scale)
    is_query = F.pmod("vec_id", F.lit(divisor)) == 0
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("queries")).first()
    query_groups, groups = (max(1, -(-n // size)) for n, size in ((sizes["queries"], QUERY_ROWS), (sizes["all"], CANDIDATE_ROWS)))
    tasks, keys = min(query_groups * groups, MAX_TASKS), ["dims", "query_group", "group"]

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = blocks(vectors.filter(is_query), QUERY_ROWS, "query")
    queries = queries.withColumn("query_group", F.pmod(F.xxhash64("query_ids"), F.lit(query_groups))).withColumn("group", numbers(groups))
    candidates = blocks(vectors, CANDIDATE_ROWS, "candidate", approximate=True)
    candidates = candidates.withColumn("group", F.pmod(F.xxhash64("candidate_ids"), F.lit(groups))).withColumn("query_group", numbers(query_groups))
    casts = {"group": F.col("group").cast("int"), "query_group": F.col("query_group").cast("int")}
    return candidates.withColumns(casts).repartition(tasks, *keys).join(queries.withColumns(casts).repartition(tasks, *keys), keys)


def search_blocks(row: dict, k: int) -> tuple[np.ndarray, ...]:
    """Of a pair of blocks: the ids of its queries, how many candidates it has, and what `search` gives."""
    ids, query_ids = (np.frombuffer(row[c], "<i8") for c in ("candidate_ids", "query_ids"))
    exact, queries = (np.frombuffer(row[f"{c}_rows"], row[f"{c}_type"]).reshape(-1, row["dims"]) for c in ("candidate", "query"))
    cells = Cells(np.frombuffer(row["candidate_cells"], "u1").reshape(exact.shape), *(np.frombuffer(row[f"candidate_{c}"], "f8") for c in ("low", "width")))
    return query_ids, len(ids), *search(query_ids, queries.astype("i8"), ids, exact, cells, k)


def reads(rows: DataFrame, divisor: int, k: int, scale: int) -> DataFrame:
    """`query_id`, `n_candidates`, `n_read`: over all blocks, rows scanned by their cells and exact rows read of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, n, *_, n_read = search_blocks(row, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(np.full(len(query_ids), n)), pa.array(n_read)], names=["query_id", "n", "read"])

    each = block_pairs(rows, divisor, scale).mapInArrow(run, "query_id long, n long, read long")
    return each.groupBy("query_id").agg(F.sum("n").alias("n_candidates"), F.sum("read").alias("n_read"))


def top_k(rows: DataFrame, divisor: int, k: int, scale: int) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` for the rows whose `vec_id` is divisible by
    `divisor`, against all rows but those of their own id, vectors of equal length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, _, at, found_ids, scores, _ = search_blocks(row, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(found_ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    found = block_pairs(rows, divisor, scale).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
