"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes matter through `SIZE` bytes only, and a pass looks at one digit: a string of
bytes at a fixed place of the window. Suffixes whose digit occurs once drop out at once, equal ones stay
together for the next pass. After the last pass a group's suffixes agree in all `SIZE` bytes:
the groups are the repeated windows.

1. First digit. Instead of one suffix per byte, the window's least `GRAM`-byte string by hash
   stands for it (all of them, if several are least). Equal windows choose the
   same string at the same offset, so a window can repeat only if the string it chose
   does. One or two places in a hundred are chosen.
2. Second digit: everything within a window's reach of a chosen place. Where that is equal, all windows
   over the place repeat and are settled together.
3. Last digit: places that agree in the first digit and differ in the second are compared
   window by window, offset by offset, one row per different surrounding. Rows of a first digit
   with more than `GROUP_ROWS` surroundings are counted by window instead, a row per
   window, so no group has to fit in a task.

Digits are compared as 64-bit hashes; two windows count as equal if the hashes of their chosen string
and of themselves are. Only places, never all windows, are shuffled.

Rows: null text counts as empty; texts shorter than a window lose nothing; matches never cross
rows; two rows that are alike are two documents; a null key stays; an empty table gives no rows;
extra columns are passed on by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from careweft.llm import rolling
from careweft.session import cut_lineage, discard

SIZE, GRAM = 200, 32
GROUP_ROWS, BATCH_ROWS = 12_000, 4096
OFFSETS = 32


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """`pick` over each `width` neighbours, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out, reach = pick(out[:-reach], out[reach:]), 2 * reach
    return pick(out[: len(values) - width + 1], out[width - reach :]) if reach < width else out


def chosen_places(data: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that stand for some window, hashes of their strings and of their surroundings."""
    n, reach = len(data), size - gram
    if n < size:
        return (np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "u8"))
    sums = rolling.prefix(data)
    at = np.arange(n - gram + 1)
    h = rolling.mix((sums[gram:] - sums[:-gram]) * rolling.powers(rolling._INVERSE, len(at)))
    least = sliding(h, reach + 1, np.minimum)
    padded = np.concatenate([np.zeros(reach, "u8"), least, np.zeros(reach, "u8")])
    places = at[sliding(padded, reach + 1, np.maximum) == h]
    starts, ends = np.maximum(places - reach, 0), np.minimum(places + size, n)
    around = rolling.mix(rolling.spans(sums, starts, ends) + (places - starts).astype("u8") * np.uint64(0x9E3779B97F4A7C15))
    return places, h[places], around


def _keyed(docs: DataFrame) -> DataFrame:
    """`rest` (the other columns), `text` and `row`, which tells documents of different
    key or text apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    return docs.select(rest, text, F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))


def places_of(keyed: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(gram, around, row, at) of all chosen places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for at in range(0, len(rows), 256):
                found = [chosen_places(np.frombuffer(t.as_py().encode(), "u1"), size, gram) for t in batch.column("text").slice(at, 256)]
                owner = np.repeat(rows[at : at + 256], [len(f[0]) for f in found])
                places, grams, around = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view("i8")), pa.array(around.view("i8")), pa.array(owner), pa.array(places.astype("i4"))], names=["gram", "around", "row", "at"]
                )

    return keyed.select("row", "text").mapInArrow(run, "gram long, around long, row long, at int")


def surroundings(keyed: DataFrame, wanted: DataFrame, size: int, gram: int) -> DataFrame:
    """`wanted` (gram, row, at, lone) with `left`, the number of bytes before the place, and
    `bytes`, those and `size` bytes from it on."""
    reach = size - gram
    per_row = wanted.repartition("row").groupBy("row").agg(F.collect_list(F.struct("gram", "at", "lone")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row, packed, asked in zip(*[batch.column(c) for c in ("row", "packed", "wanted")], strict=True):
                data, asked = expand(packed.as_py()), asked.as_py()
                parts = [data[max(0, a["at"] - reach) : a["at"] + size] for a in asked]
                columns = [
                    pa.array([a["gram"] for a in asked], pa.int64()),
                    pa.array([row.as_py()] * len(asked), pa.int64()),
                    pa.array([a["at"] for a in asked], pa.int32()),
                    pa.array([a["lone"] for a in asked], pa.bool_()),
                    pa.array([min(a["at"], reach) for a in asked], pa.int32()),
                    pa.array(parts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "row", "at", "lone", "left", "bytes"])

    # Equal rows come here twice; what stands around their places is settled already.
    joined = _packed(keyed).join(per_row, "row").select("row", "packed", "wanted")
    return joined.mapInArrow(run, "gram long, row long, at int, lone boolean, left int, bytes binary")


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts compressed, for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([squeeze(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("row"), packed], names=["rest", "row", "packed"])

    schema = StructType([keyed.schema["rest"], keyed.schema["row"], StructField("packed", BinaryType())])
    return keyed.select("rest", "row", "text").mapInArrow(run, schema)


def window_sums(left: np.ndarray, parts: list[bytes], size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of surroundings, their places in one column; first and end column of each."""
    reach = size - gram
    table, column = np.zeros((len(parts), reach + size), "u1"), np.arange(reach + size)
    first = reach - left[:, None]
    last = first + np.array([len(p) for p in parts])[:, None]
    table[(column >= first) & (column < last)] = np.frombuffer(b"".join(parts), "u1")
    return rolling.prefix(table), first, last


def window_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and offset x (the window starts x bytes before the place): its hash, and whether it
    lies in the text. Hashes compare within one offset."""
    starts = size - gram - offsets
    inside = (starts >= first) & (starts + size <= last)
    return rolling.mix(sums[:, starts + size] - sums[:, starts]), inside


def _runs(places: np.ndarray, repeated: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under the repeated windows, neighbours joined."""
    edge = np.zeros((len(repeated), 1), "i1")
    step = np.diff(np.concatenate([edge, repeated.astype("i1"), edge], axis=1), axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return row, places[row] - (high - 1), places[row] - low + size


def compare_surroundings(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(row, start, end) for rows of `surroundings` that stand alone with their surroundings.
    Rows with equal `gram` come together; a group is at most `GROUP_ROWS` rows."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        grams, owners, places, lone, left, parts = zip(*held, strict=True)
        places, lone = np.array(places, "i8"), np.array(lone)
        salt = (np.array(grams, "i8").view("u8") * np.uint64(0x9E3779B97F4A7C15))[:, None]
        repeated = np.zeros((len(held), size - gram + 1), bool)
        sums, first, last = window_sums(np.array(left), list(parts), size, gram)
        for low in range(0, size - gram + 1, OFFSETS):
            offsets = np.arange(low, min(low + OFFSETS, size - gram + 1))
            hashes, inside = window_hashes(sums, first, last, offsets, size, gram)
            hashes = rolling.mix(hashes ^ salt)
            order = np.argsort(hashes, axis=0, kind="stable")
            sorted_, valid = (np.take_along_axis(x, order, axis=0) for x in (hashes, inside))
            same = (sorted_[1:] == sorted_[:-1]) & valid[1:] & valid[:-1]
            twice = np.zeros_like(inside)
            twice[1:] |= same
            twice[:-1] |= same
            found = np.zeros_like(inside)
            np.put_along_axis(found, order, twice, axis=0)
            repeated[:, offsets] = found & lone[:, None]
        row, start, end = _runs(places, repeated, size)
        return pa.RecordBatch.from_arrays([pa.array(np.array(owners, "i8")[row]), pa.array(start), pa.array(end)], names=["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for item in zip(*[batch.column(c).to_pylist() for c in ("gram", "row", "at", "lone", "left", "bytes")], strict=True):
                if len(held) >= BATCH_ROWS and held[-1][0] != item[0]:
                    yield settle(held)
                    held = []
                held.append(item)
        if held:
            yield settle(held)

    dealt = rows.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "row long, start long, end long")


def count_windows(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """The same for rows of any number with equal `gram`: a row per window is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums, first, last = window_sums(batch.column("left").to_numpy(), batch.column("bytes").to_pylist(), size, gram)
            for low in range(0, size - gram + 1, OFFSETS):
                offsets = np.arange(low, min(low + OFFSETS, size - gram + 1))
                hashes, inside = window_hashes(sums, first, last, offsets, size, gram)
                row, at = np.nonzero(inside)
                columns = [
                    batch.column("gram").take(pa.array(row)),
                    pa.array(offsets[at].astype("i4")),
                    pa.array(hashes[row, at].view("i8")),
                    batch.column("row").take(pa.array(row)),
                    pa.array(batch.column("at").to_numpy()[row].astype("i8") - offsets[at]),
                    batch.column("lone").take(pa.array(row)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "offset", "window", "row", "start", "lone"])

    windows = rows.mapInArrow(run, "gram long, offset int, window long, row long, start long, lone boolean")
    key = ["gram", "offset", "window"]
    often = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return windows.filter("lone").join(often, key).select("row", "start", (F.col("start") + size).alias("end"))


def repeated_spans(keyed: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(row, span): spans whose union is every byte under a repeated window; a span
    is start * 2**32 + end, and its end may lie behind the text."""
    reach = size - gram
    places = cut_lineage(places_of(keyed, size, gram))
    first = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    first = first.filter("n > 1").select("gram", (F.col("low") == F.col("high")).alias("alike"))
    left_over = cut_lineage(places.join(first, "gram"))
    discard(places)
    mixed = left_over.filter(~F.col("alike"))
    one = F.struct("row", "at")
    second = cut_lineage(mixed.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")))
    settled = mixed.join(second.filter("n > 1").select("gram", "around"), ["gram", "around"]).select("row", "at")
    settled = left_over.filter("alike").select("row", "at").unionByName(settled)
    start, end = F.greatest(F.lit(0), F.col("at") - reach).cast("long"), F.col("at") + size
    whole = settled.select("row", (F.shiftleft(start, 32) + end).alias("span"))

    wanted = second.select("gram", F.col("one.row").alias("row"), F.col("one.at").alias("at"), (F.col("n") == 1).alias("lone"))
    around = cut_lineage(surroundings(keyed, wanted, size, gram))
    many = around.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS).select("gram")
    few = around.join(many, "gram", "left_anti")
    spans = compare_surroundings(few, size, gram).unionByName(count_windows(around.join(many, "gram", "left_semi"), size, gram))
    return whole.unionByName(spans.select("row", (F.shiftleft("start", 32) + F.col("end")).alias("span")))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    starts, reached = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reached[:-1]])
    last = np.concatenate([first[1:], [True]])
    return list(zip(starts[first].tolist(), reached[last].tolist(), strict=True))


def _cut(docs: DataFrame, size: int, gram: int, finish, types: dict[str, pa.DataType], schema: StructType) -> DataFrame:
    """`rest` and what `finish(bytes, removed runs)` gives for each row, as `schema` names it."""
    keyed = _keyed(docs)
    # Dealt out before they are listed: lists of one or two spans would be larger than the spans.
    spans = repeated_spans(keyed, size, gram).repartition("row").groupBy("row").agg(F.collect_list("span").alias("spans"))
    joined = _packed(keyed).join(spans, "row", "left").select("rest", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for packed, found in zip(batch.column("packed"), batch.column("spans"), strict=True):
                data, runs = expand(packed.as_py()), []
                if found.is_valid:
                    span = found.values.to_numpy()
                    runs = merged(span >> 32, np.minimum(span & 0xFFFFFFFF, len(data)))
                out.append(finish(data, runs))
            columns = [pa.array([row[i] for row in out], t) for i, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *columns], names=["rest", *types])

    return joined.mapInArrow(run, StructType([keyed.schema["rest"], *schema]))


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *[x for run in runs for x in run], len(data)]
    return b"".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))


def repeat_digests(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`."""

    def finish(data: bytes, runs: list[tuple[int, int]]) -> tuple:
        return len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()

    schema = StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    rows = _cut(docs.select("doc_id", "text"), size, gram, finish, types, schema)
    return rows.select("rest.doc_id", *types)


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, without the repeated bytes. A character that lost some
    of its bytes goes whole; `n_chars`, where there is such a column, is counted anew."""

    def finish(data: bytes, runs: list[tuple[int, int]]) -> tuple:
        return (kept_bytes(data, runs).decode("utf-8", "ignore"),)

    rows = _cut(docs, size, gram, finish, {"text": pa.string()}, StructType().add("text", "string"))
    columns = {c: F.col("rest").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[columns[c].alias(c) for c in docs.columns])
