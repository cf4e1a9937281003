"""Signatures of table files, so that a value search reads only files that can hold its pattern.

A sidecar table says, for every file and column, which strings of three bytes occur in the lower-cased
values: one bit for each of the 2**24, in bitmaps of 4,096 bytes (`bitmap_bit_position` and `bitmap_or_agg` use the
same), of which only those with a bit set are stored. A value that holds a text holds
all strings of three bytes of it, so a file whose column lacks one of them holds no hit. Nothing is hashed:
a file is read in vain only where all the strings occur, but not in a row.

Files are known by path, size and time of change. A file that the sidecar does not know as it is now is read, and so
is every file for a column that it does not know and for patterns without three bytes between wildcards:
hits are never lost, whatever the state of the sidecar.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careweft.functions.predicates import name_like
from careweft.plans.value_search import search_values, searchable_columns
from careweft.sources.by_file import FILE, file_columns, listed_files, read_files, update_by_file

BITS, BLOCK = 1 << 15, 1 << 22
# Column types are all indexed; which are searched is up to the search.
EVERYTHING = {"nested": True, "floats": True, "dates": True, "booleans": True}
SCHEMA = "table_name string, file string, file_size long, changed timestamp, column_name string, bucket int, bits binary"


def literal_pieces(pattern: str) -> list[str]:
    """What stands between the wildcards `%`, `_` and `[set]` of a pattern, in lower case."""
    pieces, piece, i, text = [], "", 0, pattern.lower()
    while i < len(text):
        close = text.find("]", i + 2) if text[i] == "[" else -1
        if close > 0 or text[i] in "%_":
            pieces.append(piece)
            piece, i = "", max(close, i)
        else:
            piece += text[i]
        i += 1
    return [p for p in [*pieces, piece] if p]


def needed_strings(pattern: str) -> list[int]:
    """Numbers of the strings of three bytes that every match holds."""
    found = set()
    for piece in literal_pieces(pattern):
        b = piece.encode()
        found.update(b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2))
    return sorted(found)


def strings_in(values: pa.Array, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the strings of three bytes inside the values, however long. `seen`: 2**24 False, left so."""
    width = "i8" if pa.types.is_large_binary(values.type) else "i4"
    offsets = np.frombuffer(values.buffers()[1], width, len(values) + 1, np.dtype(width).itemsize * values.offset).astype("i8")
    if offsets[-1] - offsets[0] < 3:
        return np.zeros(0, "i8")
    data, ends = np.frombuffer(values.buffers()[2], "u1"), offsets[1:]
    for low in range(int(offsets[0]), int(offsets[-1]) - 2, BLOCK):
        block = data[low : min(low + BLOCK + 2, int(offsets[-1]))].astype("i4")
        numbers = block[:-2] << 16 | block[1:-1] << 8 | block[2:]
        # Not those that begin in the last two bytes of a value.
        inside = np.ones(len(numbers), bool)
        for back in (1, 2):
            last = ends - back - low
            inside[last[(last >= 0) & (last < len(numbers))]] = False
        seen[numbers[inside]] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def bitmaps(numbers: np.ndarray) -> dict[int, bytes]:
    """By bucket, the bits of numbers in it, lowest bit of the lowest byte first."""
    out, cut = {}, np.flatnonzero(np.diff(numbers // BITS)) + 1
    for part in np.split(numbers, cut):
        if len(part):
            bits = np.zeros(BITS, bool)
            bits[part % BITS] = True
            out[int(part[0]) // BITS] = np.packbits(bits, bitorder="little").tobytes()
    return out


def table_signatures(name: str, df: DataFrame) -> DataFrame:
    """Signatures of the files behind `df`, a table as it was read. One pass; bitmaps of a file are united over the tasks that
    read parts of it. A bucket of -1 says that file and column are known."""
    columns = searchable_columns(df, "0", **EVERYTHING)
    names = list(columns)
    texts = [F.lower(text).cast("binary").alias(f"c{i}") for i, text in enumerate(columns.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 24, bool)
        for batch in batches:
            file = batch.column("file").to_pylist()
            begin = 0
            while begin < len(file):
                end = begin
                while end < len(file) and file[end] == file[begin]:
                    end += 1
                part = batch.slice(begin, end - begin)
                rows = [(i, -1, None) for i in range(len(names))]
                for i in range(len(names)):
                    rows += [(i, bucket, bits) for bucket, bits in bitmaps(strings_in(part.column(f"c{i}"), seen)).items()]
                which, buckets, bits = zip(*rows, strict=True)
                of_file = [pa.repeat(part.column(c)[0], len(rows)) for c in FILE]
                new = [pa.array([names[i] for i in which], pa.string()), pa.array(buckets, pa.int32()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([*of_file, *new], names=[*FILE, "column_name", "bucket", "bits"])
                begin = end

    found = df.select(*file_columns(), *texts).mapInArrow(run, SCHEMA.replace("table_name string, ", ""))
    united = found.groupBy(*FILE, "column_name", "bucket").agg(F.bitmap_or_agg(F.coalesce("bits", F.lit(b""))).alias("bits"))
    bits = F.when(F.col("bucket") >= 0, F.col("bits")).alias("bits")
    return united.select(F.lit(name).alias("table_name"), *FILE, "column_name", "bucket", bits)


def update_signatures(spark: SparkSession, paths: Mapping[str, str], sidecar: str, fmt: str = "parquet") -> None:
    """Add the files that the sidecar at this path does not know as they are now; known files are not opened again."""
    update_by_file(spark, paths, sidecar, SCHEMA, table_signatures, fmt)


def _holds(numbers: list[int]) -> Column:
    """Whether `bits` has all these bits of its bucket."""
    masks: dict[int, int] = {}
    for number in numbers:
        place = number % BITS
        masks[place // 8] = masks.get(place // 8, 0) | 1 << place % 8
    test = F.lit(True)
    for byte, mask in masks.items():
        value = F.conv(F.hex(F.substring("bits", byte + 1, 1)), 16, 10).cast("int")
        test = test & (value.bitwiseAND(F.lit(mask)) == mask)
    return test


def files_to_read(
    spark: SparkSession,
    paths: Mapping[str, str],
    sidecar: DataFrame,
    pattern: str,
    table_like: str = "%",
    column_like: str = "%",
    fmt: str = "parquet",
    **types: bool,
) -> DataFrame:
    """A row per file of the matching tables: `table_name`, `location`, and whether it has to be `read`.

    Only bitmaps of the needed buckets are read from the sidecar, one row per file and column goes on.
    """
    needed: dict[int, list[int]] = {}
    for number in needed_strings(pattern):
        needed.setdefault(number // BITS, []).append(number)
    holds = F.lit(False)
    for bucket, numbers in needed.items():
        holds = holds | ((F.col("bucket") == bucket) & _holds(numbers))
    parts = []
    for name in sorted(paths):
        if not name_like(name, table_like):
            continue
        files = listed_files(spark, paths[name]).select(F.lit(name).alias("table_name"), "location", *FILE)
        columns = list(searchable_columns(spark.read.format(fmt).load(paths[name]), pattern, column_like, **types))
        if not needed:
            parts.append(files.select("table_name", "location", F.lit(bool(columns)).alias("read")))
            continue
        rows = sidecar.filter((F.col("table_name") == name) & F.col("column_name").isin(columns) & F.col("bucket").isin(-1, *needed))
        by_column = rows.groupBy(*FILE, "column_name").agg(
            F.count_distinct(F.when(holds, F.col("bucket"))).alias("held"), F.count_if(F.col("bucket") == -1).alias("known")
        )
        by_file = by_column.filter("known > 0").groupBy(*FILE).agg(
            F.max("held").alias("held"), F.count(F.lit(1)).alias("known")
        )
        # Not in the sidecar, or not with all of the columns: it may hold anything.
        read = F.coalesce((F.col("held") == len(needed)) | (F.col("known") < len(columns)), F.lit(True)) & F.lit(bool(columns))
        parts.append(files.join(by_file, FILE, "left").select("table_name", "location", read.alias("read")))
    if not parts:
        return spark.createDataFrame([], "table_name string, location string, read boolean")
    while len(parts) > 1:
        parts = [a if b is None else a.union(b) for a, b in zip(parts[::2], [*parts[1::2], None])]
    return parts[0]


def search_files(
    spark: SparkSession,
    paths: Mapping[str, str],
    sidecar: DataFrame,
    pattern: str,
    fmt: str = "parquet",
    **options,
) -> DataFrame:
    """`search_values` over tables at `paths`, reading only files that can hold the pattern.

    The paths of these files come to the driver, as those of any table that is read do.
    """
    chosen = {k: v for k, v in options.items() if k not in ("order", "shown")}
    files: dict[str, list[str]] = {}
    for r in files_to_read(spark, paths, sidecar, pattern, fmt=fmt, **chosen).filter("read").collect():
        files.setdefault(r["table_name"], []).append(r["location"])
    tables = {}
    for name, path in paths.items():
        whole = spark.read.format(fmt).load(path)
        tables[name] = read_files(spark, path, sorted(files[name]), whole, fmt) if name in files else spark.createDataFrame([], whole.schema)
    return search_values(tables, pattern, **options)
