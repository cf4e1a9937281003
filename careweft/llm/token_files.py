"""Token-id files: fixed-width bit packing with block offsets.

A file holds whole documents in ascending key order. Layout, all little-endian:

    8 bytes   magic
    6 x u64   bits per id, documents, ids, documents without a key, ids per block, blocks
    i64 x documents   keys (0 where there is none; those come first)
    u64 x documents   end of each document, in ids from the start of the file
    u64 x blocks      first byte of each block, from the start of the file
    blocks            each id in `bits` bits, lowest bit first; the last block is
                      filled up to a multiple of eight ids

Eight ids take exactly `bits` bytes, so a block unpacks with a few numpy
operations, and any id range is read from its blocks alone (`read_range`).

Files are written by tasks under a temporary name and renamed, with names that
depend on the task only: a task that runs again replaces its own files.

Rows: null text counts as empty and still gets its end id; documents without a key
come first; repeated keys and rows are all written, in text order; an empty table
writes no file; extra columns are ignored. A file holds about `ids_per_file`
ids, more only where a single document does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careweft.llm.words import library_encoder

MAGIC = b"IDPACK01"
BLOCK_IDS = 4096
IDS_PER_FILE = 1 << 22
SUFFIX = ".ids"


def width_for(vocabulary: int) -> int:
    """Fewest bits that tell `vocabulary` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} does not fit in {width} bits")
    rows = np.zeros((-(-len(ids) // 8), 8), "<u8")
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), width + 8), "u1")
    for j in range(8):
        first, shift = divmod(j * width, 8)
        spread = (rows[:, j] << np.uint64(shift)).astype("<u8").view("u1").reshape(-1, 8)
        n = (shift + width + 7) // 8
        out[:, first : first + n] |= spread[:, :n]
    return np.ascontiguousarray(out[:, :width]).tobytes()


def unpack(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    rows = np.frombuffer(data, "u1").reshape(-1, width)
    padded = np.zeros((len(rows), width + 8), "u1")
    padded[:, :width] = rows
    out, mask = np.empty((len(rows), 8), "<u4"), np.uint64((1 << width) - 1)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        word = np.ascontiguousarray(padded[:, first : first + 8]).view("<u8")[:, 0]
        out[:, j] = (word >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


def build_file(keys: list[int | None], packed_ids: list[bytes], width: int) -> bytes:
    ids = np.frombuffer(b"".join(packed_ids), "<u4")
    ends = np.cumsum([len(p) // 4 for p in packed_ids], dtype="<u8")
    n_blocks = -(-len(ids) // BLOCK_IDS)
    body = pack(ids, width)
    before = len(MAGIC) + 48 + 16 * len(keys) + 8 * n_blocks
    offsets = before + np.arange(n_blocks, dtype="<u8") * (BLOCK_IDS // 8 * width)
    counts = (width, len(keys), len(ids), sum(k is None for k in keys), BLOCK_IDS, n_blocks)
    return b"".join(
        [MAGIC, np.array(counts, "<u8").tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), ends.tobytes(), offsets.astype("<u8").tobytes(), body]
    )


class TokenFile:
    """Reads a file through `read(first byte, number of bytes)`, so that only what
    is asked for has to come from storage."""

    def __init__(self, read):
        self.read = read
        head = read(0, len(MAGIC) + 48)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-id file")
        self.width, n_docs, self.n_ids, self.n_nulls, self.block, n_blocks = np.frombuffer(head[len(MAGIC) :], "<u8").tolist()
        at = len(MAGIC) + 48
        table = read(at, 16 * n_docs + 8 * n_blocks)
        self.keys = np.frombuffer(table, "<i8", n_docs)
        self.ends = np.frombuffer(table, "<u8", n_docs, 8 * n_docs).astype("i8")
        self.offsets = np.frombuffer(table, "<u8", n_blocks, 16 * n_docs).astype("i8")

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from `start` on, from the blocks that hold them."""
        start, stop = max(0, start), min(self.n_ids, start + count)
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        held = min(self.n_ids, (last + 1) * self.block) - first * self.block
        data = self.read(int(self.offsets[first]), -(-held // 8) * self.width)
        return unpack(data, held, self.width)[start - first * self.block : stop - first * self.block]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def read_range(uri: str, start: int, count: int) -> np.ndarray:
    """Random access to one file: header, tables and the needed blocks are read."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        return TokenFile(lambda at, n: f.read_at(n, at)).ids(start, count)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, ids_per_file: int = IDS_PER_FILE) -> None:
    """Encodes `doc_id`, `text` and writes the files below `folder`, a new folder
    that all executors can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = library_encoder(tokenizer_path), TaskContext.get()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        end, width = np.array([end_id], "<u4").tobytes(), width_for(max(encoder.vocabulary, end_id + 1))
        keys, packed, held, written = [], [], 0, 0

        def flush() -> None:
            nonlocal keys, packed, held, written
            name = f"{base}/part-{context.partitionId():06d}-{written:05d}{SUFFIX}"
            temporary = f"{base}/_{context.taskAttemptId()}-{written:05d}.tmp"
            with system.open_output_stream(temporary) as f:
                f.write(build_file(keys, packed, width))
            system.move(temporary, name)
            keys, packed, held, written = [], [], 0, written + 1

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts), strict=True):
                if keys and held + len(ids) // 4 >= ids_per_file:
                    flush()
                keys.append(key)
                packed.append(ids + end)
                held += len(ids) // 4 + 1
        if keys:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: `doc_id`, `start` (ids of all documents before it), `n_tokens`,
    `ids_crc32`, all read from the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                file = TokenFile(lambda at, n, data=data: data[at : at + n])
                ids = file.ids(0, file.n_ids).tobytes()
                ends = file.ends.tolist()
                starts = [0, *ends[:-1]]
                keys = [None] * file.n_nulls + file.keys[file.n_nulls :].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(keys), pa.string()),
                        pa.array(keys, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["file", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    schema = "file string, doc_id long, within long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true")
    rows = files.load(folder).select("path", "content").mapInArrow(load, schema)
    # One row per file; names rise with the keys.
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
