"""ZIP archives as rows of entries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_TYPE = "file_name string, content binary"
# Entries handed on together.
BATCH_BYTES = 16 << 20
BATCH_ENTRIES = 1_000


def zip_entries(df: DataFrame, content: str, keep: list[str] | None = None) -> DataFrame:
    """One row per file entry of each archive in a binary column.

    Entries that cannot be decoded have null content; an archive that cannot be
    opened gives one row with null name and content. Archives are opened one at
    a time and entries passed on in small batches, so a task never holds the
    contents of a whole archive. Directory entries give no row.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    schema = T.StructType(
        [*[df.schema[c] for c in keep], *T._parse_datatype_string(ENTRY_TYPE).fields]
    )

    def entries(data: bytes | None):
        if data is None:
            return
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError, ValueError):
            yield None, None
            return
        with archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                try:
                    yield info.filename, archive.read(info)
                except (zipfile.BadZipFile, OSError, ValueError, RuntimeError,
                        NotImplementedError, EOFError, zipfile.zlib.error):
                    yield info.filename, None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, archives = batch.select(keep), batch.column(len(keep))
            rows, names, bodies, size = [], [], [], 0

            def full() -> pa.RecordBatch:
                columns = [lead.column(c).take(pa.array(rows)) for c in range(len(keep))]
                columns += [pa.array(names, pa.string()), pa.array(bodies, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=[*keep, "file_name", "content"])

            for i, data in enumerate(archives):
                for name, body in entries(data.as_py()):
                    rows.append(i)
                    names.append(name)
                    bodies.append(body)
                    size += len(body or b"")
                    if size > BATCH_BYTES or len(rows) >= BATCH_ENTRIES:
                        yield full()
                        rows, names, bodies, size = [], [], [], 0
            if rows:
                yield full()

    return df.select(*keep, content).mapInArrow(unpack, schema)


def read_zip_entries(
    spark: SparkSession, path: str | list[str], pattern: str = "*.zip", recursive: bool = False
) -> DataFrame:
    """Entries of all ZIP files below a path: archive path, file name, content.

    One archive must fit in a task's memory (the reader's limit is 2 GB).
    """
    archives = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .load(path)
    )
    return zip_entries(archives.select(F.col("path").alias("archive"), "content"), "content")


def entry_lines(entries: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """Decoded lines of text entries, for entries small enough to split in place."""
    text = F.decode("content", encoding)
    keep = [c for c in entries.columns if c != "content"]
    lines = F.split(F.rtrim(text, F.lit("\r\n")), "\r\n|\n", -1)
    return entries.select(*keep, F.posexplode(lines).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    )
