"""Delimited files as all-text tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careweft.functions.names import clean_columns
from careweft.sources.listing import list_files


def read_wide_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, clean: bool = False
) -> DataFrame:
    """CSV with a header, every column text: identifiers keep leading zeros.

    Doubled quotes inside quoted values are read as one. `multi_line` allows
    line breaks inside values; such files cannot be split between tasks.
    """
    df = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("inferSchema", False)
        .csv(path)
    )
    return clean_columns(df) if clean else df


def retype(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns by name; a value that does not fit becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()})


# Code page 1252 is Latin-1 but for these bytes; five of them have no character.
_LATIN1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = _LATIN1.encode("latin-1").decode("cp1252")


def read_delimited(
    spark: SparkSession,
    path: str,
    encoding: str = "windows-1252",
    quote: str | None = None,
    delimiter: str = ",",
    renames: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Delimited text in a code page, by default without any quoting.

    Spark reads only a few charsets; code page 1252 is read as Latin-1 and its
    27 other characters are put in place column by column.
    """
    cp1252 = encoding.lower() in ("windows-1252", "cp1252", "1252")
    df = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", "iso-8859-1" if cp1252 else encoding)
        .option("quote", quote or "")
        .option("inferSchema", False)
        .csv(path)
    )
    if cp1252:
        to_1252 = str.maketrans(_LATIN1, _CP1252)
        df = df.select(
            *[
                F.translate(F.col(f"`{c}`"), _LATIN1, _CP1252).alias(c.translate(to_1252))
                for c in df.columns
            ]
        )
    return retype(df.withColumnsRenamed(dict(renames or {})), types or {})


def marked_files(
    listing: DataFrame, marker: str = "_pfile_", prefix: str = ""
) -> DataFrame:
    """Files whose name holds the marker, with the table their rows belong to."""
    return listing.filter(F.col("name").contains(marker)).withColumn(
        "table_name", F.concat(F.lit(prefix), F.substring_index("name", marker, 1))
    )


def load_marked_files(
    spark: SparkSession,
    folder: str,
    marker: str = "_pfile_",
    prefix: str = "",
    reader: Callable[[SparkSession, list[str]], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """One all-text table with cleaned names per marked file group of a folder.

    Only the listing comes to the driver. All files of one table go into one
    reader, so their rows are scanned as one table.
    """
    reader = reader or (lambda s, paths: read_wide_csv(s, paths, clean=True))
    found = marked_files(list_files(spark, folder), marker, prefix)
    paths = defaultdict(list)
    for row in found.select("table_name", "path").orderBy("path").collect():
        paths[row["table_name"]].append(row["path"])
    return {name: reader(spark, files) for name, files in paths.items()}


