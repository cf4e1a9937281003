"""File listings as tables, and what is done with them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careweft.functions.predicates import starts_with_any
from careweft.functions.times import format_epoch_ms

# Extension prefixes of the preset file groups.
FILE_GROUPS = {
    "sql": ["sql"],
    "excel": ["xl"],
    "powerpoint": ["pp"],
    "pdf": ["pdf"],
    "zip": ["zip", "7z"],
    "word": ["doc"],
    "script": ["bat", "cmd", "ps1"],
    "csv": ["csv"],
    "txt": ["txt"],
}


def list_files(
    spark: SparkSession,
    path: str | Sequence[str],
    zone: str | None = None,
    recursive: bool = False,
    pattern: str | None = None,
    label_times: bool = False,
) -> DataFrame:
    """Files below a path: path, name, size, modification time.

    The column list leaves the content out, so no file is opened. With
    `label_times` the time is text with a zone label, else epoch milliseconds.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path if isinstance(path, str) else list(path))
    millis = F.unix_millis("modificationTime")
    time = format_epoch_ms(millis, zone) if label_times else millis
    return found.select(
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("size"),
        time.alias("modification_time"),
    )


def staged_files(listing: DataFrame, archive: str) -> DataFrame:
    """Extracted data files: not the archive, no `.r` file, no file header."""
    name = F.col("name")
    return listing.filter(
        (name != archive) & ~name.endswith(".r") & ~name.contains("_fileheader")
    )


def tidy_inventory(
    listing: DataFrame,
    expand: Mapping[str, Sequence[str]] | None = None,
    drop: Sequence[str] = (),
    renames: Mapping[str, str] | None = None,
    types: Mapping[str, str] | None = None,
    strip: Mapping[str, str] | None = None,
    blank_unless: Mapping[str, Column] | None = None,
) -> DataFrame:
    """A raw listing as an inventory.

    Nested columns are expanded, others dropped, renamed and cast; fixed text is
    taken out of columns; a column is blanked where its condition fails.
    """
    expand = expand or {}
    df = listing.select(
        *[c for c in listing.columns if c not in expand],
        *[F.col(f"`{c}`")[f].alias(f) for c, fields in expand.items() for f in fields],
    )
    df = df.withColumns(
        {
            c: F.when(F.coalesce(test, F.lit(False)), F.col(f"`{c}`"))
            for c, test in (blank_unless or {}).items()
        }
    )
    df = df.drop(*drop).withColumnsRenamed(dict(renames or {}))
    df = df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items()})
    return df.withColumns(
        {c: F.replace(F.col(f"`{c}`"), F.lit(t), F.lit("")) for c, t in (strip or {}).items()}
    )


def combine_inventories(
    inventories: Iterable[DataFrame], required: str | None = "name"
) -> DataFrame:
    """Stack inventories by column name; rows without a name are dropped."""
    parts = list(inventories)
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return df.filter(F.col(required).isNotNull()) if required else df


def files_by_extensions(
    files: DataFrame,
    extensions: str | Sequence[str],
    extension: str = "extension",
    modified: str | None = "modified",
) -> DataFrame:
    """Files whose extension begins with one of the given, latest first.

    A leading dot may be left out and case does not matter. `modified=None`
    leaves the order to the caller and saves the sort.
    """
    wanted = [extensions] if isinstance(extensions, str) else list(extensions)
    dotted = [e if e.startswith(".") else f".{e}" for e in wanted]
    found = files.filter(starts_with_any(extension, dotted))
    return found.orderBy(F.col(modified).desc()) if modified else found


def extension_sort_key(extension: Column | str) -> Column:
    """Letters, then other characters, `D` and digit, `T` and digit, digits."""
    e = F.col(extension) if isinstance(extension, str) else extension
    first, second = F.substring(e, 2, 1), F.substring(e, 3, 1)
    digit = "^[0-9]$"
    rank = (
        F.when((F.length(e) > 2) & (first == "D") & second.rlike(digit), "2")
        .when((F.length(e) > 2) & (first == "T") & second.rlike(digit), "3")
        .when((F.length(e) > 1) & first.rlike(digit), "4")
        .when(F.lower(first).rlike("^[a-z]$"), "0")
        .otherwise("1")
    )
    return F.concat(rank, F.lower(e))


def distinct_extensions(files: DataFrame, extension: str = "extension") -> DataFrame:
    """Each extension once, with its sort key, in that order."""
    return (
        files.select(extension)
        .distinct()
        .withColumn("sort_key", extension_sort_key(extension))
        .orderBy("sort_key", extension)
    )
