"""What is known of a table file by file: side tables that grow with new files and never read old ones again.

A file is known by path, size and time of change; one that was written anew is another file.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = ["file", "file_size", "changed"]


def file_columns() -> list[Column]:
    """`FILE` of the rows of a table that was just read."""
    kept = zip(("file_path", "file_size", "file_modification_time"), FILE, strict=True)
    return [F.col(f"_metadata.{m}").alias(c) for m, c in kept]


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """`location` to read a file of a table by, and `FILE`; nothing is opened."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.col("path").alias("location"), *file_columns())


def read_files(spark: SparkSession, path: str, files: list[str], whole: DataFrame, fmt: str = "parquet") -> DataFrame:
    """These files of the table at `path`, with the columns of the `whole` table, partition columns too."""
    reader = spark.read.format(fmt).schema(whole.schema)
    # A table that is a single file has no folder to count its partitions from.
    single = len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rstrip("/").rsplit("/", 1)[-1]
    return (reader if single else reader.option("basePath", path)).load(files)


def update_by_file(
    spark: SparkSession,
    paths: Mapping[str, str],
    side: str,
    schema: str,
    describe: Callable[[str, DataFrame], DataFrame],
    fmt: str = "parquet",
) -> None:
    """Append `describe(name, rows)` of the files that the side table does not know to it.

    `schema` is that of the side table; it has `table_name` and `FILE`.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(side)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    old = spark.read.schema(schema).parquet(side) if there else spark.createDataFrame([], schema)
    for name, path in sorted(paths.items()):
        known = old.filter(F.col("table_name") == name).select(*FILE).distinct()
        new = listed_files(spark, path).join(known, FILE, "left_anti").select("location").collect()
        if new:
            part = read_files(spark, path, [r["location"] for r in new], spark.read.format(fmt).load(path), fmt)
            describe(name, part).write.mode("append").parquet(side)
