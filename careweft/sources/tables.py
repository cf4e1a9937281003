"""Saved tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careweft.functions.names import quote_name


def replace_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    path: str | None = None,
) -> DataFrame:
    """Save as a managed table, replacing an older one, and read it back.

    With `path` the table's files go to that folder.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def table_from_query(spark: SparkSession, name: str, sql: str, fmt: str = "parquet") -> DataFrame:
    """`create or replace table … as select …`."""
    return replace_table(spark.sql(sql), name, fmt)


def load_tables(
    frames: dict[str, DataFrame], database: str | None = None, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Replace one table per entry, e.g. of `load_marked_files`."""
    lead = f"{quote_name(database)}." if database else ""
    return {n: replace_table(df, lead + quote_name(n), fmt) for n, df in frames.items()}


def create_view(spark: SparkSession, name: str, sql: str, comment: str = "") -> DataFrame:
    """Persistent view with a comment, which may span lines."""
    text = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {name} COMMENT '{text}' AS {sql}")
    return spark.table(name)
