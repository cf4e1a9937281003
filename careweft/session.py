"""Session defaults and the shared folder used for staged data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Applied only where the caller has not set the key.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "careweft", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`.

    Without the setting a local session gets a temporary folder; any other master
    raises, because its executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="careweft-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{staging_root(spark).rstrip('/')}/careweft/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once below the shared folder and go on from the written table.

    A lost executor then costs a read of the table, not the plan before it, and
    later steps read only the columns they need. A checkpoint would do as well
    but computes its last stage twice. The folder stays for as long as the result may be
    read lazily; `discard` removes it earlier, `discard_staged` all of a session's.
    """
    path = staging_path(df.sparkSession, "stage")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the folder of a table that `cut_lineage` gave and nothing reads any more."""
    _delete(table.sparkSession, table._staged_at)


def discard_staged(spark: SparkSession) -> None:
    """Remove everything staged below the shared folder; call it when all results of
    the sessions that share the folder have been written."""
    _delete(spark, f"{staging_root(spark).rstrip('/')}/careweft")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def size_shuffles(spark: SparkSession, input_bytes: int, per_task: int = 128 << 20) -> int:
    """Set the number of shuffle partitions for an input of this size.

    Windows and folds sort whole partitions, so these should fit in a task's
    memory. Too many is harmless: adaptive execution joins small ones.
    """
    wanted = max(spark.sparkContext.defaultParallelism, -(-input_bytes // per_task))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted
