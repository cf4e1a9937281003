"""Tables that are replaced without a gap.

A version is written to a folder of its own beside the others. Only when it is whole, the public name, a view, is switched to it,
which is one step of the catalog. Readers meet the old rows or the new ones, never none; a write that fails leaves
the name as it was. Versions before the present one are kept, for queries that still read them and for going back.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from careweft.functions.names import quote_name


def _folder(spark: SparkSession, root: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def default_root(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('`', '')}.versions"


def versions_of(spark: SparkSession, name: str, root: str | None = None) -> list[str]:
    """Folders of whole versions, the oldest first. One is whole when its writer has marked it so."""
    place, fs = _folder(spark, root or default_root(spark, name))
    if not fs.exists(place):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(place) if s.isDirectory()]
    return sorted((f for f in found if _whole(spark, f)), key=lambda f: f.rsplit("/", 1)[-1])


def _whole(spark: SparkSession, folder: str) -> bool:
    place, fs = _folder(spark, f"{folder}/_WHOLE")
    return fs.exists(place)


def _switch(spark: SparkSession, name: str, fmt: str, folder: str) -> DataFrame:
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('version' = '{folder}') AS SELECT * FROM {fmt}.{quote_name(folder)}")
    return spark.table(name)


def current_version(spark: SparkSession, name: str) -> str | None:
    """Folder that the name stands for at present."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").filter("key = 'version'").collect()
    return rows[0]["value"] if rows else None


def publish(
    df: DataFrame, name: str, root: str | None = None, fmt: str = "parquet", keep: int = 1
) -> DataFrame:
    """Make `name` stand for the rows of `df`; they may come from `name` itself.

    Columns may change from version to version. Whole versions older than the `keep` before the present one are removed;
    so are remains of writes that began before it and never ended.
    """
    spark = df.sparkSession
    root = (root or default_root(spark, name)).rstrip("/")
    folder = f"{root}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.format(fmt).save(folder)
    place, fs = _folder(spark, f"{folder}/_WHOLE")
    fs.create(place).close()
    table = _switch(spark, name, fmt, folder)
    _clear(spark, name, root, keep)
    return table


def _clear(spark: SparkSession, name: str, root: str, keep: int) -> None:
    present = current_version(spark, name).rsplit("/", 1)[-1]
    older = [v for v in versions_of(spark, name, root) if v.rsplit("/", 1)[-1] < present]
    kept = {v.rsplit("/", 1)[-1] for v in older[len(older) - keep :]} if keep else set()
    place, fs = _folder(spark, root)
    for status in fs.listStatus(place):
        folder = status.getPath().getName()
        if folder < present and folder not in kept:
            fs.delete(status.getPath(), True)


def roll_back(spark: SparkSession, name: str, root: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Make `name` stand for the version before the present one."""
    present = (current_version(spark, name) or "").rsplit("/", 1)[-1]
    older = [v for v in versions_of(spark, name, root) if v.rsplit("/", 1)[-1] < present]
    if not older:
        raise ValueError(f"{name} has no earlier version")
    return _switch(spark, name, fmt, older[-1])
