"""Branches of a search that may fail while they run.

A union is one job: one file that cannot be read ends all of it, and planning does not see such a file. Here
every branch is a job of its own, written below the shared folder, and what fails is a row
of a table instead of an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target

from careweft.plans.value_search import search_values
from careweft.functions.predicates import name_like
from careweft.session import staging_path

PROBLEMS = "branch string, error string, message string"
HITS = "table_name string, column_name string, column_value string, column_type string, row_count long"


def run_branches(
    spark: SparkSession, branches: Mapping[str, Callable[[], DataFrame]], schema: str, at_once: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Rows of all branches that ran, and a row (`branch`, `error`, `message`) for each that did not.

    A branch is planned and run inside its own job; a failed one leaves no rows. `at_once` branches run side by
    side, so small ones do not leave the cluster idle. Errors that are not Spark's own, such as an interrupt
    or a mistake in the calling code, are raised.
    """
    folders = {name: staging_path(spark, "branch") for name in branches}

    def run(name: str) -> tuple[str, str, str] | None:
        try:
            branches[name]().write.parquet(folders[name])
        except (PySparkException, Py4JJavaError) as error:
            kind = getattr(error, "getCondition", lambda: None)() or type(error).__name__
            return name, kind, str(error).split("\n", 1)[0]
        return None

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        failed = [f for f in pool.map(inheritable_thread_target(spark)(run), branches) if f]
    lost = {f[0] for f in failed}
    done = [folders[name] for name in branches if name not in lost]
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return rows, spark.createDataFrame(failed, PROBLEMS)


def search_each(
    spark: SparkSession,
    tables: Mapping[str, Callable[[], DataFrame]],
    pattern: str,
    table_like: str = "%",
    at_once: int = 4,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """`search_values` table by table: hits, and the tables that could not be searched.

    Tables are given as functions that read them, so that one that cannot even be opened is a
    problem of its own branch. Rows come in no order.
    """
    branches = {
        name: lambda name=name, read=read: search_values({name: read()}, pattern, **options)
        for name, read in tables.items()
        if name_like(name, table_like)
    }
    return run_branches(spark, branches, HITS, at_once)
