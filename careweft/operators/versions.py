"""Latest version per key: what QUALIFY over a first value does elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careweft.operators.skew import AUTO, HOT_ROWS, HotKeys, hot_keys


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    version: str,
    floor: int = HOT_ROWS,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Rows whose version is the largest of their key; ties at the top all stay.

    The rank filter becomes a group limit that runs before the shuffle, so each
    task sends only its own top rows. Keys above the floor skip the window:
    their maxima fit in a broadcast and the rows are filtered in place. A row
    without a version is never equal to the latest one and goes.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())

    def ranked(part: DataFrame) -> DataFrame:
        kept = part.withColumn("_rank", F.rank().over(newest)).filter(F.col("_rank") == 1)
        return kept.filter(F.col(version).isNotNull()).drop("_rank")

    hot = hot_keys(df, keys, floor) if hot is AUTO else hot
    if hot is None:
        return ranked(df)
    rows = hot.hot_part(df)
    top = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max(version).alias("_top")
    )
    match = F.col(version) == F.col("_top")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    top = F.broadcast(top) if hot.small else top
    return ranked(hot.cold_part(df)).unionByName(rows.join(top, match, "left_semi"))
