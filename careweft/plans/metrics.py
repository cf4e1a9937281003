"""Cost and event measures of episodes around their stay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweft.operators.intervals import (
    DayWindow,
    EventStream,
    events_in_window,
    windows_totals,
)
from careweft.operators.skew import AUTO, HotKeys, lookup_join
from careweft.session import cut_lineage


def stay_rollup(
    episodes: DataFrame, key: str, stay: str, begin: str, end: str
) -> DataFrame:
    """One row per stay."""
    return episodes.select(key, stay, begin, end).distinct()


def stays_with_event_before(
    stays: DataFrame, events: DataFrame, key: str, stay: str, begin: str, thru: str, days: int = 30,
    stage: bool = True,
) -> DataFrame:
    """Stays with an event that ended on or up to `days` days before the begin."""
    stays = cut_lineage(stays) if stage else stays
    return (
        events_in_window(stays, events, key, begin, thru, -days, 0, how="left_semi")
        .select(key, stay)
        .distinct()
    )


def stay_window_sum(
    stays: DataFrame,
    events: DataFrame,
    key: str,
    stay: str,
    anchor: str,
    event_date: str,
    amount: str,
    lo: int,
    hi: int,
    out: str = "stay_sum",
    stage: bool = True,
) -> DataFrame:
    """Amount of the events on [anchor+lo, anchor+hi], for stays that have any."""
    stays = cut_lineage(stays) if stage else stays
    found = events_in_window(
        stays, events, key, anchor, event_date, lo, hi, {out: amount}, "_n", how="inner"
    )
    return found.groupBy(key, stay).agg(F.sum(out).alias(out))


def episode_metrics(
    episodes: DataFrame,
    inpatient: DataFrame,
    emergency: DataFrame,
    key: str = "mbi",
    stay_end: str = "stay_end",
    stay_begin_dt: str = "stay_beg_dt",
    stay_end_dt: str = "stay_end_dt",
    episode_begin_dt: str = "epsd_beg_dt",
    home: str = "discharged_home",
    from_dt: str = "from_dt",
    thru_dt: str = "thru_dt",
    amount: str = "pmt",
    fill: int | None = None,
    labels: Mapping[str, str] | None = None,
    stage: bool = True,
    hot: HotKeys | None | object = AUTO,
) -> DataFrame:
    """Episode columns, the episode year and seven stay measures.

    The measures are set on the row of the stay's last episode and 0 elsewhere.
    A cost without a matching event is null there, or `fill`. The readmission
    cost asks for an inpatient event before the stay, the readmission flag for
    one after it; both ask for a discharge to home. `labels` renames columns.
    Episodes are read twice, for the windows and for the result; unless they
    are a stored table (`stage=False`) they are written once first. `hot`: keys with too many
    episodes for a task, if known.
    """
    if stage:
        episodes = cut_lineage(episodes)
    cost = {"sum": amount}
    totals = windows_totals(
        episodes,
        key,
        {
            "inpatient_from": EventStream(inpatient, from_dt, cost),
            "inpatient_thru": EventStream(inpatient, thru_dt),
            "emergency_from": EventStream(emergency, from_dt, cost),
        },
        [
            DayWindow("_before", "inpatient_thru", stay_begin_dt, -30, 0),
            DayWindow("_after", "inpatient_from", stay_begin_dt, 0, 60),
            DayWindow("_again", "inpatient_from", stay_end_dt, 2, 32),
            DayWindow("_emergency", "emergency_from", stay_begin_dt, 0, 60),
        ],
    )
    rows = lookup_join(episodes, totals, [key, stay_begin_dt, stay_end_dt], hot=None if hot is None else AUTO)
    last = F.col(stay_end) == 1
    at_home = last & (F.col(home) == 1)

    def has(name: str):
        return F.col(f"_{name}_count").isNotNull()

    def value(name: str):
        found = F.col(f"_{name}_sum")
        return found if fill is None else F.coalesce(found, F.lit(fill))

    def money(test, name: str):
        return F.when(test, value(name)).otherwise(F.lit(0))

    def flag(test):
        return F.when(test, F.lit(1)).otherwise(F.lit(0))

    result = rows.select(
        *episodes.columns,
        F.year(episode_begin_dt).alias("episode_year"),
        money(last, "after").alias("inpatient_cost_60d_after_start"),
        flag(last & has("after")).alias("inpatient_60d_after_start"),
        money(last, "emergency").alias("emergency_cost_60d_after_start"),
        flag(last & has("emergency")).alias("emergency_60d_after_start"),
        money(at_home & has("before"), "again").alias("readmission_cost_2_32d_after_end"),
        flag(last & has("before")).alias("inpatient_30d_before_start"),
        flag(at_home & has("again")).alias("readmission_2_32d_after_end"),
    )
    return result.withColumnsRenamed(dict(labels or {}))
