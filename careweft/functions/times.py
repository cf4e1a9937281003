"""Epoch milliseconds as labelled local time."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from careweft.functions.predicates import as_column

# Hours behind UTC of the eight zone labels.
ZONE_HOURS = {
    "EST": 5, "CST": 6, "MST": 7, "PST": 8,
    "EDT": 4, "CDT": 5, "MDT": 6, "PDT": 7,
}
# Region behind the two labels of each zone.
REGIONS = {
    "America/New_York": ("EST", "EDT"),
    "America/Chicago": ("CST", "CDT"),
    "America/Denver": ("MST", "MDT"),
    "America/Los_Angeles": ("PST", "PDT"),
}


def stamp_text(column: Column | str) -> Column:
    """`yyyy-MM-dd HH:mm:ss`. Formatting functions would read a time without
    zone in the session's zone and move hours its clock skips."""
    return F.substring(as_column(column).cast("string"), 1, 19)


def eastern_label(now: datetime | None = None) -> str:
    """EDT while daylight saving holds on the US east coast at `now`, else EST."""
    zone = ZoneInfo("America/New_York")
    moment = now.astimezone(zone) if now else datetime.now(zone)
    return "EDT" if moment.dst() else "EST"


def _wall_clock(ms: Column, hours: Column | int) -> Column:
    """UTC milliseconds moved by whole hours, as text free of the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.floor(ms / 1000) - F.lit(3600) * hours
    moved = origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return stamp_text(moved)


def format_epoch_ms(column: Column | str, zone: str | None = None) -> Column:
    """Milliseconds as `yyyy-MM-dd HH:mm:ss ZZZ`.

    A three-letter zone is a fixed shift for every row; None is Eastern by the
    daylight saving rule of today; a region name follows the rule of each date.
    """
    ms = as_column(column)
    if zone is None:
        zone = eastern_label()
    if zone in ZONE_HOURS:
        return F.concat(_wall_clock(ms, ZONE_HOURS[zone]), F.lit(f" {zone}"))
    if zone in REGIONS:
        standard, daylight = REGIONS[zone]
        base = ZONE_HOURS[standard]
        utc = F.timestamp_millis(ms)
        local = F.from_utc_timestamp(utc, zone)
        behind = ((F.unix_millis(utc) - F.unix_millis(local)) / 3_600_000).cast("int")
        label = F.when(behind == base, F.lit(standard)).otherwise(F.lit(daylight))
        return F.concat(_wall_clock(ms, behind), F.lit(" "), label)
    raise ValueError(f"unknown time zone: {zone}")
