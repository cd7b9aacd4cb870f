"""Calendar columns: weeks, days of week, hour buckets, dayparts, pay cycle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_BUCKETS = 10
SUNDAY_FIRST = list(range(7))
# Hour bands of a trading day, both ends inclusive; any other hour is "late".
DAYPARTS = [("breakfast", 6, 10), ("midday", 11, 14), ("afternoon", 15, 17), ("dinner", 18, 21)]


def week_of(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def dow_sunday0(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1).cast("int")


def dow_monday0(ts: Column) -> Column:
    return F.weekday(ts).cast("int")


def hour_bucket(ts: Column, buckets: int = HOUR_BUCKETS) -> Column:
    """Coarse time of day: the day is cut into `buckets` equal parts."""
    return F.floor(F.hour(ts) * buckets / 24).cast("tinyint")


def daypart(hour: Column) -> Column:
    out = None
    for name, lo, hi in DAYPARTS:
        cond = hour.between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("late")


def in_hours(ts: Column, start: int, end: int) -> Column:
    """`start <= hour < end`; wraps over midnight when `start > end`."""
    h = F.hour(ts)
    return ((h >= start) & (h < end)) if start <= end else ((h >= start) | (h < end))


def pay_cycle(ts: Column) -> Column:
    d = F.dayofmonth(ts)
    return F.when(d <= 10, "early").when(d.between(15, 17), "mid").otherwise("late")


def stage_of(day: Column, stages: Iterable[tuple[str, dt.date, dt.date]], default: str | None = None) -> Column:
    """First stage whose inclusive date range holds `day`; a literal CASE, no join."""
    out = None
    for name, lo, hi in stages:
        cond = day.between(F.lit(lo), F.lit(hi))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))
