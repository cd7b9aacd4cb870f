"""Which weeks count, and their recent / baseline roles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.calendar import week_of

BASELINE_WEEKS = 4


def complete(week: Column, start: dt.date, end: dt.date) -> Column:
    """Does the week that starts on this Monday lie wholly in `[start, end]`?"""
    return (week >= F.lit(start)) & (F.date_add(week, 6) <= F.lit(end))


def complete_weeks(txns: DataFrame, start: dt.date, end: dt.date, ts: str = "txn_ts") -> DataFrame:
    """Mondays of the weeks with data that lie wholly in `[start, end]`."""
    near = txns.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end + dt.timedelta(days=1))))
    return near.select(week_of(F.col(ts)).alias("week")).distinct().filter(complete(F.col("week"), start, end))


def week_spine(spark, start: dt.date, end: dt.date) -> DataFrame:
    """All complete weeks of the calendar in `[start, end]`, with or without data."""
    monday = start + dt.timedelta(days=-start.weekday() % 7)
    days = F.explode(F.sequence(F.lit(monday), F.lit(max(end, monday)), F.expr("interval 7 days")))
    return spark.range(1).select(days.alias("week")).filter(complete(F.col("week"), start, end))


def recent_baseline_weeks(weeks: DataFrame, n_baseline: int = BASELINE_WEEKS) -> DataFrame:
    """`recent` = last week; `baseline` = the FIRST up to n weeks before it.

    The week list is calendar-sized, so it is folded into one row and exploded with roles.
    """
    listed = weeks.agg(F.sort_array(F.collect_set("week")).alias("w")).filter(F.size("w") > 0)
    last = F.element_at("w", -1)
    earlier = F.slice("w", 1, F.least(F.lit(n_baseline), F.size("w") - 1))
    roles = F.concat(
        F.transform(earlier, lambda x: F.struct(x.alias("week"), F.lit("baseline").alias("role"))),
        F.array(F.struct(last.alias("week"), F.lit("recent").alias("role"))),
    )
    return listed.select(F.inline(roles))
