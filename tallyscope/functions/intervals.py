"""Intervals of dates as disjoint segments, and facts that find the one running on their day by an ordered sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(intervals: DataFrame, keys: Sequence[str], payload: Sequence[str], order: Sequence[str | Column], start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(…keys, first, last, …payload): per key disjoint segments with the interval that wins in each, the largest by `order`.

    A NULL end is open, so is the last segment it gives; an interval without a start, or that ends before it, is none.
    There are at most two segments per interval, however long it runs.  What is held per key are its own intervals,
    which grow with the schedule and not with days or facts.
    """
    by = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    each = F.struct(*by, F.col(start).alias("_a"), F.col(end).alias("_z"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)])
    valid = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    held = valid.dropna(subset=list(keys)).groupBy(*keys).agg(F.collect_list(each).alias("_i"))
    turns = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform("_i", lambda i: F.array(i["_a"], F.date_add(i["_z"], 1)))))))

    def winner(day: Column) -> Column:
        return F.array_max(F.filter("_i", lambda i: (i["_a"] <= day) & (i["_z"].isNull() | (i["_z"] >= day))))

    cut = held.withColumn("_t", turns)
    parts = F.transform("_t", lambda d, n: F.struct(d.alias("first"), F.date_sub(F.get("_t", n + 1), 1).alias("last"), winner(d).alias("_w")))
    out = cut.select(*keys, F.inline(parts)).filter("_w IS NOT NULL")
    return out.select(*keys, "first", "last", *[F.col(f"_w._p{i}").alias(c) for i, c in enumerate(payload)])


def days_of(parts: DataFrame, day: str = "day") -> DataFrame:
    """Segments spread over their days; open ones have none behind their first."""
    last = F.coalesce("last", "first")
    return parts.withColumn(day, F.explode(F.sequence(F.col("first"), last, F.expr("interval 1 day")))).drop("first", "last")


def running(facts: DataFrame, parts: DataFrame, keys: Sequence[str], payload: Sequence[str], day: str = "day") -> DataFrame:
    """(…keys, day, …payload): for every key and day that `facts` have, what runs then.

    Days and segments of a key go in one order of dates, along which a running window carries the segment opened last.
    Facts are reduced to their distinct days first, so a key with a third of all facts has only its days here.
    """
    asked = facts.select(*keys, F.col(day).alias("_at")).distinct().withColumn("_kind", F.lit(1))
    opened = parts.select(*keys, F.col("first").alias("_at"), F.lit(0).alias("_kind"), F.struct("last", *payload).alias("_s"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(opened, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(order))
    live = (F.col("_kind") == 1) & F.col("_s").isNotNull() & (F.col("_s.last").isNull() | (F.col("_s.last") >= F.col("_at")))
    return both.filter(live).select(*keys, F.col("_at").alias(day), *[F.col(f"_s.{c}").alias(c) for c in payload])
