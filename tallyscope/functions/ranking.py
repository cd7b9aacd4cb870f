"""Exact ranks, quantiles and top-share measures without a single-task global sort.

Every helper first collapses equal values (map-side partial aggregation), cuts the value range into a fixed
number of bins, finds by a running count over the bins which bin holds the wanted rank, and only
then orders the values inside that one bin.  No task sees more than one bin of one group, and a value that is
held by a third of all rows is one pre-aggregated row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def _bin(v: Column, lo: Column, hi: Column, curved: bool = True) -> Column:
    """Number of one of BINS ranges between lo and hi, monotone in v.

    Curved ranges are of equal width on the scale of sign * asinh(|v|): linear around zero and logarithmic beyond, so that
    an outlier, however far, does not push all other values into one range.  Uniform values take plain ranges.
    """
    def scale(x: Column) -> Column:
        return F.signum(x) * F.asinh(F.abs(x)) if curved else x.cast("double")

    width = (scale(hi) - scale(lo)) / BINS
    at = F.floor((scale(v) - scale(lo)) / width)
    return F.when(width > 0, F.greatest(F.lit(0), F.least(at, F.lit(BINS - 1)))).otherwise(F.lit(0)).cast("int")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """First `n` rows per group.  Catalyst turns the rank filter into a map-side WindowGroupLimit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("int")).filter(F.col(rank) <= n)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], disc: Mapping[str, float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles per group, one column per entry: `probs` interpolate linearly, `disc` pick an existing value.

    NULL values are ignored; groups without values are absent.  `by` may be empty (one row, none without values).
    With `weight` a row stands for that many equal ones.
    """
    keys = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.sum(F.col(weight) if weight else F.lit(1).cast("bigint")).alias("_n"))
    )
    ends = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total")]
    if keys:
        spanned = counts.join(counts.groupBy(*keys).agg(*ends), keys)
    else:  # one row for all: a scalar beside every value instead of a join on a constant
        spanned = counts.withColumn("_s", counts.agg(F.struct(*ends)).scalar()).select("*", "_s.*").drop("_s")
    binned = spanned.withColumn("_bin", _bin(F.col("_v"), F.col("_lo"), F.col("_hi")))
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    # A group has at most BINS rows here, whatever its size.
    offsets = per_bin.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(p)

    def disc_rank(p: float) -> Column:
        return F.greatest(F.ceil(F.col("_total") * F.lit(p)) - 1, F.lit(0))

    needed = [rank for p in probs.values() for rank in (F.floor(position(p)), F.ceil(position(p)))]
    needed += [disc_rank(p) for p in (disc or {}).values()]
    hit = None
    for rank in needed:
        inside = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bn"))
        hit = inside if hit is None else hit | inside
    wanted = offsets.filter(hit).select(*keys, "_bin", "_before")
    running = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    # Without keys the bins wanted are two per quantile at most.
    ranked = binned.join(wanted if keys else F.broadcast(wanted), [*keys, "_bin"]).withColumn("_end", F.col("_before") + F.sum("_n").over(running))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        aggs += [at(F.floor(position(p))).alias(f"_f_{name}"), at(F.ceil(position(p))).alias(f"_c_{name}")]
    aggs += [at(disc_rank(p)).alias(name) for name, p in (disc or {}).items()]
    picked = ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *aggs).filter("_total IS NOT NULL")
    cols = [F.col(name) for name in disc or {}]
    for name, p in probs.items():
        frac = position(p) - F.floor(position(p))
        lo, hi = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return picked.select(*by, *cols)


def top_fraction_sum(df: DataFrame, by: Sequence[str], value: str, fraction: float) -> DataFrame:
    """Sum of the largest floor(fraction*n) (at least one) integer values per group, and the total.

    Ties cannot change the sum, so the histogram of values is enough.  With non-negative integers adding up to
    T there are at most sqrt(2T) distinct values, which bounds the histogram of one group.
    """
    keys = list(by)
    hist = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = [F.sum("_n").alias("_rows"), F.sum(F.col("_v") * F.col("_n")).alias("total")]
    if keys:
        sized = hist.join(hist.groupBy(*keys).agg(*ends), keys)
    else:
        sized = hist.withColumn("_s", hist.agg(F.struct(*ends)).scalar()).select("*", "_s.*").drop("_s")
    take = F.greatest(F.lit(1), F.floor(F.col("_rows") * F.lit(fraction))).cast("bigint")
    desc = Window.partitionBy(*keys).orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    used = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_take") - F.col("_above")))
    return (
        sized.withColumn("_take", take).withColumn("_above", F.coalesce(F.sum("_n").over(desc), F.lit(0)))
        .groupBy(*keys, "total")
        .agg(F.sum(F.col("_v") * used).alias("top_total"))
        .select(*by, "total", "top_total")
    )


def _at_ranks(counts: DataFrame, wanted: DataFrame, curved: bool) -> DataFrame:
    """(i, at, before): the value at each wanted rank and the rows before that value.

    counts: (g, _v, _n), one row per group and value; wanted: (g, i, rank), a few rows, 0-based ranks within the group.
    """
    span = counts.groupBy("g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # One row per group of `wanted` on either side of these joins.
    binned = counts.join(F.broadcast(span), "g").withColumn("_bin", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), curved))
    per_bin = binned.groupBy("g", "_bin").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy("g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_bn"))
    hit = offsets.join(F.broadcast(wanted), "g").filter(inside).select("g", "i", "rank", "_bin", "_before")
    running = Window.partitionBy("i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(F.broadcast(hit), ["g", "_bin"]).withColumn("_end", F.col("_before") + F.sum("_n").over(running))
    here = (F.col("rank") >= F.col("_end") - F.col("_n")) & (F.col("rank") < F.col("_end"))
    return ranked.filter(here).select("i", F.col("_v").alias("at"), (F.col("_end") - F.col("_n")).alias("before"))


def ntile(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """`df` with `tile` = NTILE(n) OVER (ORDER BY value, tie); rows without value are left out.

    `tie` is a uniform whole number (a row hash), so that the rows sharing one value, however many, spread evenly over
    the bins.  The n-1 upper ends of the tiles are found by rank, first among the values, then among the ties of the
    values found, and come to the rows as one scalar: no row moves for it, and no job runs before the result is asked for.
    """
    df = df.filter(F.col(value).isNotNull())
    per_value = df.groupBy(F.lit(0).alias("g"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows, i = F.col("_rows"), F.col("i")
    last = F.try_divide(rows - rows % n, F.lit(n)).cast("bigint") * i + F.least(i, rows % n) - 1  # 0-based, of tile i
    ends = per_value.groupBy("g").agg(F.sum("_n").alias("_rows")).select(
        "g", "_rows", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("i")).select("g", "i", last.alias("rank"))
    at_value = _at_ranks(per_value, ends.filter("rank >= 0"), True).join(ends, "i").select(
        i.alias("g"), "i", "at", (F.col("rank") - F.col("before")).alias("rank"))
    ties = df.select(F.col(value).cast("double").alias("at"), F.col(tie).alias("_v")).join(F.broadcast(at_value.select("g", "at")), "at")
    ties = ties.groupBy("g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = _at_ranks(ties, at_value.select("g", "i", "rank"), False).select("i", F.col("at").alias("tie_at"))
    cuts = cuts.join(at_value.select("i", "at"), "i").agg(F.collect_list(F.struct("at", "tie_at"))).scalar()
    v, t = F.col(value), F.col(tie)
    beyond = F.filter("_cuts", lambda c: (v > c["at"]) | ((v == c["at"]) & (t > c["tie_at"])))
    return df.withColumn("_cuts", cuts).withColumn("tile", 1 + F.size(beyond)).drop("_cuts")
