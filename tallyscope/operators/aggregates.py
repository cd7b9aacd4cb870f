"""Published aggregate tables over the panel: laddered cells, indices, shares and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.calendar import week_of
from tallyscope.functions.money import mean_money, ratio, sum_money
from tallyscope.functions.ranking import exact_quantiles
from tallyscope.operators.customers import CARD
from tallyscope.operators.privacy import K_FLOOR


def k_ladder(lines: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Cells of at least k lines at the finest grain that allows it; lines of thin cells pool one step coarser.

    subcategory x week -> category x week -> category x month -> suppressed.  The lines are read once; every
    further step works on the cells left over.
    """
    week = week_of(F.col("txn_ts"))
    cells = lines.groupBy("category", "subcategory", week.alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("units")
    ).withColumn("month", F.trunc("week", "month"))
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("date")
    sums = (F.sum("n").alias("n"), F.sum("units").alias("units"))
    left = cells.filter(F.col("n") < k)
    by_week = left.groupBy("category", "week", "month").agg(*sums)
    by_month = by_week.filter(F.col("n") < k).groupBy("category", "month").agg(*sums)
    cols = ["grain", "category", "subcategory", "period", "n", "units"]

    def out(df, grain, sub, period):
        return df.filter(F.col("n") >= k).select(
            F.lit(grain).alias("grain"), "category", sub.alias("subcategory"), period.alias("period"), "n", "units"
        ).select(*cols)

    kept = (
        out(cells, "subcategory_week", F.col("subcategory"), F.col("week"))
        .unionByName(out(by_week, "category_week", none_s, F.col("week")))
        .unionByName(out(by_month, "category_month", none_s, F.col("month")))
    )
    thin = by_month.filter(F.col("n") < k).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("units"), F.lit(0)).alias("units")
    )
    return kept.unionByName(thin.select(
        F.lit("suppressed").alias("grain"), none_s.alias("category"), none_s.alias("subcategory"),
        none_d.alias("period"), "n", "units",
    ))


def category_metrics(lines: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Per merchant, category and month: price, revenue and unit indices against the mean merchant, and the change.

    price_index = cell mean price / category mean price over the panel that month.
    """
    month = F.trunc(F.col("txn_ts"), "month").alias("month")
    cell = lines.groupBy("banner_code", "category", month).agg(
        F.count(F.lit(1)).alias("n_lines"), mean_money("unit_price").alias("price"), sum_money("unit_price").alias("_p"),
        sum_money("line_total").alias("revenue"), F.sum("qty").alias("units"),
    )
    market = cell.groupBy("category", "month").agg(
        (sum_money("_p") / F.sum("n_lines")).alias("mp"), (sum_money("revenue") / F.count(F.lit(1))).alias("mr"),
        (F.sum("units").cast("double") / F.count(F.lit(1))).alias("mu"),
    )
    # Group = one merchant's category over the months of the calendar.
    w = Window.partitionBy("banner_code", "category").orderBy("month")
    out = cell.join(market, ["category", "month"]).withColumn("_prev", F.lag("revenue").over(w))
    return out.filter(F.col("n_lines") >= k).select(
        "banner_code", "category", "month", "n_lines", ratio("price", "mp").alias("price_index"),
        ratio("revenue", "mr").alias("revenue_index"), ratio("units", "mu").alias("units_index"),
        (ratio("revenue", "_prev") - 1).alias("revenue_delta"),
    )


def payment_mix_by_zone_month(txns: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Share of each tender per merchant, neighborhood and month; shares of a kept cell add up to 1."""
    cell = ["banner_code", "neighborhood", "month"]
    counts = txns.groupBy("banner_code", "neighborhood", F.trunc(F.col("txn_ts"), "month").alias("month"), "tender").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy(*cell).agg(F.sum("n").alias("t")).filter(F.col("t") >= k)
    return counts.join(totals, cell).select(*cell, "tender", "n", ratio("n", "t").alias("share"))


def trade_area_share(lines: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """A merchant's share of each neighborhood's category sales; cells of k lines or more, shares over all merchants."""
    cell = lines.groupBy("neighborhood", "category", "banner_code").agg(
        F.count(F.lit(1)).alias("n"), sum_money("line_total").alias("sales")
    )
    zone = cell.groupBy("neighborhood", "category").agg(sum_money("sales").alias("t"), F.sum("n").alias("k"))
    return cell.join(zone.filter(F.col("k") >= k), ["neighborhood", "category"]).select(
        "neighborhood", "category", "banner_code", "sales", ratio("sales", "t").alias("share_of_zone")
    )


def cross_merchant_cohorts(txns: DataFrame, customers: DataFrame, k: int = K_FLOOR, col: str = "segment") -> DataFrame:
    """Per home zone and combination of merchants: cohort size, median and quartiles of spend, visit band; no means."""
    per = txns.groupBy(CARD).agg(
        F.array_join(F.array_sort(F.collect_set(col)), ",").alias("combination"),
        sum_money("subtotal").alias("spend"), F.count(F.lit(1)).alias("visits"),
    ).join(customers.select(CARD, "home_zone"), CARD)
    by: Sequence[str] = ("home_zone", "combination")
    size = per.groupBy(*by).agg(F.count(F.lit(1)).alias("cohort_size")).filter(F.col("cohort_size") >= k)
    spend = exact_quantiles(per, by, "spend", {"p25_spend": 0.25, "median_spend": 0.5, "p75_spend": 0.75})
    visits = exact_quantiles(per, by, "visits", {"v": 0.5})
    v = F.col("v")
    band = F.when(v < 10, "light").when(v < 40, "medium").otherwise("heavy")
    return size.join(spend, list(by)).join(visits, list(by)).withColumn("frequency_band", band).drop("v")


def behavioural_segments(txns: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Cards bucketed by observable frequency and basket (terciles), shares per merchant; no planted state is read."""
    per = txns.groupBy("banner_code", CARD).agg(
        F.count(F.lit(1)).alias("visits"), (sum_money("subtotal") / F.count(F.lit(1))).alias("basket")
    )
    cut_v = exact_quantiles(per, [], "visits", {"a": 1 / 3, "b": 2 / 3}).select(F.struct("a", "b")).scalar()
    cut_b = exact_quantiles(per, [], "basket", {"a": 1 / 3, "b": 2 / 3}).select(F.struct("a", "b")).scalar()

    def band(c, cut, names):
        return F.when(F.col(c) <= cut["a"], names[0]).when(F.col(c) <= cut["b"], names[1]).otherwise(names[2])

    seg = F.concat_ws("/", band("visits", cut_v, ["rare", "regular", "frequent"]), band("basket", cut_b, ["small", "mid", "large"]))
    counts = per.groupBy("banner_code", seg.alias("behaviour")).agg(F.count(F.lit(1)).alias("cards"))
    totals = counts.groupBy("banner_code").agg(F.sum("cards").alias("t"))
    return counts.join(totals, "banner_code").filter(F.col("cards") >= k).select(
        "banner_code", "behaviour", "cards", ratio("cards", "t").alias("share")
    )
