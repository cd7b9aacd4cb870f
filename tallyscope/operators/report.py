"""Report measures over the census: volumes, stages, profiles, catalogue."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.calendar import stage_of, week_of
from tallyscope.functions.money import mean_int, mean_money, ratio, sum_money
from tallyscope.functions.ranking import top_n

Stage = tuple[str, dt.date, dt.date]


def n_rows() -> Column:
    return F.count(F.lit(1))


def store_rollup(txns: DataFrame, factor: float = 365 / 90) -> DataFrame:
    return txns.groupBy("store_id", "banner_code", "segment").agg(
        sum_money("subtotal").alias("dollars"), n_rows().alias("txns"), mean_money("subtotal").alias("basket"),
        mean_int("n_lines").alias("items"), (sum_money("subtotal") * factor).alias("auv"),
    )


def weekly_volume(txns: DataFrame) -> DataFrame:
    return txns.groupBy(week_of(F.col("txn_ts")).alias("week")).agg(n_rows().alias("txns"))


def seasonal_index(lines: DataFrame, groups: Mapping[str, Sequence[str]], base: tuple[dt.date, dt.date],
                   event: tuple[dt.date, dt.date]) -> DataFrame:
    """Weekly units of each group of departments over its mean in the baseline weeks, and the peak in the event."""
    members = F.array(*[
        F.struct(F.lit(g).alias("series"), F.col("department").isin(*deps).alias("use")) for g, deps in groups.items()
    ])
    weekly = (
        lines.groupBy("department", week_of(F.col("txn_ts")).alias("week")).agg(F.sum("qty").alias("u"))
        .select("week", "u", F.inline(members)).filter("use")
        .groupBy("series", "week").agg(F.sum("u").alias("units"))
    )
    in_base = F.col("week").between(F.lit(base[0]), F.lit(base[1]))
    in_event = F.col("week").between(F.lit(event[0]), F.lit(event[1]))
    ref = weekly.groupBy("series").agg(
        mean_int("units", in_base).alias("b"), F.max(F.when(in_event, F.col("units"))).alias("p")
    )
    return weekly.join(ref, "series").select(
        "series", "week", "units", ratio("units", "b").alias("index"), ratio("p", "b").alias("event_peak")
    )


def hourly_distribution(txns: DataFrame, banners: Sequence[str]) -> DataFrame:
    """Counts by hour and banner with zeros, and the banner's share of its day (percent)."""
    spine = txns.sparkSession.range(24).select(
        F.col("id").cast("int").alias("hour"), F.explode(F.array(*[F.lit(b) for b in banners])).alias("banner_code")
    )
    counts = txns.filter(F.col("banner_code").isin(*banners)).groupBy("banner_code", F.hour("txn_ts").alias("hour")).agg(
        n_rows().alias("n")
    )
    totals = counts.groupBy("banner_code").agg(F.sum("n").alias("t"))
    full = spine.join(counts, ["hour", "banner_code"], "left").join(totals, "banner_code", "left")
    n = F.coalesce("n", F.lit(0))
    return full.select("hour", "banner_code", n.alias("n"), F.coalesce(ratio(n * 100, F.col("t")), F.lit(0.0)).alias("pct"))


def daily_volume_pivot(txns: DataFrame, banners: Sequence[str]) -> DataFrame:
    """Date by merchant counts, 0-filled.  The column list is given, so no extra pass discovers it."""
    day = F.col("txn_ts").cast("date").alias("date")
    return txns.groupBy(day).agg(*[F.count_if(F.col("banner_code") == b).alias(b) for b in banners])


def pay_cycle_daily_avg(txns: DataFrame, banners: Sequence[str]) -> DataFrame:
    """Mean transactions per day with data, by day-of-month bucket and merchant."""
    dom = F.dayofmonth("day")
    bucket = (F.when(dom <= 3, "1-3").when(dom.between(15, 17), "15-17").when(dom.between(11, 13), "11-13")
              .otherwise("other"))
    daily = txns.filter(F.col("banner_code").isin(*banners)).groupBy(
        "banner_code", F.col("txn_ts").cast("date").alias("day")
    ).agg(n_rows().alias("n"))
    return daily.groupBy(bucket.alias("bucket")).agg(
        *[F.coalesce(mean_int("n", F.col("banner_code") == b), F.lit(0.0)).alias(b) for b in banners]
    )


def merchant_profile(txns: DataFrame, payment: Sequence[str]) -> DataFrame:
    """Per merchant: stores, customers, transactions, lines, basket, ticket, payment mix (percent)."""
    mix = [(F.count_if(F.col("tender") == p) * 100 / n_rows()).alias(f"pct_{i + 1}") for i, p in enumerate(payment)]
    return txns.groupBy("banner_code").agg(
        F.count_distinct("store_id").alias("n_stores"), F.count_distinct("customer_token").alias("n_customers"),
        n_rows().alias("n_transactions"), F.sum("n_lines").alias("n_line_items"),
        mean_int("n_units").alias("avg_basket_size"), mean_money("subtotal").alias("avg_ticket"), *mix,
    )


def category_revenue_tree(lines: DataFrame) -> DataFrame:
    """Revenue and distinct products per category, with the revenue of each of its subcategories."""
    per = lines.groupBy("category", "subcategory", "sku").agg(sum_money("line_total").alias("r"))
    sub = per.groupBy("category", "subcategory").agg(sum_money("r").alias("sub_revenue"), n_rows().alias("k"))
    # A product has one subcategory, so distinct products add up.
    top = sub.groupBy("category").agg(sum_money("sub_revenue").alias("revenue"), F.sum("k").alias("sku_count"))
    return top.join(sub.drop("k"), "category")


def catalog_stats(products: DataFrame, by: str) -> DataFrame:
    return products.groupBy(by).agg(
        F.count_distinct("sku").alias("n_skus"), F.count_distinct("category").alias("n_categories"),
        F.count_distinct("subcategory").alias("n_subcategories"),
    )


def daily_txn_stats(txns: DataFrame) -> DataFrame:
    daily = txns.groupBy("banner_code", F.col("txn_ts").cast("date").alias("day")).agg(n_rows().alias("n"))
    return daily.groupBy("banner_code").agg(
        n_rows().alias("n_days"), mean_int("n").alias("mean_daily"), F.min("n").alias("min_daily"),
        F.max("n").alias("max_daily"),
    )


def store_traffic_spread(txns: DataFrame) -> DataFrame:
    per = txns.groupBy("banner_code", "store_id").agg(n_rows().alias("n"))
    return per.groupBy("banner_code").agg(
        n_rows().alias("n_stores"), mean_int("n").alias("mean_txns"), F.min("n").alias("min_txns"),
        F.max("n").alias("max_txns"), ((F.max("n") - F.min("n")) * 100 / mean_int("n")).alias("range_pct_of_mean"),
    )


def promo_vs_nonpromo_ticket(lines: DataFrame, by: str, txn: str = "txn_id") -> DataFrame:
    """Mean ticket of transactions with and without a promoted line, and the difference in percent."""
    per = lines.groupBy(by, txn).agg(
        sum_money("line_total").alias("t"), F.bool_or(F.col("promo_id").isNotNull()).alias("promo")
    )
    p = F.col("promo")
    out = per.groupBy(by).agg(
        F.count_if(~p).alias("non_promo_txns"), mean_money("t", ~p).alias("non_promo_mean"),
        F.count_if(p).alias("promo_txns"), mean_money("t", p).alias("promo_mean"),
    )
    return out.withColumn("promo_vs_non_pct", (ratio("promo_mean", "non_promo_mean") - 1) * 100)


def stage_ratio(txns: DataFrame, stages: Sequence[Stage], baseline: str, unit: Sequence[str] = ("banner_code",)) -> DataFrame:
    """Mean transactions per (unit, day with data) by merchant and stage, and the ratio to the baseline stage."""
    day = F.col("txn_ts").cast("date")
    daily = txns.groupBy(*unit, day.alias("day")).agg(n_rows().alias("n"))
    staged = daily.withColumn("stage", stage_of(F.col("day"), stages)).filter(F.col("stage").isNotNull())
    stats = staged.groupBy("banner_code", "stage").agg(mean_int("n").alias("mean_daily"), n_rows().alias("n_days"))
    base = stats.filter(F.col("stage") == baseline).select("banner_code", F.col("mean_daily").alias("b"))
    return stats.join(base, "banner_code").select(
        "banner_code", "stage", "mean_daily", "n_days", ratio("mean_daily", "b").alias("ratio_to_baseline")
    )


def promo_lift_ratio(lines: DataFrame, windows: Sequence[tuple[str, dt.date, dt.date]]) -> DataFrame:
    """Per merchant: mean daily lines inside its window over the mean on days outside ALL windows.

    Windows are a handful of literals, hence a CASE rather than a range join.
    """
    names = [w[0] for w in windows]
    daily = lines.filter(F.col("banner_code").isin(*names)).groupBy(
        "banner_code", F.col("txn_ts").cast("date").alias("day")
    ).agg(n_rows().alias("n"))
    anywhere = own = F.lit(False)
    for b, a, z in windows:
        inside = F.col("day").between(F.lit(a), F.lit(z))
        anywhere = anywhere | inside
        own = own | ((F.col("banner_code") == b) & inside)
    out = daily.groupBy("banner_code").agg(
        F.coalesce(mean_int("n", own), F.lit(0.0)).alias("in_window"),
        F.coalesce(mean_int("n", ~anywhere), F.lit(0.0)).alias("baseline"),
    )
    return out.withColumn("ratio", F.coalesce(ratio("in_window", "baseline"), F.lit(0.0)))


def promo_window_units(lines: DataFrame, buckets: Sequence[tuple[str, str, dt.date, dt.date]], only: Column | None = None) -> DataFrame:
    """Units and transactions in each (merchant, bucket, from, to), 0 for none.

    Without `only` every product of the ticket counts, as when a product filter sits in an outer join's condition;
    with it, the corrected form.  Tickets of a merchant and day meet the merchant's buckets; no bucket is spread over its days.
    """
    spark = lines.sparkSession
    table = spark.createDataFrame(buckets, "banner_code string, bucket string, first date, last date")
    src = lines if only is None else lines.filter(only)
    per = src.groupBy("banner_code", F.col("txn_ts").cast("date").alias("day"), "txn_id").agg(F.sum("qty").alias("u"))
    within = per.join(F.broadcast(table), "banner_code").filter(F.col("day").between(F.col("first"), F.col("last")))  # a literal list
    hit = within.groupBy("banner_code", "bucket").agg(
        F.sum("u").alias("units"), F.count_distinct("txn_id").alias("txns")
    )
    return table.select("banner_code", "bucket").join(hit, ["banner_code", "bucket"], "left").na.fill(0)


def top_categories_per_merchant(lines: DataFrame, n: int = 5) -> DataFrame:
    per = lines.groupBy("banner_code", "category").agg(sum_money("line_total").alias("revenue"))
    whole = per.groupBy("banner_code").agg(sum_money("revenue").alias("t"))
    top = top_n(per, ["banner_code"], [F.desc("revenue"), F.col("category")], n, "category_rank")
    return top.join(whole, "banner_code").select(
        "banner_code", "category_rank", "category", "revenue", (ratio("revenue", "t") * 100).alias("pct_of_merchant")
    )


def top_skus_per_merchant(lines: DataFrame, n: int = 6) -> DataFrame:
    per = lines.groupBy("banner_code", "sku", "product_name").agg(n_rows().alias("lines"), F.sum("qty").alias("units"))
    return top_n(per, ["banner_code"], [F.desc("lines"), F.desc("units"), F.col("sku")], n, "sku_rank")


def store_counts_by_area(stores: DataFrame) -> DataFrame:
    return stores.groupBy("banner_code", "neighborhood").agg(n_rows().alias("n_stores"))


def panel_window(txns: DataFrame) -> DataFrame:
    d = F.col("txn_ts").cast("date")
    return txns.agg(F.min(d).alias("start"), F.max(d).alias("end")).withColumn(
        "days", (F.datediff("end", "start") + 1).cast("int")
    )


def union_rounded_dedup(frames: Sequence[DataFrame], digits: int = 4) -> DataFrame:
    """Stacked frames without rows that agree on the rounded view; the first frame's original row is kept.

    Grouping on the rounded columns keeps one minimum row per group map-side; no group is sorted or collected.
    """
    stacked = None
    for i, df in enumerate(frames):
        part = df.withColumn("_src", F.lit(i))
        stacked = part if stacked is None else stacked.unionByName(part)
    cols = frames[0].columns
    kinds = dict(frames[0].dtypes)
    # +0.0 folds negative zero; a NULL groups with NULL.
    rounded = [F.round(F.col(c), digits) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in cols]
    keys = [r.alias(f"_r{i}") for i, r in enumerate(rounded)]
    first = F.min(F.struct("_src", *cols)).alias("_row")
    return stacked.groupBy(*keys).agg(first).select("_row.*").drop("_src")
