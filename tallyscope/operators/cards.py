"""Own-data card metrics of one merchant: KPI strip, products, stores, mix, payments, traffic."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.calendar import dow_sunday0, week_of
from tallyscope.functions.money import pct_change, ratio, sum_money
from tallyscope.functions.ranking import top_n
from tallyscope.operators.scope import MIN_COMPARISON_DAYS
from tallyscope.operators.privacy import K_FLOOR
from tallyscope.operators.weeks import complete

FLAG_POINTS = 15.0
PRIOR_WEEKS = 4


def stores_summary(stores: DataFrame, txns: DataFrame, amount: str = "subtotal") -> DataFrame:
    """Every store with its transaction count and revenue, 0 without transactions.

    Transactions are summed per store before the outer join, so the join carries one row per store.
    """
    per_store = txns.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_txns"), sum_money(amount).alias("revenue"))
    return stores.join(per_store, "store_id", "left").select(
        *[c for c in ("store_id", "neighborhood", "metro_region", "latitude", "longitude") if c in stores.columns],
        F.coalesce("n_txns", F.lit(0)).alias("n_txns"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
    )


def kpi_strip(
    txns: DataFrame, start: dt.date, end: dt.date, weeks: DataFrame | None = None, amount: str = "subtotal"
) -> DataFrame:
    """Weekly sales, transactions and average basket, with the last week against the mean of up to four prior.

    One row of `txns` is one transaction.  One row per metric and week comes out: of the complete weeks with data, taken
    from the weekly sums themselves, or of `weeks`, where those without data count 0.  A window under 14 days has no
    delta; a prior mean that is not positive gives 0.  The weekly table is calendar-sized and is folded into one array
    per metric.
    """
    weekly = txns.groupBy(week_of(F.col("txn_ts")).alias("week")).agg(
        sum_money(amount).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    if weeks is None:
        filled = weekly.filter(complete(F.col("week"), start, end)).na.fill(0, ["_r"])
    else:
        filled = weeks.join(weekly, "week", "left").na.fill(0, ["_r", "_n"])
    basket = F.when(F.col("_n") > 0, F.col("_r") / F.col("_n")).otherwise(0.0)
    long = filled.select("week", F.inline(F.array(
        F.struct(F.lit("sales").alias("metric"), F.col("_r").alias("week_value")),
        F.struct(F.lit("transactions").alias("metric"), F.col("_n").cast("double").alias("week_value")),
        F.struct(F.lit("avg_basket").alias("metric"), basket.alias("week_value")),
    )))
    series = F.sort_array(F.collect_list(F.struct("week", "week_value")))
    folded = long.groupBy("metric").agg(series.alias("s")).withColumn("value", F.element_at("s", -1)["week_value"])
    size = F.size("s")
    prior = F.slice("s", F.greatest(F.lit(1), size - PRIOR_WEEKS), F.least(F.lit(PRIOR_WEEKS), size - 1))
    mean = F.aggregate(prior, F.lit(0.0), lambda acc, x: acc + x["week_value"]) / F.size(prior)
    delta = F.when(mean > 0, F.round((F.col("value") / mean - 1) * 100, 1)).otherwise(0.0)
    if (end - start).days < MIN_COMPARISON_DAYS:
        delta = F.lit(None).cast("double")
    else:
        delta = F.when(size > 1, delta).otherwise(0.0)
    return folded.withColumn("delta_pct", delta).select("metric", "value", "delta_pct", F.inline("s"))


def trailing_mean(weekly: DataFrame, value: str, n: int = PRIOR_WEEKS) -> DataFrame:
    """Each week's value next to the mean of the up to n weeks before it (one row per week, calendar-sized)."""
    listed = weekly.agg(F.sort_array(F.collect_list(F.struct("week", F.col(value).alias("value")))).alias("s"))

    def with_mean(x: Column, i: Column) -> Column:
        before = F.slice("s", F.greatest(F.lit(1), i + 1 - n), F.least(F.lit(n), i))
        total = F.aggregate(before, F.lit(0.0), lambda acc, y: acc + y["value"])
        return F.struct(x["week"].alias("week"), x["value"].alias("value"),
                        F.when(i > 0, total / F.size(before)).alias("prior_mean"))

    return listed.select(F.inline(F.transform("s", with_mean)))


def _role_counts(n_weeks: DataFrame) -> Column:
    return n_weeks.filter(F.col("role") == "baseline").agg(F.count(F.lit(1))).scalar()


def sku_performance(lines: DataFrame, roles: DataFrame, by: Sequence[str] = ("sku", "product_name", "category")) -> DataFrame:
    """Per product: recent week against the mean baseline week, absolute and relative to the house trend.

    Products without lines in either period drop out; without a baseline the deviations are NULL.
    """
    wk = lines.withColumn("week", week_of(F.col("txn_ts"))).join(roles, "week")
    recent = F.col("role") == "recent"
    n_base = _role_counts(roles)
    per = wk.groupBy(*by).agg(
        F.count_if(recent).alias("recent_lines"),
        F.coalesce(sum_money("line_total", recent), F.lit(0.0)).alias("recent_revenue"),
        F.count_if(~recent).alias("_base"),
    ).withColumn("baseline_lines", ratio(F.col("_base"), n_base))
    based = F.col("_base") > 0
    house = per.filter(based).agg(
        F.try_divide(F.sum("recent_lines").cast("double"), F.sum("_base").cast("double") / n_base)
    ).scalar()
    house = F.coalesce(house, F.lit(1.0))
    growth = F.try_divide(F.col("recent_lines").cast("double"), F.col("baseline_lines"))
    # Without any baseline week there is nothing to compare.
    return per.filter(n_base > 0).select(
        *by,
        F.round("baseline_lines", 1).alias("baseline_lines"),
        "recent_lines", "recent_revenue",
        F.when(based, F.round((growth - 1) * 100, 1)).alias("deviation_pct"),
        F.when(based & (house > 0), F.round((growth / house - 1) * 100, 1)).alias("trend_dev_pct"),
        F.round((house - 1) * 100, 1).alias("house_growth_pct"),
    )


def promotion_candidates(sku_rows: DataFrame, n: int) -> DataFrame:
    """Products losing share against the house trend, worst first."""
    return sku_rows.filter(F.col("trend_dev_pct") < 0).orderBy("trend_dev_pct", "sku").limit(n)


def top_performers(sku_rows: DataFrame, n: int) -> DataFrame:
    """Products holding or gaining share (or new), by recent revenue, with the share of the ten largest."""
    keep = sku_rows.filter(F.col("trend_dev_pct").isNull() | (F.col("trend_dev_pct") >= 0))
    order = [F.desc("recent_revenue"), F.col("sku")]
    whole = sku_rows.agg(sum_money("recent_revenue")).scalar()
    ten = keep.orderBy(*order).limit(10).agg(sum_money("recent_revenue")).scalar()
    return keep.orderBy(*order).limit(n).withColumn("top10_share_pct", ratio(ten, whole) * 100)


def store_deviation(stores: DataFrame, txns: DataFrame, roles: DataFrame, amount: str = "subtotal") -> DataFrame:
    """Per store: recent week's sales against the mean baseline week; stores without baseline drop out."""
    recent = F.col("role") == "recent"
    n_base = _role_counts(roles)
    per = (
        txns.withColumn("week", week_of(F.col("txn_ts"))).join(roles, "week").groupBy("store_id")
        .agg(F.coalesce(sum_money(amount, recent), F.lit(0.0)).alias("_r"), sum_money(amount, ~recent).alias("_b"))
    )
    out = stores.join(per, "store_id", "left").withColumn("_b", ratio(F.col("_b"), n_base)).filter(F.col("_b") > 0)
    dev = F.round(pct_change(F.col("_r"), F.col("_b")), 1)
    return out.select(
        "store_id", "neighborhood", F.round("_b", 1).alias("baseline"), F.col("_r").cast("bigint").alias("recent"),
        dev.alias("deviation_pct"),
    ).withColumn("flag", F.abs("deviation_pct") >= FLAG_POINTS).orderBy(F.abs("deviation_pct").desc(), "store_id")


def store_deviation_summary(rows: DataFrame) -> DataFrame:
    dev = F.col("deviation_pct")
    return rows.agg(
        F.count_if("flag").alias("n_flagged"),
        F.count_if(F.col("flag") & (dev < 0)).alias("n_under"),
        F.count_if(F.col("flag") & (dev > 0)).alias("n_over"),
        F.max_by("store_id", F.struct(F.abs(dev), -F.col("store_id"))).alias("top_store"),
    )


def worst_stores_first(rows: DataFrame) -> DataFrame:
    under = rows.agg(F.count_if(F.col("deviation_pct") <= -FLAG_POINTS)).scalar()
    return rows.withColumn("n_under", under).orderBy("deviation_pct", "store_id")


def department_mix(lines: DataFrame, levels: Sequence[str], amount: str = "line_total") -> DataFrame:
    """Revenue at every level of the taxonomy, each as a percentage of its PARENT.

    One rollup gives all levels; the parent's revenue comes from joining the result with itself, one row per node.
    A zero parent counts as 1.
    """
    names = [f"l{i}" for i in range(len(levels))]
    nodes = (
        lines.groupBy(*[F.col(c).alias(n) for c, n in zip(levels, names)])
        .agg(sum_money(amount).alias("_m"))
        .rollup(*names)
        .agg(F.grouping_id().alias("_g"), sum_money("_m").alias("revenue"))
        .withColumn("level", (F.lit(len(levels)) - F.bit_count("_g")).cast("int"))
        .drop("_g")
    )
    # Parent key of a node: its path without the last step.
    path = [F.coalesce(F.col(n), F.lit("")) for n in names]
    keyed = nodes.withColumn("_path", F.slice(F.array(*path), F.lit(1), F.col("level")))
    parents = keyed.select(
        F.col("_path").alias("_pp"), (F.col("level") + 1).alias("_pl"), F.col("revenue").alias("_pr")
    )
    kids = keyed.filter(F.col("level") > 0).withColumn("_pp", F.slice("_path", F.lit(1), F.col("level") - 1))
    joined = kids.join(parents, (kids["_pp"] == parents["_pp"]) & (kids["level"] == parents["_pl"]))
    parent = F.when(F.col("_pr") == 0, 1.0).otherwise(F.col("_pr"))
    return joined.select(
        (F.col("level") - 1).cast("int").alias("level"), *names, "revenue",
        (F.col("revenue") / parent * 100).alias("pct_of_parent"),
    )


def top3_concentration(mix: DataFrame) -> DataFrame:
    top = mix.filter(F.col("level") == 0).orderBy(F.desc("revenue"), "l0").limit(3)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("revenue")).alias("o"), F.col("l0").alias("name"))))
    return top.agg(
        F.transform(listed, lambda x: x["name"]).alias("_n"), F.sum("pct_of_parent").alias("top3_pct")
    ).select(F.array_join("_n", ",").alias("top3_names"), "top3_pct")


def payment_mix(txns: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Share of ALL transactions by entry mode, by network, and by wallet provider among taps; wallet adoption.

    One pass: each transaction contributes one row per dimension, collapsed map-side; the total is one of the rows.
    """
    tapped = F.col("wallet_at_tap")
    dims = F.array(
        F.struct(F.lit("entry_mode").alias("dimension"), F.col("entry_mode").alias("code"), F.lit(True).alias("use")),
        F.struct(F.lit("network").alias("dimension"), F.col("network").alias("code"), F.lit(True).alias("use")),
        F.struct(F.lit("wallet").alias("dimension"), F.col("wallet_provider").alias("code"), tapped.alias("use")),
        F.struct(F.lit("wallet_adoption").alias("dimension"), F.lit("all").alias("code"), tapped.alias("use")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("code"), F.lit(True).alias("use")),
    )
    counted = (
        txns.select(F.inline(dims)).filter("use").groupBy("dimension", "code").agg(F.count(F.lit(1)).alias("n"))
    )
    whole = counted.filter(F.col("dimension") == "total").agg(F.max("n")).scalar()
    label = F.initcap("code")
    for code, text in (labels or {}).items():
        label = F.when(F.col("code") == code, text).otherwise(label)
    return counted.filter(F.col("dimension") != "total").select(
        "dimension", "code", label.alias("label"), "n", F.round(F.col("n") * 100 / whole, 1).alias("pct")
    )


def hour_dow_heatmap(txns: DataFrame, distinct_txn: str | None = None) -> DataFrame:
    """7 x 24 counts (0 = Sunday), empty cells 0.  With a category filter upstream, count distinct transactions."""
    n = F.count_distinct(distinct_txn) if distinct_txn else F.count(F.lit(1))
    cells = txns.groupBy(dow_sunday0(F.col("txn_ts")).alias("dow"), F.hour("txn_ts").alias("hour")).agg(n.alias("n"))
    spine = txns.sparkSession.range(7 * 24).select(
        (F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour")
    )
    return spine.join(cells, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_suppressed(cells: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Cells with 0 < n < k become NULL, zeros stay; every row carries the number of suppressed cells."""
    thin = F.col("n").between(1, k - 1)
    n = cells.agg(F.count_if(thin)).scalar()
    return cells.select("dow", "hour", F.when(~thin, F.col("n")).alias("n"), n.alias("suppressed_count"))


def traffic_peaks(suppressed: DataFrame) -> DataFrame:
    """Busiest and slowest open cell, and weekday against weekend per day; ties go to the earliest Mon..Sun cell."""
    mon = (F.col("dow") + 6) % 7
    pos = mon * 24 + F.col("hour")
    n = F.col("n")
    open_cell = F.struct(n.alias("n"), pos.alias("pos"))
    peak = F.max(F.when(n > 0, F.struct(n.alias("n"), (-pos).alias("pos"))))
    slow = F.min(F.when(n > 0, open_cell))
    wd, we = F.sum(F.when(mon < 5, n)) / 5, F.sum(F.when(mon >= 5, n)) / 2
    out = suppressed.agg(
        peak.alias("p"), slow.alias("s"), F.coalesce(wd, F.lit(0.0)).alias("wd"), F.coalesce(we, F.lit(0.0)).alias("we"),
        F.max("suppressed_count").alias("suppressed_count"),
    )
    names = F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])

    def name(at: Column) -> Column:
        return F.get(names, (at / 24).cast("int"))

    comparable = (F.col("wd") > 0) & (F.col("we") > 0)
    higher = F.when(~comparable | (F.col("wd") >= F.col("we")), "weekday").otherwise("weekend")
    big, low = F.greatest("wd", "we"), F.least("wd", "we")
    return out.select(
        name(-F.col("p.pos")).alias("peak_dow"), ((-F.col("p.pos")) % 24).cast("int").alias("peak_hour"),
        F.col("p.n").alias("peak_n"), name(F.col("s.pos")).alias("slow_dow"),
        (F.col("s.pos") % 24).cast("int").alias("slow_hour"), F.col("s.n").alias("slow_n"),
        higher.alias("wd_we_higher"),
        F.when(comparable, F.round((big / low - 1) * 100, 0)).otherwise(0.0).cast("int").alias("wd_we_ratio"),
        "suppressed_count",
    )


def timing_curves(txns: DataFrame, daypart_of: Column) -> DataFrame:
    """Trips by day of week (all seven, closed days 0) and by daypart, in one relation."""
    counts = txns.groupBy(dow_sunday0(F.col("txn_ts")).alias("dow")).agg(F.count(F.lit(1)).alias("trips"))
    by_day = dow_spine(counts).select(
        F.lit("dow").alias("axis"), F.col("dow").cast("string").alias("bucket"), "trips"
    )
    by_part = txns.groupBy(daypart_of.alias("bucket")).agg(F.count(F.lit(1)).alias("trips"))
    return by_day.unionByName(by_part.select(F.lit("daypart").alias("axis"), "bucket", "trips"))


def dow_spine(counts: DataFrame, key: str = "dow", value: str = "trips") -> DataFrame:
    """All seven days; a day without rows counts 0."""
    spine = counts.sparkSession.range(7).select(F.col("id").cast("int").alias(key))
    return spine.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).alias(value))


def dow_share(txns: DataFrame) -> DataFrame:
    """Trips and share of all trips by day of week."""
    g = txns.groupBy(dow_sunday0(F.col("txn_ts")).alias("dow")).agg(F.count(F.lit(1)).alias("trips"))
    return g.withColumn("share", ratio(F.col("trips"), g.agg(F.sum("trips")).scalar()))


def hourly_sales(txns: DataFrame, hours: Sequence[int] = (), amount: str = "subtotal", units: str = "n_units") -> DataFrame:
    h = F.hour("txn_ts")
    df = txns.filter(h.isin(*hours)) if hours else txns
    return df.groupBy(h.alias("hour")).agg(
        F.sum(units).alias("units"), sum_money(amount).alias("sales"), F.count_distinct("txn_id").alias("txns")
    )


def neighborhood_overview(txns: DataFrame) -> DataFrame:
    return txns.groupBy("neighborhood").agg(
        F.count_distinct("store_id").alias("stores"), F.count_distinct("txn_id").alias("txns"),
        sum_money("subtotal").alias("sales"),
    )


def store_weekly_traffic(txns: DataFrame) -> DataFrame:
    return txns.groupBy("store_id", "neighborhood", week_of(F.col("txn_ts")).alias("week")).agg(
        F.count_distinct("txn_id").alias("txns")
    )


def capped_payload(df: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """The first `cap` rows of a report, with the full row count and whether it was cut."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(cap).withColumns({"row_count": n, "truncated": n > cap})


def largest_transaction(txns: DataFrame, lines: DataFrame, keys: Sequence[str] = ("txn_id",)) -> DataFrame:
    """The single largest transaction with its lines."""
    top = txns.orderBy(F.desc("subtotal"), *keys).limit(1).select(*keys, "subtotal")
    return lines.join(top, list(keys))


def promo_start_dates(promotions: DataFrame, n: int = 3) -> DataFrame:
    return promotions.select("start_date").distinct().orderBy("start_date").limit(n)


def shortest_name_match(products: DataFrame, keyword: str) -> DataFrame:
    """Per category the shortest product name holding the keyword, else the cheapest product."""
    hit = F.lower("product_name").contains(keyword.lower())
    length = F.when(hit, F.length("product_name"))
    order = [hit.desc(), length.asc_nulls_last(), F.col("shelf_price"), F.col("sku")]
    return top_n(products, ["category"], order, 1).select(
        "category", "product_name", "subcategory", "shelf_price", hit.alias("matched")
    )


def taxonomy_mismatch(products: DataFrame, n: int) -> DataFrame:
    """Products filed by the merchant outside their functional department come first, private label before others."""
    differs = F.col("merchant_department") != F.col("department")
    return products.orderBy(differs.desc(), F.col("private_label").desc(), "sku").limit(n)
