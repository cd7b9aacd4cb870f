"""Own-data card queries: orders for weekly cards, events for anything that needs a time of day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyscope.functions.calendar import daypart, week_of

from tallyscope.operators import cards, scope, weeks
from tallyscope.plans.lake_queries import own_lines
from tallyscope.plans.registry import query
from tallyscope.plans.sql import CU, IT, LN, LNT, PR, SE, TX, VI, VIEWER, money, total
from tallyscope.sources import census

START, END = dt.date(2000, 1, 3), dt.date(2000, 4, 2)
FILTERS = scope.Filters(date_start=START, date_end=END)
IN_WINDOW = "txn_ts >= DATE '2000-01-03' AND txn_ts < DATE '2000-04-03'"
OWN = f"banner_code = '{VIEWER}'"
WEEK = "CAST(date_trunc('week', txn_ts) AS DATE)"


def own_visits(spark, d):
    return census.visits(spark, d, VIEWER)


def own_stores(spark, d):
    return census.stores(spark, d).filter(F.col("banner_code") == VIEWER)


def own_visits_in_window(spark, d):
    return scope.filtered_txns(own_visits(spark, d), FILTERS)


def own_weeks(spark, d):
    """The week list needs dates only: semi join of orders with the viewer's lines, no roll-up."""
    mine = own_stores(spark, d).select("store_id")
    own = census.items(spark, d).join(mine, "store_id", "left_semi").select("txn_id")
    txns = scope.filtered_txns(census.orders(spark, d), FILTERS).join(own, "txn_id", "left_semi")
    return weeks.complete_weeks(txns, START, END)


@query("filtered_txns", f"""WITH {VI} SELECT visit_id, store_id, subtotal, n_lines FROM vi WHERE {OWN} AND {IN_WINDOW}
  AND store_id IN (SELECT store_id FROM st WHERE {OWN} AND neighborhood IN ('N1', 'N3', 'N5'))""")
def _filtered_txns(spark, d):
    visits = scope.filtered_txns(own_visits(spark, d), FILTERS).filter(F.col("neighborhood").isin("N1", "N3", "N5"))
    return visits.select("visit_id", "store_id", "subtotal", "n_lines")


@query("category_filter", f"""WITH {LNT} SELECT txn_id, store_id, sku, qty, category FROM lnt WHERE {OWN}
  AND category IN ('Brand#3', 'Brand#7') AND txn_ts >= DATE '1999-01-01' AND txn_ts < DATE '2001-01-01'""")
def _category_filter(spark, d):
    f = scope.Filters(dt.date(1999, 1, 1), dt.date(2000, 12, 31), (), ("Brand#3", "Brand#7"))
    lines = scope.category_filter(own_lines(spark, d, timed=True), f)
    return scope.filtered_txns(lines, f).select("txn_id", "store_id", "sku", "qty", "category")


@query("row_filter", f"""WITH {LN} SELECT txn_id, sku, qty FROM ln WHERE department = 'PROMO'
  AND neighborhood IN ('N2', 'N4')""")
def _row_filter(spark, d):
    from tallyscope.operators.lake import enriched_lines

    lines = enriched_lines(census.items(spark, d), census.products(spark, d), census.stores(spark, d))
    return scope.row_filter(lines, {"department": "PROMO", "neighborhood": ["N2", "N4"]}).select("txn_id", "sku", "qty")


@query("window_width_check", """SELECT c_custkey, CAST(c_custkey % 30 AS INT) AS days, c_custkey % 30 < 14 AS too_narrow
FROM customer""")
def _window_width_check(spark, d):
    """Requested windows of 0 to 29 days, one per customer."""
    days = (F.col("c_custkey") % 30).cast("int")
    return census.table(spark, d, "customer").select(
        "c_custkey", days.alias("days"),
        scope.window_too_narrow(F.lit(START), F.date_add(F.lit(START), days)).alias("too_narrow"),
    )


@query("aliased_view", """SELECT o_orderkey AS txn_id, o_custkey AS customer_id, o_totalprice AS txn_total FROM orders""")
def _aliased_view(spark, d):
    from tallyscope.sources.readers import aliased, register_views

    raw = census.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer_token"),
        F.col("o_totalprice").alias("subtotal"),
    )
    register_views({"tenant_transactions": aliased(raw)})
    return spark.table("tenant_transactions")


WEEKS_CTE = f"""w AS (SELECT DISTINCT {WEEK} AS week FROM vi WHERE {OWN} AND {IN_WINDOW}),
wk AS (SELECT week FROM w WHERE week >= DATE '2000-01-03' AND week + 6 <= DATE '2000-04-02'),
roles AS (SELECT week, 'recent' AS role FROM wk WHERE week = (SELECT max(week) FROM wk) UNION ALL
  SELECT week, 'baseline' FROM (SELECT week FROM wk WHERE week < (SELECT max(week) FROM wk) ORDER BY week LIMIT 4))"""


@query("complete_weeks", f"WITH {VI}, {WEEKS_CTE} SELECT week FROM wk")
def _complete_weeks(spark, d):
    return own_weeks(spark, d)


@query("recent_baseline_weeks", f"WITH {VI}, {WEEKS_CTE} SELECT week, role FROM roles")
def _recent_baseline_weeks(spark, d):
    return weeks.recent_baseline_weeks(own_weeks(spark, d))


@query("stores_summary", f"""WITH {VI} SELECT st.store_id, st.neighborhood, st.latitude, st.longitude, st.segment AS metro_region,
  count(visit_id) AS n_txns, coalesce({money('subtotal')}, 0) AS revenue FROM st LEFT JOIN vi USING (store_id)
  WHERE st.banner_code = '{VIEWER}' GROUP BY ALL""")
def _stores_summary(spark, d):
    return cards.stores_summary(own_stores(spark, d), own_visits(spark, d))


@query("basket_rollup", f"""WITH {VI} SELECT txn_id, store_id, subtotal, discount_total, n_lines FROM vr""")
def _basket_rollup(spark, d):
    return census.visit_rollup(census.items(spark, d)).select(
        "txn_id", "store_id", "subtotal", "discount_total", "n_lines"
    )


@query("assemble_transactions", f"""WITH {VI}, {CU} SELECT visit_id, store_id, banner_code, segment, customer_token, tender, network,
  entry_mode, wallet_at_tap, wallet_provider, subtotal, n_lines, home_zone FROM vi JOIN cu USING (customer_token)""")
def _assemble_transactions(spark, d):
    cust = census.customers(spark, d).select("customer_token", "home_zone")
    return census.visits(spark, d).join(cust, "customer_token").select(
        "visit_id", "store_id", "banner_code", "segment", "customer_token", "tender", "network", "entry_mode",
        "wallet_at_tap", "wallet_provider", "subtotal", "n_lines", "home_zone",
    )


@query("kpi_strip", f"""WITH {VI}, {WEEKS_CTE}, g AS (SELECT {WEEK} AS week, {money('subtotal')} AS r, count(DISTINCT visit_id) AS n
  FROM vi WHERE {OWN} AND {IN_WINDOW} GROUP BY 1), f AS (SELECT week, coalesce(r, 0) AS r, coalesce(n, 0) AS n FROM wk LEFT JOIN g USING (week)),
l AS (SELECT 'sales' AS metric, week, r AS week_value FROM f UNION ALL SELECT 'transactions', week, n FROM f UNION ALL
  SELECT 'avg_basket', week, CASE WHEN n > 0 THEN r / n ELSE 0 END FROM f),
p AS (SELECT metric, avg(week_value) AS m FROM l WHERE week IN (SELECT week FROM wk WHERE week < (SELECT max(week) FROM wk)
  ORDER BY week DESC LIMIT 4) GROUP BY 1), v AS (SELECT metric, arg_max(week_value, week) AS value FROM l GROUP BY 1)
SELECT metric, value, CASE WHEN m > 0 THEN round((value / m - 1) * 100, 1) ELSE 0 END AS delta_pct, week, week_value
FROM l JOIN v USING (metric) LEFT JOIN p USING (metric)""")
def _kpi_strip(spark, d):
    return cards.kpi_strip(own_visits_in_window(spark, d), START, END)


@query("trailing_mean", f"""WITH {VI}, g AS (SELECT {WEEK} AS week, CAST(sum(n_units) AS DOUBLE) AS value FROM vi WHERE {OWN} AND {IN_WINDOW} GROUP BY 1)
SELECT week, value, avg(value) OVER (ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prior_mean FROM g""")
def _trailing_mean(spark, d):
    weekly = own_visits_in_window(spark, d).groupBy(week_of(F.col("txn_ts")).alias("week")).agg(
        F.sum("n_units").cast("double").alias("units")
    )
    return cards.trailing_mean(weekly, "units")


def _own_lines_in_window(spark, d):
    return scope.filtered_txns(own_lines(spark, d, timed=True), FILTERS)


SKU_CTE = f"""{LNT}, {WEEKS_CTE.replace('FROM vi', 'FROM lnt')}, nb AS (SELECT CAST(count(*) AS DOUBLE) AS nb FROM roles WHERE role = 'baseline'),
s AS (SELECT sku, product_name, category, count(*) FILTER (WHERE role = 'recent') AS recent_lines,
  coalesce({money('line_total', "role = 'recent'")}, 0) AS recent_revenue, count(*) FILTER (WHERE role = 'baseline') AS b
  FROM lnt JOIN roles ON week = {WEEK} WHERE {OWN} AND {IN_WINDOW} GROUP BY 1, 2, 3),
h AS (SELECT coalesce(sum(recent_lines) FILTER (WHERE b > 0) / (sum(b) / any_value(nb)), 1) AS house FROM s, nb),
sp AS (SELECT sku, product_name, category, round(b / nb, 1) AS baseline_lines, recent_lines, recent_revenue,
  CASE WHEN b > 0 THEN round((recent_lines / (b / nb) - 1) * 100, 1) END AS deviation_pct,
  CASE WHEN b > 0 AND house > 0 THEN round((recent_lines / (b / nb) / house - 1) * 100, 1) END AS trend_dev_pct,
  round((house - 1) * 100, 1) AS house_growth_pct FROM s, nb, h)"""


def _sku_rows(spark, d):
    return cards.sku_performance(_own_lines_in_window(spark, d), weeks.recent_baseline_weeks(own_weeks(spark, d)))


@query("sku_performance", f"WITH {SKU_CTE} SELECT * FROM sp")
def _sku_performance(spark, d):
    return _sku_rows(spark, d)


@query("promotion_candidates", f"""WITH {SKU_CTE} SELECT * FROM sp WHERE trend_dev_pct < 0 ORDER BY trend_dev_pct, sku LIMIT 15""")
def _promotion_candidates(spark, d):
    return cards.promotion_candidates(_sku_rows(spark, d), 15)


@query("top_performers", f"""WITH {SKU_CTE}, k AS (SELECT * FROM sp WHERE trend_dev_pct IS NULL OR trend_dev_pct >= 0
  ORDER BY recent_revenue DESC, sku), t AS (SELECT {money('recent_revenue')} AS ten FROM (SELECT * FROM k ORDER BY recent_revenue DESC, sku LIMIT 10)),
a AS (SELECT {money('recent_revenue')} AS whole FROM sp)
SELECT k.*, ten / whole * 100 AS top10_share_pct FROM k, t, a ORDER BY recent_revenue DESC, sku LIMIT 20""")
def _top_performers(spark, d):
    return cards.top_performers(_sku_rows(spark, d), 20)


DEV_CTE = f"""{VI}, {WEEKS_CTE}, nb AS (SELECT CAST(count(*) AS DOUBLE) AS nb FROM roles WHERE role = 'baseline'),
g AS (SELECT store_id, coalesce({money('subtotal', "role = 'recent'")}, 0) AS r, {money('subtotal', "role = 'baseline'")} AS b
  FROM vi JOIN roles ON week = {WEEK} WHERE {OWN} AND {IN_WINDOW} GROUP BY 1),
sd AS (SELECT store_id, neighborhood, round(b / nb, 1) AS baseline, CAST(trunc(r) AS BIGINT) AS recent,
  round((r / (b / nb) - 1) * 100, 1) AS deviation_pct FROM st JOIN g USING (store_id), nb WHERE b / nb > 0),
sf AS (SELECT *, abs(deviation_pct) >= 15 AS flag FROM sd)"""


def _deviation(spark, d):
    roles = weeks.recent_baseline_weeks(own_weeks(spark, d))
    return cards.store_deviation(own_stores(spark, d), own_visits_in_window(spark, d), roles)


@query("store_deviation", f"WITH {DEV_CTE} SELECT * FROM sf")
def _store_deviation(spark, d):
    return _deviation(spark, d)


@query("store_deviation_summary", f"""WITH {DEV_CTE} SELECT count(*) FILTER (WHERE flag) AS n_flagged,
  count(*) FILTER (WHERE flag AND deviation_pct < 0) AS n_under, count(*) FILTER (WHERE flag AND deviation_pct > 0) AS n_over,
  arg_max(store_id, (abs(deviation_pct), -store_id)) AS top_store FROM sf""")
def _store_deviation_summary(spark, d):
    return cards.store_deviation_summary(_deviation(spark, d))


@query("worst_stores_first", f"""WITH {DEV_CTE} SELECT *, (SELECT count(*) FROM sf WHERE deviation_pct <= -15) AS n_under FROM sf""")
def _worst_stores_first(spark, d):
    return cards.worst_stores_first(_deviation(spark, d))


MIX_CTE = f"""{LN}, b AS (SELECT department AS l0, category AS l1, subcategory AS l2, {money('line_total')} AS m FROM ln WHERE {OWN} GROUP BY 1, 2, 3),
n0 AS (SELECT l0, {money('m')} AS revenue FROM b GROUP BY 1), n1 AS (SELECT l0, l1, {money('m')} AS revenue FROM b GROUP BY 1, 2),
t AS (SELECT {money('m')} AS t FROM b),
mx AS (SELECT 0 AS level, l0, NULL AS l1, NULL AS l2, revenue, revenue / t * 100 AS pct_of_parent FROM n0, t UNION ALL
  SELECT 1, l0, l1, NULL, n1.revenue, n1.revenue / n0.revenue * 100 FROM n1 JOIN n0 USING (l0) UNION ALL
  SELECT 2, l0, l1, l2, m, m / n1.revenue * 100 FROM b JOIN n1 USING (l0, l1))"""


@query("department_mix", f"WITH {MIX_CTE} SELECT * FROM mx")
def _department_mix(spark, d):
    return cards.department_mix(own_lines(spark, d), ["department", "category", "subcategory"])


@query("category_mix", f"""WITH {LN}, b AS (SELECT category AS l0, subcategory AS l1, {money('line_total')} AS m FROM ln WHERE {OWN} GROUP BY 1, 2),
n0 AS (SELECT l0, {money('m')} AS revenue FROM b GROUP BY 1), t AS (SELECT {money('m')} AS t FROM b)
SELECT 0 AS level, l0, NULL AS l1, revenue, revenue / t * 100 AS pct_of_parent FROM n0, t UNION ALL
SELECT 1, l0, l1, m, m / revenue * 100 FROM b JOIN n0 USING (l0)""")
def _category_mix(spark, d):
    """The two-level form, for merchants whose department is a single bucket."""
    return cards.department_mix(own_lines(spark, d), ["category", "subcategory"])


@query("top3_concentration", f"""WITH {MIX_CTE}, t3 AS (SELECT * FROM mx WHERE level = 0 ORDER BY revenue DESC, l0 LIMIT 3)
SELECT string_agg(l0, ',' ORDER BY revenue DESC, l0) AS top3_names, round(sum(pct_of_parent), 6) AS top3_pct FROM t3""")
def _top3_concentration(spark, d):
    mix = cards.department_mix(own_lines(spark, d), ["department", "category", "subcategory"])
    return cards.top3_concentration(mix).withColumn("top3_pct", F.round("top3_pct", 6))


@query("payment_mix", f"""WITH {VI}, o AS (SELECT * FROM vi WHERE {OWN}), n AS (SELECT 'entry_mode' AS dimension, entry_mode AS code, count(*) AS n FROM o GROUP BY 2
  UNION ALL SELECT 'network', network, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'wallet', wallet_provider, count(*) FROM o WHERE wallet_at_tap GROUP BY 2
  UNION ALL SELECT 'wallet_adoption', 'all', count(*) FROM o WHERE wallet_at_tap)
SELECT dimension, code, CASE WHEN dimension = 'wallet' THEN upper(code[1]) || lower(code[2:]) WHEN code = 'all' THEN 'All' ELSE code END AS label, n,
  round(CAST(n AS DOUBLE) * 100 / (SELECT count(*) FROM o), 1) AS pct FROM n""")
def _payment_mix(spark, d):
    return cards.payment_mix(own_visits(spark, d))


HEAT = f"""{SE}, c AS (SELECT CAST(dayofweek(txn_ts) AS INT) AS dow, CAST(extract(hour FROM txn_ts) AS INT) AS hour, count(*) AS n
  FROM se WHERE banner_code = 'purchase' GROUP BY 1, 2), sp AS (SELECT CAST(a AS INT) AS dow, CAST(b AS INT) AS hour FROM range(7) x(a), range(24) y(b)),
h AS (SELECT dow, hour, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (dow, hour))"""


def _purchases(spark, d):
    return census.sessions(spark, d).filter(F.col("banner_code") == "purchase")


@query("hour_dow_heatmap", f"WITH {HEAT} SELECT * FROM h")
def _hour_dow_heatmap(spark, d):
    return cards.hour_dow_heatmap(_purchases(spark, d))


@query("hour_dow_heatmap_distinct", f"""WITH {HEAT.replace('count(*) AS n', 'count(DISTINCT customer_token) AS n')} SELECT * FROM h""")
def _hour_dow_heatmap_distinct(spark, d):
    return cards.hour_dow_heatmap(_purchases(spark, d), distinct_txn="customer_token")


HEAT_K = 50


@query("heatmap_suppressed", f"""WITH {HEAT} SELECT dow, hour, CASE WHEN n BETWEEN 1 AND {HEAT_K - 1} THEN NULL ELSE n END AS n,
  (SELECT count(*) FROM h WHERE n BETWEEN 1 AND {HEAT_K - 1}) AS suppressed_count FROM h""")
def _heatmap_suppressed(spark, d):
    return cards.heatmap_suppressed(cards.hour_dow_heatmap(_purchases(spark, d)), HEAT_K)


@query("traffic_peaks", f"""WITH {HEAT}, s AS (SELECT (dow + 6) % 7 AS m, hour, CASE WHEN n BETWEEN 1 AND {HEAT_K - 1} THEN NULL ELSE n END AS n FROM h),
q AS (SELECT (SELECT (m, hour, n) FROM s WHERE n > 0 ORDER BY n DESC, m, hour LIMIT 1) AS p, (SELECT (m, hour, n) FROM s WHERE n > 0 ORDER BY n, m, hour LIMIT 1) AS l,
  (SELECT coalesce(sum(n), 0) / 5 FROM s WHERE m < 5) AS wd, (SELECT coalesce(sum(n), 0) / 2 FROM s WHERE m >= 5) AS we)
SELECT ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][p[1] + 1] AS peak_dow, p[2] AS peak_hour, p[3] AS peak_n,
  ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][l[1] + 1] AS slow_dow, l[2] AS slow_hour, l[3] AS slow_n,
  CASE WHEN wd >= we OR wd = 0 OR we = 0 THEN 'weekday' ELSE 'weekend' END AS wd_we_higher,
  CASE WHEN wd > 0 AND we > 0 THEN CAST(round((greatest(wd, we) / least(wd, we) - 1) * 100, 0) AS INT) ELSE 0 END AS wd_we_ratio,
  (SELECT count(*) FROM h WHERE n BETWEEN 1 AND {HEAT_K - 1}) AS suppressed_count FROM q""")
def _traffic_peaks(spark, d):
    return cards.traffic_peaks(cards.heatmap_suppressed(cards.hour_dow_heatmap(_purchases(spark, d)), HEAT_K))


DAYPART = """CASE WHEN extract(hour FROM txn_ts) BETWEEN 6 AND 10 THEN 'breakfast' WHEN extract(hour FROM txn_ts) BETWEEN 11 AND 14 THEN 'midday'
  WHEN extract(hour FROM txn_ts) BETWEEN 15 AND 17 THEN 'afternoon' WHEN extract(hour FROM txn_ts) BETWEEN 18 AND 21 THEN 'dinner' ELSE 'late' END"""


@query("timing_curves", f"""WITH {SE}, o AS (SELECT * FROM se WHERE banner_code = 'click') SELECT 'dow' AS axis, CAST(g AS VARCHAR) AS bucket,
  count(txn_id) AS trips FROM range(7) t(g) LEFT JOIN o ON dayofweek(txn_ts) = g GROUP BY 2 UNION ALL
  SELECT 'daypart', {DAYPART}, count(*) FROM o GROUP BY 2""")
def _timing_curves(spark, d):
    clicks = census.sessions(spark, d).filter(F.col("banner_code") == "click")
    return cards.timing_curves(clicks, daypart(F.hour("txn_ts")))


@query("dow_spine", """SELECT CAST(g AS INT) AS dow, count(event_id) AS trips FROM range(7) t(g) LEFT JOIN events
  ON dayofweek(ts) = g AND event_type = 'signup' AND dayofweek(ts) <> 0 GROUP BY 1""")
def _dow_spine(spark, d):
    """A merchant closed on Sundays: the day is there, with 0 trips."""
    s = census.sessions(spark, d).filter((F.col("banner_code") == "signup") & (F.dayofweek("txn_ts") != 1))
    counts = s.groupBy((F.dayofweek("txn_ts") - 1).cast("int").alias("dow")).agg(F.count(F.lit(1)).alias("trips"))
    return cards.dow_spine(counts)


@query("dow_share", f"""WITH {SE} SELECT CAST(dayofweek(txn_ts) AS INT) AS dow, count(*) AS trips, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
FROM se WHERE banner_code = 'view' GROUP BY 1""")
def _dow_share(spark, d):
    return cards.dow_share(census.sessions(spark, d).filter(F.col("banner_code") == "view"))


@query("daypart_bucket", f"""WITH {SE} SELECT banner_code, {DAYPART} AS daypart, count(*) AS n FROM se GROUP BY 1, 2""")
def _daypart_bucket(spark, d):
    return census.sessions(spark, d).groupBy("banner_code", daypart(F.hour("txn_ts")).alias("daypart")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("hourly_sales", f"""WITH {SE} SELECT CAST(extract(hour FROM txn_ts) AS INT) AS hour, {total('k')} AS units, {money('subtotal')} AS sales,
  count(DISTINCT txn_id) AS txns FROM se WHERE extract(hour FROM txn_ts) BETWEEN 8 AND 20 GROUP BY 1""")
def _hourly_sales(spark, d):
    return cards.hourly_sales(census.sessions(spark, d), range(8, 21), units="k")


@query("neighborhood_overview", f"""WITH {VI} SELECT neighborhood, count(DISTINCT store_id) AS stores, count(DISTINCT txn_id) AS txns,
  {money('subtotal')} AS sales FROM vi WHERE {OWN} GROUP BY 1""")
def _neighborhood_overview(spark, d):
    return cards.neighborhood_overview(own_visits(spark, d))


@query("store_weekly_traffic", f"""WITH {VI} SELECT store_id, neighborhood, {WEEK} AS week, count(DISTINCT txn_id) AS txns FROM vi WHERE {OWN} GROUP BY 1, 2, 3""")
def _store_weekly_traffic(spark, d):
    return cards.store_weekly_traffic(own_visits(spark, d))


@query("capped_payload", f"""WITH {LN}, g AS (SELECT category, subcategory, {total('qty')} AS units FROM ln GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM g) AS row_count, (SELECT count(*) FROM g) > 50 AS truncated FROM g ORDER BY units DESC, category, subcategory LIMIT 50""")
def _capped_payload(spark, d):
    items = census.items(spark, d).join(census.products(spark, d).select("sku", "category", "subcategory"), "sku")
    g = items.groupBy("category", "subcategory").agg(F.sum("qty").alias("units"))
    return cards.capped_payload(g, [F.desc("units"), F.col("category"), F.col("subcategory")], 50)


@query("largest_transaction", f"""WITH {VI} SELECT txn_id, store_id, sku, qty, line_total, subtotal FROM it JOIN (SELECT txn_id, store_id, subtotal FROM vi
  WHERE {OWN} ORDER BY subtotal DESC, txn_id, store_id LIMIT 1) USING (txn_id, store_id)""")
def _largest_transaction(spark, d):
    return cards.largest_transaction(own_visits(spark, d), census.items(spark, d), ["txn_id", "store_id"]).select(
        "txn_id", "store_id", "sku", "qty", "line_total", "subtotal"
    )


@query("taxonomy_mismatch", f"""WITH {PR} SELECT sku, department, merchant_department, private_label FROM pr
  ORDER BY (merchant_department <> department) DESC, private_label DESC, sku LIMIT 6""")
def _taxonomy_mismatch(spark, d):
    return cards.taxonomy_mismatch(census.products(spark, d), 6).select(
        "sku", "department", "merchant_department", "private_label"
    )


@query("shortest_name_match", f"""WITH {PR} SELECT category, product_name, subcategory, shelf_price, contains(lower(product_name), 'red plate') AS matched FROM pr
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY contains(lower(product_name), 'red plate') DESC,
  CASE WHEN contains(lower(product_name), 'red plate') THEN length(product_name) END ASC NULLS LAST, shelf_price, sku) = 1""")
def _shortest_name_match(spark, d):
    return cards.shortest_name_match(census.products(spark, d), "red plate")


@query("weekly_area_txns", f"""WITH {VI} SELECT {WEEK} AS week, count(*) AS txns FROM vi WHERE {OWN} AND neighborhood = 'N3' GROUP BY 1""")
def _weekly_area_txns(spark, d):
    return own_visits(spark, d).filter(F.col("neighborhood") == "N3").groupBy(
        week_of(F.col("txn_ts")).alias("week")
    ).agg(F.count(F.lit(1)).alias("txns"))


@query("daily_item_series", f"""WITH {LNT} SELECT CAST(txn_ts AS DATE) AS day, {total('qty')} AS units FROM lnt WHERE neighborhood = 'N3'
  AND category = 'Brand#7' AND product_name LIKE '%red%' GROUP BY 1""")
def _daily_item_series(spark, d):
    st = census.stores(spark, d).filter(F.col("neighborhood") == "N3")
    pr = census.products(spark, d).filter((F.col("category") == "Brand#7") & F.col("product_name").like("%red%"))
    lines = census.items(spark, d).join(st.select("store_id"), "store_id").join(pr.select("sku"), "sku")
    return lines.join(census.orders(spark, d), "txn_id").groupBy(F.col("txn_ts").cast("date").alias("day")).agg(
        F.sum("qty").alias("units")
    )


