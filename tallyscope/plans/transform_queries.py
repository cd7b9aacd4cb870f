"""Calendars, promotions, anomalies, gravity, pricing rules and published aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyscope.operators import aggregates, cards, transforms
from tallyscope.plans.basket_queries import panel_lines, product_lines
from tallyscope.plans.quality_queries import PROMO, promotions, timed_lines
from tallyscope.plans.registry import query, rounded
from tallyscope.plans.sql import CU, IT, LNT, MR, PR, ST, TX, VI, avg_money, money, total
from tallyscope.sources import census


def two_wave_promotions(spark, d):
    """Every product's promotion, and a second one that overlaps its last ten days."""
    p = promotions(spark, d)
    later = p.select(
        F.concat("promo_id", F.lit("b")).alias("promo_id"), "sku", F.date_add("start_date", 10).alias("start_date"),
        F.date_add("end_date", 10).alias("end_date"), (F.col("depth_pct") / 2).alias("depth_pct"),
    )
    return p.unionByName(later)


P2 = f"""{PROMO}, p2 AS (SELECT * FROM promo UNION ALL SELECT promo_id || 'b', sku, start_date + 10, end_date + 10, depth_pct / 2 FROM promo),
pc AS (SELECT day, sku, arg_max(promo_id, (start_date, promo_id)) AS promo_id, arg_max(depth_pct, (start_date, promo_id)) AS depth_pct FROM
  (SELECT *, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM p2) GROUP BY 1, 2)"""


@query("promo_calendar", f"WITH {P2} SELECT * FROM pc")
def _promo_calendar(spark, d):
    return transforms.promo_calendar(two_wave_promotions(spark, d))


PL = f"""{PR}, {IT}, {TX}, {P2}, pl AS (SELECT it.txn_id, it.sku, it.qty, CAST(txn_ts AS DATE) AS day, pc.promo_id, pc.depth_pct
  FROM it JOIN tx USING (txn_id) LEFT JOIN pc ON pc.sku = it.sku AND pc.day = CAST(txn_ts AS DATE))"""


def _promo_lines(spark, d):
    lines = census.items(spark, d).join(census.orders(spark, d), "txn_id").select("txn_id", "sku", "qty", "txn_ts")
    return transforms.promo_lines(lines, two_wave_promotions(spark, d))


@query("promo_lines", f"WITH {PL} SELECT txn_id, sku, qty, day, promo_id, depth_pct FROM pl")
def _promo_lines_query(spark, d):
    return _promo_lines(spark, d).select("txn_id", "sku", "qty", "day", "promo_id", "depth_pct")


@query("flat_line_pricing", f"""WITH {PL}, a AS (SELECT pl.*, shelf_price, round_even(shelf_price * coalesce(depth_pct, 0) * 100, 0) / 100 AS discount FROM pl JOIN pr USING (sku)),
  b AS (SELECT *, round_even((shelf_price - discount) * 100, 0) / 100 AS unit_price FROM a)
  SELECT txn_id, sku, qty, shelf_price, discount, unit_price, round_even(unit_price * qty * 100, 0) / 100 AS line_total FROM b""")
def _flat_line_pricing(spark, d):
    priced = transforms.flat_line_pricing(_promo_lines(spark, d), census.products(spark, d))
    return priced.select("txn_id", "sku", "qty", "shelf_price", "discount", "unit_price", "line_total")


@query("promo_start_dates", f"WITH {PROMO} SELECT DISTINCT start_date FROM promo ORDER BY 1 LIMIT 3")
def _promo_start_dates(spark, d):
    return cards.promo_start_dates(promotions(spark, d))


def anomalies(spark, d):
    """One scheduled anomaly per store, derived from its key."""
    k = F.col("store_id")
    start = F.date_add(F.lit(dt.date(2000, 1, 1)), (k % 50).cast("int") * 7)
    kinds = F.array(*[F.lit(x) for x in ("category_spike", "share_shift", "demand_decline")])
    return census.stores(spark, d).select(
        k.alias("anomaly_id"), F.get(kinds, (k % 3).cast("int")).alias("anomaly_type"), "banner_code", "store_id", "zone_id",
        F.concat(F.lit("Brand#"), (k % 25).cast("string")).alias("category"), start.alias("start_date"),
        F.date_add(start, 13).alias("end_date"), (F.lit(1.0) + (k % 5) / 10.0).alias("magnitude"),
    )


AN = f"""{ST}, an AS (SELECT store_id AS anomaly_id, ['category_spike', 'share_shift', 'demand_decline'][store_id % 3 + 1] AS anomaly_type, banner_code, store_id, zone_id,
  'Brand#' || CAST(store_id % 25 AS VARCHAR) AS category, DATE '2000-01-01' + CAST(store_id % 50 * 7 AS INT) AS start_date, DATE '2000-01-01' + CAST(store_id % 50 * 7 + 13 AS INT) AS end_date,
  1.0::DOUBLE + (store_id % 5) / 10.0 AS magnitude FROM st)"""


@query("anomaly_affected_txns", f"""WITH {AN}, {IT}, {TX}, v AS (SELECT DISTINCT txn_id, store_id FROM it)
  SELECT txn_id, v.store_id, CAST(txn_ts AS DATE) AS day, max(magnitude) AS magnitude FROM v JOIN st USING (store_id) JOIN tx USING (txn_id)
  JOIN an ON an.anomaly_type = 'demand_decline' AND an.zone_id = st.zone_id AND an.banner_code = st.banner_code AND CAST(txn_ts AS DATE) BETWEEN start_date AND end_date GROUP BY 1, 2, 3""")
def _anomaly_affected_txns(spark, d):
    seen = census.items(spark, d).select("txn_id", "store_id").distinct()
    st = census.stores(spark, d).select("store_id", "banner_code", "zone_id")
    txns = seen.join(st, "store_id").join(census.orders(spark, d), "txn_id")
    return transforms.anomaly_affected_txns(txns, anomalies(spark, d)).select("txn_id", "store_id", "day", "magnitude")


@query("anomaly_calendar", f"""WITH {AN}, c AS (SELECT *, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM an)
  SELECT 'category_spike' AS kind, day, CAST(store_id AS VARCHAR) AS target, category, arg_max(magnitude, (start_date, anomaly_id)) AS multiplier FROM c WHERE anomaly_type = 'category_spike' GROUP BY 2, 3, 4
  UNION ALL SELECT 'share_shift', day, banner_code, NULL, arg_max(magnitude, (start_date, anomaly_id)) FROM c WHERE anomaly_type = 'share_shift' GROUP BY 2, 3""")
def _anomaly_calendar(spark, d):
    return transforms.anomaly_calendar(anomalies(spark, d))


DOW = [0.9, 0.85, 0.9, 0.95, 1.1, 1.3, 1.2]


@query("day_weights", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_txns FROM orders GROUP BY 1), s AS (SELECT min(day) AS a, max(day) AS z FROM d),
  c AS (SELECT a, z, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM s),
  w AS (SELECT day, CASE WHEN isodow(day) = 7 THEN 0 ELSE {DOW}[isodow(day)]::DOUBLE * CASE WHEN day(day) <= 10 THEN 1 + (1.12::DOUBLE - 1) * 0.8::DOUBLE WHEN day(day) BETWEEN 15 AND 17 THEN 1 + (1.06::DOUBLE - 1) * 0.8::DOUBLE ELSE 1 END
  * (1 + 6::DOUBLE / 100 * ((day - a) / greatest(1, z - a))) * CASE WHEN day BETWEEN DATE '2000-04-17' AND DATE '2000-04-23' THEN 1.25::DOUBLE ELSE 1 END END AS weight FROM c)
  SELECT day, round(weight, 9) AS weight, coalesce(n_txns, 0) AS n_txns FROM w LEFT JOIN d USING (day)""")
def _day_weights(spark, d):
    out = transforms.day_weights(
        census.orders(spark, d), DOW, 0.8, 1.12, 1.06, drift_pct=6.0,
        events=[(dt.date(2000, 4, 17), dt.date(2000, 4, 23), 1.25)], closed_dow=6,
    )
    return out.withColumn("weight", F.round("weight", 9))


GW = f"""{ST}, z AS (SELECT n_nationkey AS zone_id, (n_nationkey % 5) / 5.0 AS lat, (n_nationkey % 3) / 3.0 AS lon FROM nation),
gw AS (SELECT z.zone_id, store_id, banner_code, sqrt(pow(lat - latitude, 2) + pow(lon - longitude, 2)) AS distance,
  (1 + store_id % 4) / pow(sqrt(pow(lat - latitude, 2) + pow(lon - longitude, 2)) + 0.5, 1.7) AS weight FROM z CROSS JOIN st)"""


def _gravity(spark, d):
    pull = (1 + F.col("store_id") % 4).cast("double")
    return transforms.gravity_weights(census.zones(spark, d), census.stores(spark, d), pull, 1.7)


@query("gravity_weights", f"WITH {GW} SELECT zone_id, store_id, banner_code, round(distance, 9) AS distance, round(weight, 9) AS weight FROM gw")
def _gravity_weights(spark, d):
    return _gravity(spark, d).withColumns({"distance": F.round("distance", 9), "weight": F.round("weight", 9)})


@query("store_share_within_banner", f"""WITH {GW} SELECT zone_id, banner_code, store_id, round(weight / sum(weight) OVER (PARTITION BY zone_id, banner_code), 9) AS share FROM gw""")
def _store_share(spark, d):
    return transforms.store_share_within_banner(_gravity(spark, d)).withColumn("share", F.round("share", 9))


@query("banner_choice_probability", f"""WITH {GW}, u AS (SELECT zone_id, banner_code, sum(weight) AS pull FROM gw GROUP BY 1, 2), l AS (SELECT DISTINCT c_nationkey AS zone_id, c_mktsegment AS loyalty_type FROM customer),
  r AS (SELECT zone_id, loyalty_type, banner_code, pull * CASE WHEN banner_code = 'NATION_' || CAST(zone_id AS VARCHAR) THEN CASE loyalty_type WHEN 'BUILDING' THEN 0.7 ELSE 0.4 END ELSE CASE loyalty_type WHEN 'BUILDING' THEN 0.1 ELSE 0.3 END END::DOUBLE AS raw FROM u JOIN l USING (zone_id))
  SELECT zone_id, loyalty_type, banner_code, round(raw / sum(raw) OVER (PARTITION BY zone_id, loyalty_type), 9) AS probability FROM r""")
def _banner_choice(spark, d):
    primary = census.customers(spark, d).select(
        F.col("home_zone").alias("zone_id"), "loyalty_type", F.col("primary_banner").alias("banner_code")
    ).distinct()
    kinds = {k: (0.7, 0.1) if k == "BUILDING" else (0.4, 0.3) for k in ("BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    out = transforms.banner_choice_probability(_gravity(spark, d), primary, kinds)
    return out.withColumn("probability", F.round("probability", 9))


@query("metro_region", """SELECT c_custkey, CASE WHEN d = 'high' THEN 'urban_core' WHEN d IN ('medium', 'med-high') THEN 'inner_suburbs' ELSE 'outer_suburbs' END AS region
  FROM (SELECT c_custkey, ['high', 'medium', 'med-high', 'low', 'low-med'][c_custkey % 5 + 1] AS d FROM customer)""")
def _metro_region(spark, d):
    words = F.array(*[F.lit(x) for x in ("high", "medium", "Med-High", "low", "low-med")])
    density = F.get(words, (F.col("c_custkey") % 5).cast("int"))
    return census.table(spark, d, "customer").select("c_custkey", transforms.metro_region(density).alias("region"))


@query("wallet_provider_rule", """SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 AND value > 20 THEN 'w' || CAST(user_id % 3 AS VARCHAR) END AS wallet_provider FROM events""")
def _wallet_provider_rule(spark, d):
    user = F.col("customer_token")
    return census.sessions(spark, d).select(F.col("txn_id").alias("event_id"), transforms.wallet_provider_rule(
        F.when(F.col("banner_code") == "click", "contactless").otherwise("chip"), user % 2 == 0, F.col("subtotal") > 20,
        F.concat(F.lit("w"), (user % 3).cast("string")),
    ).alias("wallet_provider"))


@query("entry_mode_distribution", f"""WITH {VI}, b AS (SELECT banner_code AS "group", entry_mode, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY banner_code) AS share FROM vi GROUP BY 1, 2)
  SELECT b."group", b.entry_mode, round(b.share + CASE b.entry_mode WHEN 'R' THEN least(c.share, 0.15::DOUBLE) WHEN 'A' THEN -least(c.share, 0.15::DOUBLE) ELSE 0 END, 12) AS share
  FROM b JOIN b c ON c."group" = b."group" AND c.entry_mode = 'A'""")
def _entry_mode_distribution(spark, d):
    counts = census.visits(spark, d).groupBy(F.col("banner_code").alias("group"), "entry_mode").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("t"))
    base = counts.join(totals, "group").select("group", "entry_mode", (F.col("n") / F.col("t")).alias("share"))
    return transforms.entry_mode_distribution(base, "R", "A").withColumn("share", F.round("share", 12))


CARRIAGE = {"core": {"A": 1.0, "B": 1.0, "C": 1.0}, "premium": {"A": 0.6, "B": 1.0, "C": 0.22}, "value": {"A": 0.6, "B": 0.24, "C": 1.0}}
UNI = "(CAST('0x' || substr(sha256({}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"
AS = f"""{PR}, r AS (SELECT *, ['core', 'premium', 'value'][sku % 3 + 1] AS role, unnest(['A', 'B', 'C']) AS banner_code FROM pr),
asx AS (SELECT * FROM r WHERE {UNI.format("'carry|' || banner_code || '|' || sku")} < CASE role WHEN 'core' THEN 1.0 WHEN 'premium' THEN CASE banner_code WHEN 'A' THEN 0.6 WHEN 'B' THEN 1.0 ELSE 0.22 END
  ELSE CASE banner_code WHEN 'A' THEN 0.6 WHEN 'B' THEN 0.24 ELSE 1.0 END END::DOUBLE)"""


def _assortment(spark, d):
    role = F.get(F.array(F.lit("core"), F.lit("premium"), F.lit("value")), (F.col("sku") % 3).cast("int"))
    return transforms.hash_assortment(census.products(spark, d).withColumn("role", role), "role", "sku", CARRIAGE)


@query("hash_assortment", f"WITH {AS} SELECT sku, banner_code, role FROM asx")
def _hash_assortment(spark, d):
    return _assortment(spark, d).select("sku", "banner_code", "role")


@query("shelf_price", f"""WITH {AS} SELECT sku, banner_code, round_even(shelf_price * (0.85::DOUBLE + 0.3::DOUBLE * (size / 50.0::DOUBLE)) * (1.0::DOUBLE + (CASE banner_code WHEN 'A' THEN 1.04 ELSE 0.97 END::DOUBLE - 1)
  * CASE WHEN size < 10 THEN 0.35 WHEN size > 45 THEN 1.5 ELSE 1.0 END::DOUBLE) * (1.0::DOUBLE + ({UNI.format("'comp|' || banner_code || '|' || sku")} - 0.5::DOUBLE) * 0.10::DOUBLE)
  * CASE WHEN private_label THEN 0.8 ELSE 1.0 END::DOUBLE * 100, 0) / 100 AS price FROM asx""")
def _shelf_price(spark, d):
    size = F.col("size")
    return _assortment(spark, d).select("sku", "banner_code", transforms.shelf_price(
        F.col("shelf_price"), F.lit(0.85) + F.lit(0.3) * (size / 50.0), F.when(F.col("banner_code") == "A", 1.04).otherwise(0.97),
        size < 10, size > 45, F.col("private_label"), F.lit(0.8), F.col("banner_code"), F.col("sku").cast("string"),
    ).alias("price"))


@query("affinity_pair_validity", """WITH n AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 7 = 0 THEN ' (old)' ELSE '' END AS subcategory FROM part UNION SELECT p_name FROM part)
  SELECT subcategory FROM n WHERE subcategory NOT IN (SELECT p_name FROM part)""")
def _affinity_pair_validity(spark, d):
    p = census.products(spark, d)
    pairs = p.select(
        F.concat("subcategory", F.when(F.col("sku") % 7 == 0, " (old)").otherwise("")).alias("anchor"),
        F.col("subcategory").alias("partner"),
    )
    return transforms.affinity_pair_validity(pairs, p)


@query("panel_invariants", f"""WITH {MR}, {ST} SELECT 'weights_sum_to_one' AS rule, CAST(abs(sum((n_nationkey + 1) / 325.0) - 1) > 0.000000001 AS BIGINT) AS violations FROM nation
  UNION ALL SELECT 'unknown_segment', count(*) FROM mr WHERE segment NOT IN (SELECT r_name FROM region WHERE r_name <> 'ASIA')
  UNION ALL SELECT 'unknown_zone', count(*) FROM st WHERE zone_id NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'store_count_differs', count(*) FROM mr WHERE store_count <> (SELECT count(*) FROM st WHERE st.banner_code = mr.banner_code)
  UNION ALL SELECT 'attractiveness_not_positive', count(*) FROM mr WHERE merchant_no % 5 = 0
  UNION ALL SELECT 'store_total_differs', CAST(sum(store_count) <> 100 AS BIGINT) FROM mr""")
def _panel_invariants(spark, d):
    """A panel in which one segment is undeclared and some merchants have no attraction."""
    m = census.merchants(spark, d).withColumn("attractiveness", (F.col("merchant_no") % 5).cast("double"))
    segments = census.table(spark, d, "region").filter(F.col("r_name") != "ASIA").select(F.col("r_name").alias("segment"))
    return transforms.panel_invariants(m, census.stores(spark, d), census.zones(spark, d), segments, 100)


@query("credit_propensity", """SELECT c_custkey, round(1 / (1 + exp(-(0.05::DOUBLE + 2.5::DOUBLE * (c_acctbal / 5000 - 1)))), 9) AS p_credit FROM customer""")
def _credit_propensity(spark, d):
    return census.table(spark, d, "customer").select(
        "c_custkey", F.round(transforms.credit_propensity(F.col("c_acctbal") / 5000), 9).alias("p_credit")
    )


@query("department_tilt", """WITH b AS (SELECT * FROM (VALUES ('PROMO', 0.5, 0.4), ('SMALL', 0.3, -0.2), ('LARGE', 0.2, 0.0)) v(department, w, k)),
  o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS banner_code, c_acctbal / 5000 AS affluence FROM orders JOIN customer ON c_custkey = o_custkey)
  SELECT o_orderkey AS txn_id, department, round(w::DOUBLE * exp(k::DOUBLE * (affluence - 1)) * CASE WHEN day BETWEEN DATE '2000-04-01' AND DATE '2000-04-30' AND department = 'PROMO' THEN 1.3 ELSE 1.0 END::DOUBLE
  * CASE WHEN banner_code = 'NATION_3' AND department = 'LARGE' THEN 1.2 ELSE 1.0 END::DOUBLE, 9) AS weight FROM o, b""")
def _department_tilt(spark, d):
    cust = census.customers(spark, d).select("customer_token", (F.col("affluence") / 5000).alias("affluence"), F.col("primary_banner").alias("banner_code"))
    rows = census.orders(spark, d).join(cust, "customer_token").select("txn_id", F.col("txn_ts").cast("date").alias("day"), "banner_code", "affluence")
    out = transforms.department_tilt(
        rows, {"PROMO": 0.5, "SMALL": 0.3, "LARGE": 0.2}, {"PROMO": 0.4, "SMALL": -0.2},
        [(dt.date(2000, 4, 1), dt.date(2000, 4, 30), 1.3, ["PROMO"])], {("NATION_3", "LARGE"): 1.2},
    )
    return out.select("txn_id", "department", F.round("weight", 9).alias("weight"))


@query("k_ladder", f"""WITH {PR}, {IT}, {TX}, c AS (SELECT department AS category, category AS subcategory, CAST(date_trunc('week', txn_ts) AS DATE) AS week, count(*) AS n, {total('qty')} AS units FROM it JOIN pr USING (sku) JOIN tx USING (txn_id) GROUP BY 1, 2, 3),
  w AS (SELECT category, week, {total('n')} AS n, {total('units')} AS units FROM c WHERE n < 50 GROUP BY 1, 2),
  m AS (SELECT category, CAST(date_trunc('month', week) AS DATE) AS month, {total('n')} AS n, {total('units')} AS units FROM w WHERE n < 50 GROUP BY 1, 2)
  SELECT 'subcategory_week' AS grain, category, subcategory, week AS period, n, units FROM c WHERE n >= 50 UNION ALL SELECT 'category_week', category, NULL, week, n, units FROM w WHERE n >= 50
  UNION ALL SELECT 'category_month', category, NULL, month, n, units FROM m WHERE n >= 50 UNION ALL SELECT 'suppressed', NULL, NULL, NULL, coalesce({total('n')}, 0), coalesce({total('units')}, 0) FROM m WHERE n < 50""")
def _k_ladder(spark, d):
    lines = product_lines(spark, d, "department", "category").join(census.orders(spark, d), "txn_id")
    return aggregates.k_ladder(lines.select(F.col("department").alias("category"), F.col("category").alias("subcategory"), "txn_ts", "qty"), 50)


@query("category_metrics", f"""WITH {LNT}, c AS (SELECT banner_code, department AS category, CAST(date_trunc('month', txn_ts) AS DATE) AS month, count(*) AS n_lines, {avg_money('unit_price')} AS price, {money('unit_price')} AS p,
  {money('line_total')} AS revenue, {total('qty')} AS units FROM lnt GROUP BY 1, 2, 3), m AS (SELECT category, month, {money('p')} / sum(n_lines) AS mp, {money('revenue')} / count(*) AS mr, CAST(sum(units) AS DOUBLE) / count(*) AS mu FROM c GROUP BY 1, 2),
  x AS (SELECT c.*, mp, mr, mu, lag(revenue) OVER (PARTITION BY banner_code, category ORDER BY month) AS prev FROM c JOIN m USING (category, month))
  SELECT banner_code, category, month, n_lines, price / mp AS price_index, revenue / mr AS revenue_index, units / mu AS units_index, revenue / nullif(prev, 0) - 1 AS revenue_delta FROM x WHERE n_lines >= 50""")
def _category_metrics(spark, d):
    return aggregates.category_metrics(timed_lines(spark, d).withColumn("category", F.col("department")), 50)


@query("payment_mix_by_zone_month", f"""WITH {VI}, c AS (SELECT banner_code, neighborhood, CAST(date_trunc('month', txn_ts) AS DATE) AS month, tender, count(*) AS n FROM vi GROUP BY 1, 2, 3, 4),
  t AS (SELECT banner_code, neighborhood, month, sum(n) AS t FROM c GROUP BY 1, 2, 3) SELECT c.*, CAST(n AS DOUBLE) / CAST(t AS DOUBLE) AS share FROM c JOIN t USING (banner_code, neighborhood, month) WHERE t >= 50""")
def _payment_mix_by_zone_month(spark, d):
    return aggregates.payment_mix_by_zone_month(census.visits(spark, d), 50)


@query("trade_area_share", f"""WITH {LNT}, c AS (SELECT neighborhood, category, banner_code, count(*) AS n, {money('line_total')} AS sales FROM ln GROUP BY 1, 2, 3), z AS (SELECT neighborhood, category, {money('sales')} AS t, sum(n) AS k FROM c GROUP BY 1, 2)
  SELECT neighborhood, category, banner_code, sales, sales / t AS share_of_zone FROM c JOIN z USING (neighborhood, category) WHERE k >= 50""")
def _trade_area_share(spark, d):
    return aggregates.trade_area_share(panel_lines(spark, d))


@query("cross_merchant_cohorts", f"""WITH {VI}, {CU}, p AS (SELECT customer_token, string_agg(DISTINCT segment, ',' ORDER BY segment) AS combination, {money('subtotal')} AS spend, count(*) AS visits FROM vi GROUP BY 1),
  h AS (SELECT * FROM p JOIN cu USING (customer_token)) SELECT home_zone, combination, count(*) AS cohort_size, round(quantile_cont(spend, 0.25), 6) AS p25_spend, round(quantile_cont(spend, 0.5), 6) AS median_spend, round(quantile_cont(spend, 0.75), 6) AS p75_spend,
  CASE WHEN quantile_cont(visits::DOUBLE, 0.5) < 10 THEN 'light' WHEN quantile_cont(visits::DOUBLE, 0.5) < 40 THEN 'medium' ELSE 'heavy' END AS frequency_band FROM h GROUP BY 1, 2 HAVING count(*) >= 50""")
def _cross_merchant_cohorts(spark, d):
    out = aggregates.cross_merchant_cohorts(census.visits(spark, d), census.customers(spark, d), 50)
    return rounded(out, "p25_spend", "median_spend", "p75_spend")


@query("behavioural_segments", f"""WITH {VI}, p AS (SELECT banner_code, customer_token, count(*) AS visits, {money('subtotal')} / count(*) AS basket FROM vi GROUP BY 1, 2),
  q AS (SELECT quantile_cont(visits::DOUBLE, 1.0::DOUBLE / 3) AS va, quantile_cont(visits::DOUBLE, 2.0::DOUBLE / 3) AS vb, quantile_cont(basket, 1.0::DOUBLE / 3) AS ba, quantile_cont(basket, 2.0::DOUBLE / 3) AS bb FROM p),
  s AS (SELECT banner_code, CASE WHEN visits <= va THEN 'rare' WHEN visits <= vb THEN 'regular' ELSE 'frequent' END || '/' || CASE WHEN basket <= ba THEN 'small' WHEN basket <= bb THEN 'mid' ELSE 'large' END AS behaviour, count(*) AS cards FROM p, q GROUP BY 1, 2)
  SELECT banner_code, behaviour, cards, CAST(cards AS DOUBLE) / CAST(sum(cards) OVER (PARTITION BY banner_code) AS DOUBLE) AS share FROM s QUALIFY cards >= 50""")
def _behavioural_segments(spark, d):
    return aggregates.behavioural_segments(census.visits(spark, d))
