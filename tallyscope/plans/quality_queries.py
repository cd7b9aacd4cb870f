"""Quality-battery and report queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyscope.functions.calendar import pay_cycle, stage_of
from tallyscope.operators import quality, report
from tallyscope.plans.basket_queries import panel_lines, product_lines
from tallyscope.plans.registry import query
from tallyscope.plans.sql import CU, IT, LN, LNT, PR, SE, ST, TX, VI, avg_money, money, ratio, share, total
from tallyscope.sources import census, readers, sinks

FRESH = census.FRESH_DEPARTMENTS
FRESH_SQL = "department IN ('PROMO', 'STANDARD')"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def timed_lines(spark, d, banners=None):
    lines = panel_lines(spark, d) if banners is None else panel_lines(spark, d).filter(F.col("banner_code").isin(*banners))
    return lines.join(census.orders(spark, d), "txn_id")


def affluent_lines(spark, d):
    cust = census.customers(spark, d).select("customer_token", "affluence")
    return product_lines(spark, d, "department", "private_label").join(census.orders(spark, d), "txn_id").join(
        cust, "customer_token"
    )


@query("volume_by_segment", f"""WITH {SE}, g AS (SELECT 'total' AS segment, count(*) AS n FROM se UNION ALL SELECT segment, count(*) FROM se GROUP BY 1),
  e AS (SELECT *, CASE segment WHEN 'total' THEN 10000 WHEN 'browse' THEN 6000 WHEN 'commit' THEN 4000 END::DOUBLE AS expected FROM g)
  SELECT *, n BETWEEN expected * 0.7 AND expected * 1.2 AS in_band FROM e""")
def _volume_by_segment(spark, d):
    return quality.volume_by_segment(census.sessions(spark, d), {"total": 10000, "browse": 6000, "commit": 4000})


@query("average_ticket", f"WITH {VI} SELECT segment, banner_code, count(*) AS n_txns, {avg_money('subtotal')} AS aov FROM vi GROUP BY 1, 2")
def _average_ticket(spark, d):
    return quality.average_ticket(census.visits(spark, d), ["segment", "banner_code"])


@query("store_auv", f"""WITH {VI} SELECT banner_code, {money('s')} / count(*) * (365.0::DOUBLE / 90) / 0.01::DOUBLE AS auv FROM
  (SELECT banner_code, store_id, {money('subtotal')} AS s FROM vi GROUP BY 1, 2) GROUP BY 1""")
def _store_auv(spark, d):
    return quality.store_auv(census.visits(spark, d), scale=0.01)


@query("banner_dollar_split", f"""WITH {VI}, p AS (SELECT segment, banner_code, {money('subtotal')} AS dollars FROM vi GROUP BY 1, 2),
  t AS (SELECT segment, {money('dollars')} AS t FROM p GROUP BY 1)
  SELECT segment, banner_code, dollars, dollars / t AS share, dollars / nullif(round_even((t - dollars) * 100, 0) / 100, 0) AS ratio_to_others FROM p JOIN t USING (segment)""")
def _banner_dollar_split(spark, d):
    return quality.banner_dollar_split(census.visits(spark, d))


@query("weekend_ratio", f"""WITH {SE} SELECT banner_code, (CAST(count(*) FILTER (WHERE isodow(txn_ts) >= 6) AS DOUBLE) / 2) / (CAST(count(*) FILTER (WHERE isodow(txn_ts) <= 5) AS DOUBLE) / 5)
  AS weekend_weekday_ratio FROM se GROUP BY 1""")
def _weekend_ratio(spark, d):
    return quality.weekend_ratio(census.sessions(spark, d), ["banner_code"])


H = "extract(hour FROM txn_ts)"


@query("daypart_share", f"""WITH {SE} SELECT banner_code, {share(f'{H} >= 21 OR {H} < 3')} AS late_night, {share(f'{H} >= 6 AND {H} < 10')} AS breakfast,
  count(*) FILTER (WHERE isodow(txn_ts) = 7) AS closed_day_txns FROM se GROUP BY 1""")
def _daypart_share(spark, d):
    return quality.daypart_share(census.sessions(spark, d), {"late_night": (21, 3), "breakfast": (6, 10)})


PC = """(CAST(count(*) FILTER (WHERE day(txn_ts) <= 10) AS DOUBLE) / 10) AS early, (CAST(count(*) FILTER (WHERE day(txn_ts) BETWEEN 15 AND 17) AS DOUBLE) / 3) AS mid,
  (CAST(count(*) FILTER (WHERE day(txn_ts) BETWEEN 20 AND 28) AS DOUBLE) / 9) AS flat"""


@query("pay_cycle_lift", f"WITH {TX} SELECT *, early / flat AS early_lift, mid / flat AS mid_lift FROM (SELECT {PC} FROM tx)")
def _pay_cycle_lift(spark, d):
    return quality.pay_cycle_lift(census.orders(spark, d))


@query("pay_cycle_bucket", f"""WITH {TX} SELECT CASE WHEN day(txn_ts) <= 10 THEN 'early' WHEN day(txn_ts) BETWEEN 15 AND 17 THEN 'mid' ELSE 'late' END AS bucket,
  count(*) AS n FROM tx GROUP BY 1""")
def _pay_cycle_bucket(spark, d):
    return census.orders(spark, d).groupBy(pay_cycle(F.col("txn_ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("pay_cycle_daily_avg", f"""WITH {SE}, dl AS (SELECT banner_code, CAST(txn_ts AS DATE) AS day, count(*) AS n FROM se GROUP BY 1, 2),
  b AS (SELECT *, CASE WHEN day(day) <= 3 THEN '1-3' WHEN day(day) BETWEEN 15 AND 17 THEN '15-17' WHEN day(day) BETWEEN 11 AND 13 THEN '11-13' ELSE 'other' END AS bucket FROM dl)
  SELECT bucket, {', '.join(f"coalesce(CAST(sum(n) FILTER (WHERE banner_code = '{e}') AS DOUBLE) / count(*) FILTER (WHERE banner_code = '{e}'), 0) AS {e}" for e in EVENT_TYPES)} FROM b GROUP BY 1""")
def _pay_cycle_daily_avg(spark, d):
    return report.pay_cycle_daily_avg(census.sessions(spark, d), EVENT_TYPES)


@query("private_label_share", f"""WITH {LN} SELECT banner_code, {ratio('sum(CASE WHEN private_label THEN qty ELSE 0 END)', 'sum(qty)')} AS pl_unit_share FROM ln GROUP BY 1""")
def _private_label_share(spark, d):
    return quality.private_label_share(panel_lines(spark, d))


@query("department_share", f"""WITH {PR}, {IT}, p AS (SELECT department, {money('line_total')} AS dollars FROM it JOIN pr USING (sku) GROUP BY 1), t AS (SELECT {money('dollars')} AS t FROM p)
  SELECT department, dollars, dollars / t AS share FROM p, t UNION ALL SELECT 'center_store', {money('dollars')}, {money('dollars')} / any_value(t) FROM p, t
  WHERE department IN ('SMALL', 'MEDIUM', 'LARGE')""")
def _department_share(spark, d):
    return quality.department_share(product_lines(spark, d, "department"), ["SMALL", "MEDIUM", "LARGE"], "center_store")


AL = f"""{PR}, {IT}, {TX}, {CU}, al AS (SELECT it.*, pr.* EXCLUDE (sku), tx.* EXCLUDE (txn_id), affluence FROM it JOIN pr USING (sku) JOIN tx USING (txn_id) JOIN cu USING (customer_token))"""


@query("fresh_by_affluence", f"""WITH {AL}, q AS (SELECT quantile_cont(affluence, 0.33) AS q1, quantile_cont(affluence, 0.66) AS q2 FROM al)
  SELECT CASE WHEN affluence < q1 THEN 'low' WHEN affluence > q2 THEN 'high' ELSE 'mid' END AS tier, count(*) AS n_lines,
  {money('line_total', FRESH_SQL)} / {money('line_total')} AS fresh_share FROM al, q GROUP BY 1""")
def _fresh_by_affluence(spark, d):
    return quality.fresh_by_affluence(affluent_lines(spark, d), FRESH)


@query("affluence_ntile", f"""WITH {AL}, h AS (SELECT *, CAST('0x' || substr(sha256(txn_id || '|' || line_id || '|' || sku || '|' || store_id || '|' || qty), 1, 12) AS BIGINT) AS tie FROM al),
  n AS (SELECT *, ntile(3) OVER (ORDER BY affluence, tie) AS tile FROM h)
  SELECT CAST(tile AS INT) AS tile, count(*) AS n_lines, {money('line_total', FRESH_SQL)} / {money('line_total')} AS fresh_share FROM n GROUP BY 1""")
def _affluence_ntile(spark, d):
    return quality.affluence_ntile(affluent_lines(spark, d), FRESH, ["txn_id", "line_id", "sku", "store_id", "qty"])


@query("tier_profile", f"""WITH {VI}, {CU}, {PR}, t AS (SELECT vi.*, affluence FROM vi JOIN cu USING (customer_token)),
  l AS (SELECT it.qty, it.line_total, department, private_label, affluence FROM it JOIN pr USING (sku) JOIN tx USING (txn_id) JOIN cu USING (customer_token)),
  q AS (SELECT quantile_cont(affluence, 0.33) AS q1, quantile_cont(affluence, 0.66) AS q2 FROM t),
  a AS (SELECT CASE WHEN affluence < q1 THEN 'low' WHEN affluence > q2 THEN 'high' ELSE 'mid' END AS tier, {avg_money('subtotal')} AS basket,
    CAST(sum(n_lines) AS DOUBLE) / count(*) AS items, {share("tender = '1-URGENT'")} AS credit, {share("entry_mode = 'R'")} AS contactless FROM t, q GROUP BY 1),
  b AS (SELECT CASE WHEN affluence < q1 THEN 'low' WHEN affluence > q2 THEN 'high' ELSE 'mid' END AS tier,
    {ratio('sum(CASE WHEN private_label THEN qty ELSE 0 END)', 'sum(qty)')} AS pl_share, {money('line_total', FRESH_SQL)} / {money('line_total')} AS fresh_share FROM l, q GROUP BY 1)
  SELECT * FROM a JOIN b USING (tier)""")
def _tier_profile(spark, d):
    cust = census.customers(spark, d).select("customer_token", "affluence")
    txns = census.visits(spark, d).join(cust, "customer_token")
    return quality.tier_profile(txns, affluent_lines(spark, d), FRESH, "1-URGENT", "R")


@query("payment_rates", f"""WITH {VI} SELECT banner_code, {share("entry_mode = 'R'")} AS contactless, {share('wallet_at_tap')} AS wallet_tap,
  {share("tender = '5-LOW'")} AS debit FROM vi GROUP BY 1""")
def _payment_rates(spark, d):
    return quality.payment_rates(census.visits(spark, d), "R", "5-LOW")


@query("price_equality_check", f"""WITH {PR}, {IT} SELECT count(*) AS n_lines, count(*) FILTER (WHERE round_even(unit_price * 100, 0) <> round_even(shelf_price * 100, 0)) AS n_mismatch
  FROM it JOIN pr USING (sku)""")
def _price_equality_check(spark, d):
    return quality.price_equality_check(product_lines(spark, d, "shelf_price"))


def banner_products(spark, d):
    """A catalogue with banners: a product belongs to one of five banners by its key."""
    return census.products(spark, d).withColumn("banner_code", F.concat(F.lit("B"), (F.col("sku") % 5).cast("string")))


BP = f"{PR}, bp AS (SELECT *, 'B' || CAST(sku % 5 AS VARCHAR) AS banner_code FROM pr)"


@query("cheapest_banner_share", f"""WITH {BP}, m AS (SELECT subcategory, banner_code, quantile_cont(shelf_price, 0.5) AS mp FROM bp GROUP BY 1, 2),
  w AS (SELECT * FROM m WHERE subcategory IN (SELECT subcategory FROM m GROUP BY 1 HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY subcategory ORDER BY mp, banner_code) = 1)
  SELECT banner_code, count(*) AS wins, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100 AS share_pct FROM w GROUP BY 1""")
def _cheapest_banner_share(spark, d):
    return quality.cheapest_banner_share(banner_products(spark, d))


@query("pl_price_gap", f"""WITH {BP}, g AS (SELECT banner_code, department, {avg_money('shelf_price', 'NOT private_label')} AS nb, {avg_money('shelf_price', 'private_label')} AS pl FROM bp GROUP BY 1, 2)
  SELECT count(*) AS n_groups, CAST(sum(CAST(round_even((1 - pl / nb) * 100000000, 0) AS BIGINT)) AS DOUBLE) / 100000000 / count(*) AS gap FROM g WHERE nb IS NOT NULL AND pl IS NOT NULL""")
def _pl_price_gap(spark, d):
    return quality.pl_price_gap(banner_products(spark, d), ["banner_code", "department"])


def promotions(spark, d):
    """One promotion per product: promo Pk runs for 20 days from a date fixed by k."""
    p = census.table(spark, d, "part")
    k = (F.col("p_partkey") % 10).cast("int")
    start = F.date_add(F.lit(dt.date(2000, 1, 1)), k * 15)
    return p.select(
        F.concat(F.lit("P"), k.cast("string")).alias("promo_id"), F.col("p_partkey").alias("sku"),
        start.alias("start_date"), F.date_add(start, 19).alias("end_date"), ((k + 1) / 100.0).alias("depth_pct"),
    )


PROMO = """promo AS (SELECT 'P' || CAST(p_partkey % 10 AS VARCHAR) AS promo_id, p_partkey AS sku, DATE '2000-01-01' + CAST((p_partkey % 10) * 15 AS INT) AS start_date,
  DATE '2000-01-01' + CAST((p_partkey % 10) * 15 + 19 AS INT) AS end_date, (p_partkey % 10 + 1) / 100.0 AS depth_pct FROM part)"""


@query("dormant_table_check", f"""WITH {IT}, {PROMO} SELECT 'lines_with_promo' AS rule, count(promo_id) AS violations FROM it UNION ALL
  SELECT 'lines_with_discount', count(*) FILTER (WHERE discount <> 0) FROM it UNION ALL SELECT 'promotions', count(*) FROM promo UNION ALL
  SELECT 'anomalies', count(*) FROM events WHERE event_type = 'error'""")
def _dormant_table_check(spark, d):
    errors = census.sessions(spark, d).filter(F.col("banner_code") == "error")
    return quality.dormant_table_check(census.items(spark, d), promotions(spark, d), errors)


@query("referential_integrity", """SELECT 'item_txn' AS foreign_key, coalesce(sum(n), 0)::BIGINT AS orphan_rows, count(*) AS orphan_keys FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE k NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'item_product', coalesce(sum(n), 0)::BIGINT, count(*) FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE k NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'item_store', coalesce(sum(n), 0)::BIGINT, count(*) FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE k NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'txn_customer', coalesce(sum(n), 0)::BIGINT, count(*) FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'session_customer', coalesce(sum(n), 0)::BIGINT, count(*) FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) WHERE k NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'txn_item', coalesce(sum(n), 0)::BIGINT, count(*) FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k NOT IN (SELECT l_orderkey FROM lineitem)""")
def _referential_integrity(spark, d):
    it, tx, se = census.items(spark, d), census.orders(spark, d), census.sessions(spark, d)
    cust = census.customers(spark, d)
    return quality.referential_integrity([
        ("item_txn", it, "txn_id", tx, "txn_id"), ("item_product", it, "sku", census.products(spark, d), "sku"),
        ("item_store", it, "store_id", census.stores(spark, d), "store_id"),
        ("txn_customer", tx, "customer_token", cust, "customer_token"),
        ("session_customer", se, "customer_token", cust, "customer_token"),
        ("txn_item", tx, "txn_id", it, "txn_id"),
    ])


@query("lines_with_taxonomy", f"""WITH {PR}, {IT} SELECT txn_id, line_id, i.sku, qty, department, category, private_label, shelf_price
  FROM (SELECT * REPLACE (CASE WHEN line_id = 1 THEN -1 - sku ELSE sku END AS sku) FROM it) i LEFT JOIN pr ON pr.sku = i.sku""")
def _lines_with_taxonomy(spark, d):
    """The first line of every order is of a product that the whole catalogue lacks: it stays, without taxonomy."""
    items = census.items(spark, d)
    unknown = F.when(F.col("line_id") == 1, -1 - F.col("sku")).otherwise(F.col("sku"))
    return quality.lines_with_taxonomy(items.withColumn("sku", unknown), census.products(spark, d)).select(
        "txn_id", "line_id", "sku", "qty", "department", "category", "private_label", "shelf_price"
    )


@query("table_row_bands", f"""WITH {VI}, m AS (SELECT banner_code AS metric, {avg_money('subtotal')} AS value FROM vi GROUP BY 1),
  b AS (SELECT n_name AS metric, 30000.0::DOUBLE + n_nationkey * 1000 AS lo, 60000.0::DOUBLE AS hi FROM nation)
  SELECT metric, value, lo, hi, CASE WHEN value BETWEEN lo AND hi THEN 'PASS' ELSE 'WATCH' END AS status FROM m JOIN b USING (metric)""")
def _table_row_bands(spark, d):
    aov = quality.average_ticket(census.visits(spark, d), ["banner_code"])
    bands = census.table(spark, d, "nation").select(
        F.col("n_name").alias("metric"), (F.lit(30000.0) + F.col("n_nationkey") * 1000).alias("lo"), F.lit(60000.0).alias("hi")
    )
    return quality.banded(quality.band_rows(aov, F.col("banner_code"), F.col("aov")), bands)


@query("calibration_step", f"""WITH {VI}, s AS (SELECT banner_code, {money('subtotal')} AS s FROM vi WHERE banner_code IN ('NATION_3', 'NATION_8', 'NATION_13') GROUP BY 1),
  t AS (SELECT banner_code, CASE banner_code WHEN 'NATION_3' THEN 0.52 WHEN 'NATION_8' THEN 0.31 ELSE 0.17 END::DOUBLE AS target, s / (SELECT {money('s')} FROM s) AS actual FROM s)
  SELECT banner_code, target, actual, round(pow(target / greatest(actual, 0.000001), 0.6), 9) AS factor, round(pow(target / greatest(actual, 0.000001), 0.6), 3) AS next_weight FROM t""")
def _calibration_step(spark, d):
    out = quality.calibration_step(
        census.visits(spark, d), {"NATION_3": 0.52, "NATION_8": 0.31, "NATION_13": 0.17}, F.lit(1.0)
    )
    return out.withColumn("factor", F.round("factor", 9))


ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority
  || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) || '}'"""


@query("table_content_hash", f"""SELECT 'orders' AS "table", count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256({ORDER_JSON}), 1, 12) AS HUGEINT)) AS VARCHAR) AS hash_sum FROM orders""")
def _table_content_hash(spark, d):
    return sinks.content_hash(census.table(spark, d, "orders"), "orders")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())))
def _row_counts(spark, d):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    return readers.row_counts({t: spark.read.parquet(f"{d}/{t}.parquet") for t in names.split()})


KEYS = {
    "region": ("r_regionkey", ""), "nation": ("n_nationkey", "n_regionkey"), "supplier": ("s_suppkey", "s_nationkey"),
    "customer": ("c_custkey", "c_nationkey"), "part": ("p_partkey", ""), "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey,l_linenumber", "l_orderkey,l_partkey,l_suppkey"), "events": ("event_id", "user_id"),
}


def _catalogue_sql():
    rows = []
    for t, (pk, fk) in KEYS.items():
        for column in census.SCHEMAS[t].split(", "):
            c, kind = column.split()
            flags = ["true" if c in keys.split(",") else "false" for keys in (pk, fk)]
            rows.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", '{kind}' AS type, {flags[0]} AS primary_key, {flags[1]} AS join_key, count({c}) AS n_values FROM {t}""")
    return " UNION ALL ".join(rows)


@query("schema_catalogue", _catalogue_sql())
def _schema_catalogue(spark, d):
    return readers.schema_catalogue({t: census.table(spark, d, t) for t in KEYS}, KEYS)


@query("allowlisted_read", """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders""")
def _allowlisted_read(spark, d):
    allow = {"orders": ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"]}
    return readers.allowlisted_read(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"], allow, ["customer"])


@query("source_path_guard", """SELECT s_suppkey, s_name FROM supplier""")
def _source_path_guard(spark, d):
    return readers.check_source_paths(census.table(spark, d, "supplier"), f"{d}/eval").select("s_suppkey", "s_name")


@query("store_rollup", f"""WITH {VI} SELECT store_id, banner_code, segment, {money('subtotal')} AS dollars, count(*) AS txns, {avg_money('subtotal')} AS basket,
  CAST(sum(n_lines) AS DOUBLE) / count(*) AS items, {money('subtotal')} * (365.0::DOUBLE / 90) AS auv FROM vi GROUP BY 1, 2, 3""")
def _store_rollup(spark, d):
    return report.store_rollup(census.visits(spark, d))


@query("weekly_volume", f"WITH {TX} SELECT CAST(date_trunc('week', txn_ts) AS DATE) AS week, count(*) AS txns FROM tx GROUP BY 1")
def _weekly_volume(spark, d):
    return report.weekly_volume(census.orders(spark, d))


@query("seasonal_index", f"""WITH {PR}, {IT}, {TX}, w AS (SELECT department, CAST(date_trunc('week', txn_ts) AS DATE) AS week, {total('qty')} AS u FROM it JOIN pr USING (sku) JOIN tx USING (txn_id) GROUP BY 1, 2),
  s AS (SELECT 'all' AS series, week, {total('u')} AS units FROM w GROUP BY 2 UNION ALL SELECT 'grill', week, {total('u')} FROM w WHERE department IN ('LARGE', 'PROMO') GROUP BY 2),
  r AS (SELECT series, CAST(sum(units) FILTER (WHERE week BETWEEN DATE '2000-01-03' AND DATE '2000-01-31') AS DOUBLE) / count(*) FILTER (WHERE week BETWEEN DATE '2000-01-03' AND DATE '2000-01-31') AS b,
  max(units) FILTER (WHERE week BETWEEN DATE '2000-05-01' AND DATE '2000-05-29') AS p FROM s GROUP BY 1) SELECT series, week, units, units / b AS index, p / b AS event_peak FROM s JOIN r USING (series)""")
def _seasonal_index(spark, d):
    lines = product_lines(spark, d, "department").join(census.orders(spark, d), "txn_id")
    groups = {"all": ["ECONOMY", "STANDARD", "MEDIUM", "SMALL", "LARGE", "PROMO"], "grill": ["LARGE", "PROMO"]}
    base, event = (dt.date(2000, 1, 3), dt.date(2000, 1, 31)), (dt.date(2000, 5, 1), dt.date(2000, 5, 29))
    return report.seasonal_index(lines, groups, base, event)


@query("hourly_distribution", f"""WITH {SE}, s AS (SELECT CAST(h AS INT) AS hour, b AS banner_code FROM range(24) r(h), (SELECT DISTINCT banner_code AS b FROM se)),
  c AS (SELECT banner_code, CAST(extract(hour FROM txn_ts) AS INT) AS hour, count(*) AS n FROM se GROUP BY 1, 2), t AS (SELECT banner_code, sum(n) AS t FROM c GROUP BY 1)
  SELECT hour, banner_code, coalesce(n, 0) AS n, CAST(coalesce(n, 0) * 100 AS DOUBLE) / CAST(t AS DOUBLE) AS pct FROM s LEFT JOIN c USING (hour, banner_code) JOIN t USING (banner_code)""")
def _hourly_distribution(spark, d):
    return report.hourly_distribution(census.sessions(spark, d), EVENT_TYPES)


@query("daily_volume_pivot", f"""WITH {SE} SELECT CAST(txn_ts AS DATE) AS date, {', '.join(f"count(*) FILTER (WHERE banner_code = '{b}') AS {b}" for b in EVENT_TYPES)} FROM se GROUP BY 1""")
def _daily_volume_pivot(spark, d):
    return report.daily_volume_pivot(census.sessions(spark, d), EVENT_TYPES)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("merchant_profile", f"""WITH {VI} SELECT banner_code, count(DISTINCT store_id) AS n_stores, count(DISTINCT customer_token) AS n_customers, count(*) AS n_transactions, {total('n_lines')} AS n_line_items,
  CAST(sum(n_units) AS DOUBLE) / count(*) AS avg_basket_size, {avg_money('subtotal')} AS avg_ticket, {', '.join(f"CAST(count(*) FILTER (WHERE tender = '{p}') * 100 AS DOUBLE) / count(*) AS pct_{i + 1}" for i, p in enumerate(PRIORITIES))} FROM vi GROUP BY 1""")
def _merchant_profile(spark, d):
    return report.merchant_profile(census.visits(spark, d), PRIORITIES)


@query("category_revenue_tree", f"""WITH {LN}, o AS (SELECT * FROM ln WHERE banner_code = 'NATION_3'), c AS (SELECT category, {money('line_total')} AS revenue, count(DISTINCT sku) AS sku_count FROM o GROUP BY 1)
  SELECT category, revenue, sku_count, subcategory, sub_revenue FROM c JOIN (SELECT category, subcategory, {money('line_total')} AS sub_revenue FROM o GROUP BY 1, 2) USING (category)""")
def _category_revenue_tree(spark, d):
    return report.category_revenue_tree(panel_lines(spark, d).filter(F.col("banner_code") == "NATION_3"))


@query("catalog_stats", f"WITH {PR} SELECT department, count(DISTINCT sku) AS n_skus, count(DISTINCT category) AS n_categories, count(DISTINCT subcategory) AS n_subcategories FROM pr GROUP BY 1")
def _catalog_stats(spark, d):
    return report.catalog_stats(census.products(spark, d), "department")


@query("daily_txn_stats", f"""WITH {VI} SELECT banner_code, count(*) AS n_days, CAST(sum(n) AS DOUBLE) / count(*) AS mean_daily, min(n) AS min_daily, max(n) AS max_daily
  FROM (SELECT banner_code, CAST(txn_ts AS DATE) AS day, count(*) AS n FROM vi GROUP BY 1, 2) GROUP BY 1""")
def _daily_txn_stats(spark, d):
    return report.daily_txn_stats(census.visits(spark, d))


@query("store_traffic_spread", f"""WITH {VI} SELECT banner_code, count(*) AS n_stores, CAST(sum(n) AS DOUBLE) / count(*) AS mean_txns, min(n) AS min_txns, max(n) AS max_txns,
  (max(n) - min(n)) * 100 / (CAST(sum(n) AS DOUBLE) / count(*)) AS range_pct_of_mean FROM (SELECT banner_code, store_id, count(*) AS n FROM vi GROUP BY 1, 2) GROUP BY 1""")
def _store_traffic_spread(spark, d):
    return report.store_traffic_spread(census.visits(spark, d))


@query("promo_vs_nonpromo_ticket", f"""WITH {ST}, {IT}, t AS (SELECT segment, txn_id, {money('line_total')} AS t, bool_or(promo_id IS NOT NULL) AS promo FROM it JOIN st USING (store_id) GROUP BY 1, 2),
  g AS (SELECT segment, count(*) FILTER (WHERE NOT promo) AS non_promo_txns, {avg_money('t', 'NOT promo')} AS non_promo_mean, count(*) FILTER (WHERE promo) AS promo_txns, {avg_money('t', 'promo')} AS promo_mean FROM t GROUP BY 1)
  SELECT *, (promo_mean / non_promo_mean - 1) * 100 AS promo_vs_non_pct FROM g""")
def _promo_vs_nonpromo_ticket(spark, d):
    lines = census.items(spark, d).join(census.stores(spark, d).select("store_id", "segment"), "store_id")
    return report.promo_vs_nonpromo_ticket(lines, "segment")


STAGES = [("0. Baseline", dt.date(2024, 1, 1), dt.date(2024, 1, 10)), ("1. Stage", dt.date(2024, 1, 11), dt.date(2024, 1, 17)),
          ("2. Stage", dt.date(2024, 1, 18), dt.date(2024, 1, 24))]
STAGE_SQL = """CASE WHEN day BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN '0. Baseline' WHEN day BETWEEN DATE '2024-01-11' AND DATE '2024-01-17' THEN '1. Stage'
  WHEN day BETWEEN DATE '2024-01-18' AND DATE '2024-01-24' THEN '2. Stage' END AS stage"""


def _stage_sql(unit):
    return f"""WITH {SE}, x AS (SELECT *, user AS store_id FROM (SELECT *, customer_token % 7 AS user FROM se)), dl AS (SELECT {unit}, CAST(txn_ts AS DATE) AS day, count(*) AS n FROM x GROUP BY ALL),
  s AS (SELECT *, {STAGE_SQL} FROM dl), a AS (SELECT banner_code, stage, CAST(sum(n) AS DOUBLE) / count(*) AS mean_daily, count(*) AS n_days FROM s WHERE stage IS NOT NULL GROUP BY 1, 2)
  SELECT a.banner_code, a.stage, a.mean_daily, a.n_days, a.mean_daily / b.mean_daily AS ratio_to_baseline FROM a JOIN a b ON a.banner_code = b.banner_code AND b.stage = '0. Baseline'"""


@query("stage_ratio", _stage_sql("banner_code"))
def _stage_ratio(spark, d):
    return report.stage_ratio(census.sessions(spark, d), STAGES, "0. Baseline")


@query("stage_ratio_per_store", _stage_sql("banner_code, store_id"))
def _stage_ratio_per_store(spark, d):
    s = census.sessions(spark, d).withColumn("store_id", F.col("customer_token") % 7)
    return report.stage_ratio(s, STAGES, "0. Baseline", ["banner_code", "store_id"])


@query("event_stage_label", f"""SELECT event_id, {STAGE_SQL} FROM (SELECT event_id, CAST(ts AS DATE) AS day FROM events)""")
def _event_stage_label(spark, d):
    s = census.sessions(spark, d)
    return s.select(F.col("txn_id").alias("event_id"), stage_of(F.col("txn_ts").cast("date"), STAGES).alias("stage"))


LIFTS = [("click", dt.date(2024, 1, 8), dt.date(2024, 1, 14)), ("view", dt.date(2024, 1, 12), dt.date(2024, 1, 18))]


@query("promo_lift_ratio", f"""WITH {SE}, dl AS (SELECT banner_code, CAST(txn_ts AS DATE) AS day, count(*) AS n FROM se WHERE banner_code IN ('click', 'view') GROUP BY 1, 2),
  f AS (SELECT *, day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AS a, day BETWEEN DATE '2024-01-12' AND DATE '2024-01-18' AS b FROM dl),
  g AS (SELECT banner_code, CAST(sum(n) FILTER (WHERE CASE banner_code WHEN 'click' THEN a ELSE b END) AS DOUBLE) / count(*) FILTER (WHERE CASE banner_code WHEN 'click' THEN a ELSE b END) AS in_window,
  CAST(sum(n) FILTER (WHERE NOT a AND NOT b) AS DOUBLE) / count(*) FILTER (WHERE NOT a AND NOT b) AS baseline FROM f GROUP BY 1) SELECT *, in_window / baseline AS ratio FROM g""")
def _promo_lift_ratio(spark, d):
    return report.promo_lift_ratio(census.sessions(spark, d), LIFTS)


BUCKETS = [("NATION_3", "0. before", dt.date(2000, 1, 1), dt.date(2000, 1, 31)), ("NATION_3", "1. promo", dt.date(2000, 2, 1), dt.date(2000, 2, 29)),
           ("NATION_8", "0. before", dt.date(2000, 1, 16), dt.date(2000, 2, 15)), ("NATION_8", "1. promo", dt.date(1990, 1, 1), dt.date(1990, 1, 9))]


def _pwu_sql(only):
    rows = ", ".join(f"('{b}', '{n}', DATE '{a}', DATE '{z}')" for b, n, a, z in BUCKETS)
    return f"""WITH {LNT}, pb AS (SELECT * FROM (VALUES {rows}) v(banner_code, bucket, a, z)) SELECT pb.banner_code, pb.bucket, coalesce({total('qty')}, 0) AS units, count(DISTINCT txn_id) AS txns
  FROM pb LEFT JOIN (SELECT * FROM lnt WHERE {only}) l ON l.banner_code = pb.banner_code AND CAST(txn_ts AS DATE) BETWEEN a AND z GROUP BY 1, 2"""


@query("promo_window_units", _pwu_sql("true"))
def _promo_window_units(spark, d):
    return report.promo_window_units(timed_lines(spark, d, ["NATION_3", "NATION_8"]), BUCKETS)


@query("promo_window_units_filtered", _pwu_sql("category = 'Brand#7'"))
def _promo_window_units_filtered(spark, d):
    lines = timed_lines(spark, d, ["NATION_3", "NATION_8"])
    return report.promo_window_units(lines, BUCKETS, F.col("category") == "Brand#7")


@query("top_categories_per_merchant", f"""WITH {LN}, p AS (SELECT banner_code, category, {money('line_total')} AS revenue FROM ln GROUP BY 1, 2), t AS (SELECT banner_code, {money('revenue')} AS t FROM p GROUP BY 1),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY banner_code ORDER BY revenue DESC, category) AS INT) AS category_rank FROM p)
  SELECT banner_code, category_rank, category, revenue, revenue / t * 100 AS pct_of_merchant FROM r JOIN t USING (banner_code) WHERE category_rank <= 5""")
def _top_categories_per_merchant(spark, d):
    return report.top_categories_per_merchant(panel_lines(spark, d))


@query("top_skus_per_merchant", f"""WITH {LN}, p AS (SELECT banner_code, sku, product_name, count(*) AS lines, {total('qty')} AS units FROM ln GROUP BY 1, 2, 3)
  SELECT *, CAST(row_number() OVER (PARTITION BY banner_code ORDER BY lines DESC, units DESC, sku) AS INT) AS sku_rank FROM p QUALIFY sku_rank <= 6""")
def _top_skus_per_merchant(spark, d):
    return report.top_skus_per_merchant(panel_lines(spark, d))


@query("store_counts_by_area", f"WITH {ST} SELECT banner_code, neighborhood, count(*) AS n_stores FROM st GROUP BY 1, 2")
def _store_counts_by_area(spark, d):
    return report.store_counts_by_area(census.stores(spark, d))


@query("panel_window", """SELECT CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS "end",
  CAST(CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE) + 1 AS INT) AS days FROM orders""")
def _panel_window(spark, d):
    return report.panel_window(census.orders(spark, d))


@query("union_rounded_dedup", f"""WITH a AS (SELECT l_returnflag AS k, l_linestatus AS s, l_discount + 0.00001 AS x, 0 AS src FROM lineitem UNION ALL
  SELECT l_returnflag, l_linestatus, l_discount + 0.00002, 1 FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, l_tax, 2 FROM lineitem)
  SELECT k, s, x FROM a QUALIFY row_number() OVER (PARTITION BY k, s, round(x, 4) ORDER BY src, x) = 1""")
def _union_rounded_dedup(spark, d):
    li = census.table(spark, d, "lineitem")
    def part(x):
        return li.select(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("s"), x.alias("x"))

    off = F.col("l_discount")
    return report.union_rounded_dedup([part(off + 0.00001), part(off + 0.00002), part(F.col("l_tax"))])
