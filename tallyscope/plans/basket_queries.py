"""Basket and customer queries.  A basket is an order; a merchant's visit is an order at one of its stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions.joins import parted_join
from tallyscope.operators import baskets, customers, lake
from tallyscope.plans.registry import query, rounded
from tallyscope.plans.sql import CU, IT, LN, PR, ST, VI, money, total
from tallyscope.sources import census


def product_lines(spark, d, *cols):
    return census.items(spark, d).join(census.products(spark, d).select("sku", *cols), "sku")


def panel_lines(spark, d):
    return lake.enriched_lines(census.items(spark, d), census.products(spark, d), census.stores(spark, d))


PAIRS = [("red plate", "small widget"), ("hot ring", "old rod"), ("red plate", "red plate")]


def _support_sql(pairs, a_col, p_col):
    rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS anchor, '{p}' AS partner, count(*) AS n_baskets, count(*) FILTER (WHERE list_contains(xa, '{a}')) AS support_anchor,
        CAST(count(*) FILTER (WHERE list_contains(xp, '{p}')) AS DOUBLE) / count(*) AS p_partner,
        CAST(count(*) FILTER (WHERE list_contains(xa, '{a}') AND list_contains(xp, '{p}')) AS DOUBLE)
          / nullif(count(*) FILTER (WHERE list_contains(xa, '{a}')), 0) AS p_cond FROM b""" for a, p in pairs)
    return f"""WITH {PR}, {IT}, b AS (SELECT txn_id, list(DISTINCT {a_col}) AS xa, list(DISTINCT {p_col}) AS xp FROM it JOIN pr USING (sku) GROUP BY 1),
  r AS ({rows}), l AS (SELECT *, p_cond / nullif(p_partner, 0) AS lift FROM r)"""


@query("affinity_support", f"{_support_sql(PAIRS, 'subcategory', 'subcategory')} SELECT * FROM l")
def _affinity_support(spark, d):
    return baskets.affinity_support(product_lines(spark, d, "subcategory"), PAIRS)


@query("affinity_lift", f"{_support_sql(PAIRS, 'subcategory', 'subcategory')} SELECT anchor, partner, p_partner, p_cond, lift FROM l")
def _affinity_lift(spark, d):
    return baskets.affinity_lift(product_lines(spark, d, "subcategory"), PAIRS)


CAT_PAIRS = [("Brand#7", "red plate"), ("Brand#3", "hot ring")]


@query("category_anchor_lift", f"{_support_sql(CAT_PAIRS, 'category', 'subcategory')} SELECT * FROM l")
def _category_anchor_lift(spark, d):
    lines = product_lines(spark, d, "category", "subcategory")
    return baskets.affinity_support(lines, CAT_PAIRS, "category", "subcategory")


@query("combo_attach", f"""WITH {LN}, b AS (SELECT segment, txn_id, bool_or(department = 'SMALL') AS a, bool_or(department = 'LARGE') AS s,
  bool_or(department = 'PROMO') AS d FROM ln GROUP BY 1, 2) SELECT segment, count(*) AS n_anchor,
  CAST(count(*) FILTER (WHERE s) AS DOUBLE) / count(*) AS side, CAST(count(*) FILTER (WHERE d) AS DOUBLE) / count(*) AS drink,
  CAST(count(*) FILTER (WHERE s AND d) AS DOUBLE) / count(*) AS "full" FROM b WHERE a GROUP BY 1""")
def _combo_attach(spark, d):
    return baskets.combo_attach(panel_lines(spark, d), "SMALL", "LARGE", "PROMO", by="segment", col="department")


@query("attach_rate", f"""WITH {PR}, {IT}, bk AS (SELECT DISTINCT txn_id, category AS g FROM it JOIN pr USING (sku)),
  base AS (SELECT g, count(*) AS a_baskets FROM bk GROUP BY 1), pair AS (SELECT a.g AS item_a, b.g AS item_b, count(*) AS both_ct
  FROM bk a JOIN bk b ON a.txn_id = b.txn_id AND a.g <> b.g GROUP BY 1, 2 HAVING count(*) >= 200)
  SELECT item_a, item_b, both_ct, a_baskets, CAST(both_ct AS DOUBLE) / a_baskets AS attach_rate FROM pair JOIN base ON item_a = g
  ORDER BY attach_rate DESC, both_ct DESC, item_a, item_b LIMIT 15""")
def _attach_rate(spark, d):
    return baskets.attach_rate(product_lines(spark, d, "category"), "category", 15)


@query("attach_rate_products", f"""WITH {IT}, bk AS (SELECT DISTINCT txn_id, sku AS g FROM it),
  base AS (SELECT g, count(*) AS a_baskets FROM bk GROUP BY 1), pair AS (SELECT a.g AS item_a, b.g AS item_b, count(*) AS both_ct
  FROM bk a JOIN bk b ON a.txn_id = b.txn_id AND a.g <> b.g GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT item_a, item_b, both_ct, a_baskets, CAST(both_ct AS DOUBLE) / a_baskets AS attach_rate FROM pair JOIN base ON item_a = g
  ORDER BY attach_rate DESC, both_ct DESC, item_a, item_b LIMIT 500""")
def _attach_rate_products(spark, d):
    """Products instead of categories: nearly all pairs are rare and end in the first pass."""
    return baskets.attach_rate(census.items(spark, d), "sku", 500, floor=2)


@query("top_companion", f"""WITH {ST}, {IT}, l AS (SELECT it.*, segment FROM it JOIN st USING (store_id)),
  a AS (SELECT segment, sku, count(*) AS n FROM l GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, sku) <= 3),
  c AS (SELECT a.segment, a.sku AS anchor, a.n AS anchor_lines, y.sku AS companion, count(*) AS co FROM a JOIN l x ON x.segment = a.segment AND x.sku = a.sku
  JOIN l y ON y.segment = x.segment AND y.txn_id = x.txn_id AND y.sku <> x.sku GROUP BY 1, 2, 3, 4)
  SELECT *, round(CAST(co AS DOUBLE) / anchor_lines, 2) AS prob FROM c QUALIFY row_number() OVER (PARTITION BY segment, anchor ORDER BY co DESC, companion) = 1""")
def _top_companion(spark, d):
    lines = census.items(spark, d).join(census.stores(spark, d).select("store_id", "segment"), "store_id")
    return baskets.top_companion(lines, "segment")


@query("basket_histogram", f"""WITH {IT} SELECT units, count(*) AS n_baskets FROM (SELECT least({total('qty')}, 150) AS units FROM it GROUP BY txn_id) GROUP BY 1""")
def _basket_histogram(spark, d):
    return baskets.basket_histogram(census.items(spark, d), 150)


SHAPE = """SELECT banner_code, count(*) AS n_txns, {mean} AS mean, round(quantile_cont({v}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({v}::DOUBLE, 0.95), 6) AS p95,
  min({v})::DOUBLE AS min, max({v})::DOUBLE AS max FROM vi GROUP BY 1"""


@query("basket_shape", f"WITH {VI} {SHAPE.format(v='n_units', mean='CAST(sum(n_units) AS DOUBLE) / count(*)')}")
def _basket_shape(spark, d):
    return rounded(baskets.basket_shape(census.visits(spark, d), "banner_code", "n_units"), "median", "p95")


@query("ticket_shape", f"WITH {VI} {SHAPE.format(v='subtotal', mean=money('subtotal') + ' / count(*)')}")
def _ticket_shape(spark, d):
    return rounded(baskets.basket_shape(census.visits(spark, d), "banner_code", "subtotal"), "median", "p95")


@query("heavy_tail_share", f"""WITH {ST}, {IT}, b AS (SELECT segment, txn_id, {total('qty')} AS u FROM it JOIN st USING (store_id) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY u DESC, txn_id) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM b)
  SELECT segment, {total('u')} AS total, {total('u', 'rn <= greatest(1, floor(n * 0.2::DOUBLE))')} AS top_total,
  CAST({total('u', 'rn <= greatest(1, floor(n * 0.2::DOUBLE))')} AS DOUBLE) / {total('u')} AS top_share FROM r GROUP BY 1""")
def _heavy_tail_share(spark, d):
    lines = census.items(spark, d).join(census.stores(spark, d).select("store_id", "segment"), "store_id")
    return baskets.heavy_tail_share(lines, ["segment"])


@query("basket_pattern_match", f"""WITH {PR}, {IT} SELECT txn_id, count(*) AS n_lines FROM it JOIN pr USING (sku) GROUP BY 1
  HAVING bool_or(category = 'Brand#3') AND bool_or(category = 'Brand#7') AND count(*) BETWEEN 4 AND 9 ORDER BY 1 LIMIT 5""")
def _basket_pattern_match(spark, d):
    lines = product_lines(spark, d, "category")
    return baskets.basket_pattern_match(lines, ["Brand#3", "Brand#7"], 4, 9, 5, col="category")


def card_visits(spark, d):
    """(customer, store's merchant) per order and store: lines meet their order, and are then told apart within its partition."""
    dims = census.stores(spark, d).select("store_id", "banner_code", "segment")
    seen = parted_join(census.items(spark, d).select("txn_id", "store_id"), census.orders(spark, d), "txn_id").distinct()
    return seen.join(dims, "store_id")


CV = f"{VI}, {CU}"


@query("merchant_pair_overlap", f"""WITH {VI}, cm AS (SELECT DISTINCT banner_code, customer_token FROM vi) SELECT a.banner_code AS merchant_a,
  b.banner_code AS merchant_b, count(*) AS shared_customers FROM cm a JOIN cm b ON a.customer_token = b.customer_token AND a.banner_code < b.banner_code GROUP BY 1, 2""")
def _merchant_pair_overlap(spark, d):
    return customers.merchant_pair_overlap(card_visits(spark, d))


@query("customer_fanout", f"""WITH {CV}, f AS (SELECT cu.customer_token, count(DISTINCT banner_code) AS m FROM cu LEFT JOIN vi USING (customer_token) GROUP BY 1)
  SELECT CAST(m AS INT) AS n_merchants, count(*) AS n_customers FROM f GROUP BY 1 UNION ALL SELECT 0, 0 WHERE NOT EXISTS (SELECT 1 FROM f WHERE m = 0)""")
def _customer_fanout(spark, d):
    return customers.customer_fanout(card_visits(spark, d), census.customers(spark, d))


@query("customer_merchant_sets", f"""WITH {VI}, f AS (SELECT customer_token, string_agg(DISTINCT segment, ',' ORDER BY segment) AS merchant_set FROM vi GROUP BY 1)
  SELECT merchant_set, count(*) AS n_customers FROM f GROUP BY 1""")
def _customer_merchant_sets(spark, d):
    return customers.customer_merchant_sets(card_visits(spark, d), "segment")


@query("cohort_sizes", f"""WITH {VI}, f AS (SELECT customer_token, count(DISTINCT banner_code) FILTER (WHERE banner_code IN ('NATION_3','NATION_8','NATION_13')) AS g,
  count(DISTINCT banner_code) FILTER (WHERE banner_code IN ('NATION_1','NATION_6')) AS o, count(DISTINCT banner_code) AS m FROM vi GROUP BY 1)
  SELECT count(*) FILTER (WHERE g = 3) AS n_at_all, count(*) FILTER (WHERE g >= 2) AS n_at_any_2, count(*) FILTER (WHERE g > 0 AND o > 0) AS n_at_both_groups,
  count(*) FILTER (WHERE m = (SELECT count(DISTINCT banner_code) FROM vi)) AS n_at_every FROM f""")
def _cohort_sizes(spark, d):
    return customers.cohort_sizes(card_visits(spark, d), ["NATION_3", "NATION_8", "NATION_13"], ["NATION_1", "NATION_6"])


@query("cohort_spend", f"""WITH {VI}, n AS (SELECT * FROM vi WHERE CAST(txn_ts AS DATE) >= (SELECT max(CAST(txn_ts AS DATE)) FROM vi) - 29),
  s AS (SELECT customer_token, banner_code, {money('subtotal')} AS s FROM n GROUP BY 1, 2), c AS (SELECT customer_token FROM s GROUP BY 1 HAVING count(*) >= 3)
  SELECT banner_code, count(*) AS n_customers, {money('s')} / count(*) AS avg_spend FROM s JOIN c USING (customer_token) GROUP BY 1""")
def _cohort_spend(spark, d):
    return customers.cohort_spend(census.visits(spark, d))


@query("segment_participation", f"""WITH {CV}, f AS (SELECT customer_token, count(DISTINCT segment) AS s FROM vi GROUP BY 1)
  SELECT 'both' AS segment, CAST(count(*) FILTER (WHERE s >= 2) AS DOUBLE) / count(*) AS share FROM f UNION ALL
  SELECT segment, CAST(count(DISTINCT customer_token) AS DOUBLE) / (SELECT count(*) FROM cu) FROM vi GROUP BY 1""")
def _segment_participation(spark, d):
    return customers.segment_participation(card_visits(spark, d), census.customers(spark, d))


@query("card_banner_share", f"""WITH {VI} SELECT customer_token, banner_code, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY customer_token) AS share
  FROM vi GROUP BY 1, 2""")
def _card_banner_share(spark, d):
    return customers.card_banner_share(card_visits(spark, d))


FIXED = "(CAST(sum(CAST(round_even({} * 100000000, 0) AS BIGINT)) AS DOUBLE) / 100000000 / count(*))"


@query("primary_concentration", f"""WITH {VI}, c AS (SELECT customer_token, banner_code, count(*) AS n FROM vi WHERE segment = 'ASIA' GROUP BY 1, 2),
  s AS (SELECT CAST(max(n) AS DOUBLE) / sum(n) AS share FROM c GROUP BY customer_token) SELECT count(*) AS cards, {FIXED.format('share')} AS concentration FROM s""")
def _primary_concentration(spark, d):
    return customers.primary_concentration(card_visits(spark, d).filter(F.col("segment") == "ASIA"))


@query("top_sku_repeat", f"""WITH {CU}, {IT}, o AS (SELECT o_orderkey AS txn_id, o_custkey AS customer_token FROM orders WHERE o_custkey IN
  (SELECT customer_token FROM cu WHERE loyalty_type = 'BUILDING')), t AS (SELECT customer_token, count(*) AS trips FROM o GROUP BY 1 HAVING count(*) >= 5),
  h AS (SELECT customer_token, sku, count(DISTINCT txn_id) AS k FROM it JOIN o USING (txn_id) GROUP BY 1, 2),
  s AS (SELECT CAST(max(k) AS DOUBLE) / any_value(trips) AS share FROM h JOIN t USING (customer_token) GROUP BY customer_token)
  SELECT count(*) AS cards, {FIXED.format('share')} AS top_sku_share FROM s""")
def _top_sku_repeat(spark, d):
    loyal = census.customers(spark, d).filter(F.col("loyalty_type") == "BUILDING")
    return customers.top_sku_repeat(census.orders(spark, d), census.items(spark, d), loyal)


@query("repeat_customer_ratio", f"""WITH {VI}, c AS (SELECT banner_code, customer_token, count(DISTINCT CAST(txn_ts AS DATE)) AS n FROM vi GROUP BY 1, 2)
  SELECT banner_code, count(*) AS total_customers, count(*) FILTER (WHERE n >= 2) AS repeat_customers,
  CAST(count(*) FILTER (WHERE n >= 2) AS DOUBLE) * 100 / count(*) AS repeat_pct FROM c GROUP BY 1""")
def _repeat_customer_ratio(spark, d):
    return customers.repeat_customer_ratio(card_visits(spark, d))


@query("loyalty_primary_share", f"""WITH {CV} SELECT loyalty_type, count(*) AS trips, CAST(count(*) FILTER (WHERE banner_code = primary_banner) AS DOUBLE) / count(*) AS share_at_primary
  FROM vi JOIN cu USING (customer_token) GROUP BY 1""")
def _loyalty_primary_share(spark, d):
    return customers.loyalty_primary_share(card_visits(spark, d), census.customers(spark, d))


@query("zone_banner_mix", f"""WITH {CV} SELECT home_zone, banner_code, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY home_zone) AS share
  FROM vi JOIN cu USING (customer_token) GROUP BY 1, 2""")
def _zone_banner_mix(spark, d):
    return customers.zone_banner_mix(card_visits(spark, d), census.customers(spark, d))


@query("zone_footprint", f"""WITH {CV} SELECT home_zone, count(*) AS txns, {money('subtotal')} AS dollars, (home_zone + 1) / 325.0 AS residential_weight,
  0.5 + (home_zone % 4) / 4.0 AS affluence FROM vi JOIN cu USING (customer_token) GROUP BY home_zone""")
def _zone_footprint(spark, d):
    return customers.zone_footprint(census.visits(spark, d), census.customers(spark, d), census.zones(spark, d))


@query("cross_segment_cells", f"""WITH {CV}, b AS (SELECT customer_token FROM vi GROUP BY 1 HAVING count(DISTINCT segment) >= 2)
  SELECT home_zone, count(*) AS cards, count(*) >= 50 AS survives_k FROM cu JOIN b USING (customer_token) GROUP BY 1""")
def _cross_segment_cells(spark, d):
    return customers.cross_segment_cells(card_visits(spark, d), census.customers(spark, d))


BANNERS = [f"NATION_{i}" for i in range(25)]  # all merchants of the panel


@query("zone_table", f"""WITH {CV}, b AS (SELECT customer_token FROM vi GROUP BY 1 HAVING count(DISTINCT segment) >= 2),
  c AS (SELECT home_zone AS zone_id, count(*) AS customers FROM cu GROUP BY 1), x AS (SELECT home_zone AS zone_id, count(*) AS n FROM cu JOIN b USING (customer_token) GROUP BY 1),
  s AS (SELECT zone_id, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE banner_code = '{b}') AS stores_{b}" for b in BANNERS)} FROM st GROUP BY 1)
  SELECT n_nationkey AS zone_id, coalesce(customers, 0) AS customers, coalesce(x.n, 0) AS both, coalesce(s.n, 0) AS store_count,
  {', '.join(f"coalesce(stores_{b}, 0) AS stores_{b}" for b in BANNERS)}
  FROM nation LEFT JOIN c ON c.zone_id = n_nationkey LEFT JOIN x ON x.zone_id = n_nationkey LEFT JOIN s ON s.zone_id = n_nationkey""")
def _zone_table(spark, d):
    return customers.zone_table(
        census.zones(spark, d), census.customers(spark, d), card_visits(spark, d), census.stores(spark, d), BANNERS
    )


@query("customer_cross_tab", f"""WITH {CU} SELECT loyalty_type, {', '.join(f"count(*) FILTER (WHERE primary_banner = '{b}') AS {b}" for b in BANNERS)},
  count(*) AS total FROM cu GROUP BY 1""")
def _customer_cross_tab(spark, d):
    return customers.customer_cross_tab(census.customers(spark, d), "loyalty_type", "primary_banner", BANNERS)


@query("zone_distribution", f"""WITH {CU}, {ST}, m AS (SELECT DISTINCT zone_id, neighborhood FROM st) SELECT neighborhood, count(*) AS n_customers
  FROM cu JOIN m ON m.zone_id = home_zone GROUP BY 1""")
def _zone_distribution(spark, d):
    return customers.zone_distribution(census.customers(spark, d), census.stores(spark, d))
