"""Queries over the peer lake and its building blocks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.calendar import week_of
from tallyscope.functions.hashing import md5_bucket
from tallyscope.functions.money import mean_money, sum_int, sum_money, to_cents
from tallyscope.operators import compare, lake, privacy, scope
from tallyscope.plans.registry import query, rounded
from tallyscope.plans.sql import (
    IT, LN, LNT, MR, PEER, PR, SELF, ST, TX, VIEWER, avg_money, money, rel, total,
)
from tallyscope.plans.sql import lake as lake_sql
from tallyscope.sources import census, readers, sinks

FIRST_QUARTER = scope.Window(dt.date(2000, 1, 3), dt.date(2000, 4, 3))


def own_lines(spark: SparkSession, d: str, viewer: str = VIEWER, timed: bool = False) -> DataFrame:
    """The viewer's own lines; its stores are picked before the join with the facts."""
    mine = census.stores(spark, d).filter(F.col("banner_code") == viewer)
    return lake.enriched_lines(
        census.items(spark, d), census.products(spark, d), mine, census.orders(spark, d) if timed else None
    )


def peer_lake(spark: SparkSession, d: str, viewer: str = VIEWER, timed: bool = False, wide: bool = False) -> DataFrame:
    """Labelled lines; unless `wide`, only self and peer stores, picked before the join with the facts."""
    labelled = lake.label_stores(census.stores(spark, d), census.merchants(spark, d), viewer)
    if not wide:
        labelled = labelled.filter(F.col("peer_relationship").isin("self", "peer"))
    return lake.enriched_lines(
        census.items(spark, d), census.products(spark, d), labelled, census.orders(spark, d) if timed else None
    )


PRICE_GAP = f"""
SELECT *, own_asp / peer_asp - 1 AS gap FROM (
  SELECT {{dims}}, {avg_money('unit_price', SELF)} AS own_asp, {avg_money('unit_price', PEER)} AS peer_asp,
    {total('qty', SELF)} AS own_units, {total('qty', PEER)} AS peer_units,
    count(DISTINCT store_id) FILTER (WHERE {SELF}) AS own_stores,
    count(DISTINCT store_id) FILTER (WHERE {PEER}) AS peer_stores
  FROM lk GROUP BY {{dims}} HAVING count(*) FILTER (WHERE {PEER}) >= 50)"""


@query("price_gap", f"WITH {lake_sql()} {PRICE_GAP.format(dims='department, category')}")
def _price_gap(spark, d):
    return compare.price_gap(peer_lake(spark, d), ["department", "category"], store="store_id")


@query("price_gap_by_category", f"WITH {lake_sql()} {PRICE_GAP.format(dims='category')}")
def _price_gap_by_category(spark, d):
    return compare.price_gap(peer_lake(spark, d), ["category"], store="store_id")


@query("price_gap_suppression", f"""WITH {lake_sql()}
SELECT count(*) AS n_groups, count(*) FILTER (WHERE k < 50) AS n_suppressed FROM (
  SELECT count(*) FILTER (WHERE {PEER}) AS k FROM lk WHERE peer_relationship <> 'merchant' GROUP BY department, category)""")
def _price_gap_suppression(spark, d):
    groups = privacy.lake_groups(peer_lake(spark, d), ["department", "category"], {"n": F.count(F.lit(1))})
    return privacy.suppression_summary(groups)


@query("enriched_lines", f"""WITH {LNT}
SELECT txn_id, line_id, store_id, banner_code, CAST(txn_ts AS DATE) AS txn_date, department, category, subcategory,
  unit_price, qty, discount, line_total, tender AS payment_type, neighborhood FROM lnt""")
def _enriched_lines(spark, d):
    lines = lake.enriched_lines(
        census.items(spark, d), census.products(spark, d), census.stores(spark, d), census.orders(spark, d)
    )
    return lake.lake_projection(lines).select(
        "txn_id", "line_id", "store_id", "banner_code", "txn_date", "department", "category", "subcategory",
        "unit_price", "qty", "discount", "line_total", "payment_type", "neighborhood",
    )


@query("lake_lines", """SELECT event_id, CAST(ts AS DATE) AS txn_date,
  CAST(floor(extract(hour FROM ts) * 10 / 24.0) AS TINYINT) AS hour_bucket,
  CASE WHEN event_type = 'purchase' THEN coalesce(CASE WHEN user_id % 3 > 0 THEN 'w' || CAST(user_id % 3 AS VARCHAR) END,
    'none') ELSE 'none' END AS wallet_type FROM events""")
def _lake_lines(spark, d):
    s = census.sessions(spark, d)
    user = F.col("customer_token") % 3
    s = s.withColumns({
        "wallet_at_tap": F.col("banner_code") == "purchase",
        "wallet_provider": F.when(user > 0, F.concat(F.lit("w"), user.cast("string"))),
        "tender": F.lit(None).cast("string"), "network": F.lit(None).cast("string"),
    })
    return lake.lake_projection(s).select(F.col("txn_id").alias("event_id"), "txn_date", "hour_bucket", "wallet_type")


def published_root(spark: SparkSession, d: str) -> str:
    """A lake of all viewers, written to a new folder of the shared root."""
    root = sinks.shared_folder(spark, "lake")
    lake.build_lake(
        root, census.items(spark, d), census.products(spark, d), census.orders(spark, d), census.stores(spark, d),
        census.merchants(spark, d),
    )
    return root


TOKEN = "substr(sha256('panel:' || CAST({} AS VARCHAR)), 1, 16)"


@query("tokenize_ids", f"""WITH {IT} SELECT {TOKEN.format('txn_id')} AS lake_txn_id, {TOKEN.format('store_id')} AS lake_store_id,
  {TOKEN.format('txn_id')} || '-' || CAST(line_id AS VARCHAR) AS lake_line_id, qty FROM it""")
def _tokenize_ids(spark, d):
    return lake.tokenize_ids(census.items(spark, d)).select("lake_txn_id", "lake_store_id", "lake_line_id", "qty")


@query("peer_relationship", f"""WITH {lake_sql()} SELECT peer_relationship, count(*) AS n_lines,
  count(DISTINCT store_id) AS n_stores, {total('qty')} AS units FROM lk GROUP BY 1""")
def _peer_relationship(spark, d):
    return peer_lake(spark, d, wide=True).groupBy("peer_relationship").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("store_id").alias("n_stores"), F.sum("qty").alias("units")
    )


@query("lake_stores", f"""WITH {ST} SELECT {TOKEN.format('store_id')} AS lake_store_id, {rel()}, segment AS peer_segment,
  neighborhood FROM st""")
def _lake_stores(spark, d):
    return lake.published_stores(lake.label_stores(census.stores(spark, d), census.merchants(spark, d), VIEWER))


@query("peer_routing_metadata", f"""WITH {MR} SELECT merchant_id AS viewer, segment,
  (SELECT count(*) - 1 FROM mr m WHERE m.segment = mr.segment) AS segment_peer_count FROM mr""")
def _peer_routing_metadata(spark, d):
    return lake.peer_routing_metadata(census.merchants(spark, d))


@query("lake_metadata", f"""WITH {MR}, {ST}, n AS (SELECT l_suppkey AS store_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT merchant_id AS viewer, segment, (SELECT count(*) - 1 FROM mr m WHERE m.segment = mr.segment) AS segment_peer_count,
  (SELECT CAST(sum(n) AS BIGINT) FROM st JOIN n USING (store_id)) AS n_lines, (SELECT count(*) FROM st) AS n_stores FROM mr""")
def _lake_metadata(spark, d):
    stores = census.stores(spark, d)
    placed = census.items(spark, d).select("store_id").join(stores.select("store_id"), "store_id", "left_semi")
    counts = [df.agg(F.count(F.lit(1)).alias("n")) for df in (placed, stores)]
    return lake.lake_metadata(lake.peer_routing_metadata(census.merchants(spark, d)), *counts)


@query("viewer_lake", f"""WITH {MR}, {LN} SELECT v.merchant_id AS viewer,
  CASE WHEN v.merchant_id = ln.banner_code THEN 'self' WHEN v.segment = ln.segment THEN 'peer' ELSE 'merchant' END
    AS peer_relationship, category, count(*) AS n_lines, {total('qty')} AS units, {money('line_total')} AS sales
FROM mr v CROSS JOIN ln GROUP BY 1, 2, 3""")
def _viewer_lake(spark, d):
    """Every viewer's lake at category grain, from one row per store and category."""
    items = census.items(spark, d).join(census.products(spark, d).select("sku", "category"), "sku")
    per_store = items.groupBy("store_id", "category").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("qty").alias("units"), F.sum(to_cents("line_total")).alias("sales")
    )
    out = lake.viewer_totals(per_store, census.stores(spark, d), ["category"], ["n_lines", "units", "sales"])
    return out.filter("n_lines > 0").withColumn("sales", F.col("sales") / 100)


@query("build_lake", f"""WITH {MR}, {ST} SELECT merchant_id AS viewer, segment,
  (SELECT count(*) - 1 FROM mr m WHERE m.segment = mr.segment) AS segment_peer_count,
  (SELECT count(*) FROM lineitem JOIN st ON store_id = l_suppkey JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey) AS n_lines,
  (SELECT count(*) FROM st) AS n_stores FROM mr""")
def _build_lake(spark, d):
    """Write the lake, then its metadata as published."""
    schema = "viewer string, segment string, segment_peer_count bigint, n_lines bigint, n_stores bigint"
    return spark.read.schema(schema).json(f"{published_root(spark, d)}/metadata")


@query("register_lake_views", f"""WITH {lake_sql(timed=True)} SELECT peer_relationship, category, CAST(date_trunc('month', txn_ts) AS DATE) AS month,
  count(*) AS n_lines, count(DISTINCT store_id) AS n_stores, {total('qty')} AS units, {money('line_total')} AS sales FROM lk GROUP BY 1, 2, 3""")
def _register_lake_views(spark, d):
    """The written lake through the views of one viewer."""
    if not readers.register_lake_views(spark, published_root(spark, d), VIEWER):
        raise LookupError(VIEWER)
    return spark.sql("SELECT peer_relationship, category, CAST(trunc(txn_date, 'MM') AS DATE) AS month, lake_store_id, qty, line_total FROM lake_transactions").groupBy(
        "peer_relationship", "category", "month").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("lake_store_id").alias("n_stores"), F.sum("qty").alias("units"),
        sum_money("line_total").alias("sales"),
    )


@query("identity_leak_check", """SELECT * FROM (VALUES ('identity_columns'), ('merchant_labels'),
  ('relationship_vocabulary'), ('hour_bucket_range')) r(rule), (SELECT count(*) * 0 AS violations FROM lineitem)""")
def _identity_leak_check(spark, d):
    lines = lake.tokenize_ids(lake.lake_projection(peer_lake(spark, d, timed=True, wide=True)))
    return lake.identity_leak_check(lake.publish(lines))


@query("identity_leak_found", f"""WITH {lake_sql(timed=True)} SELECT 'identity_columns' AS rule, CAST(1 AS BIGINT) AS violations
UNION ALL SELECT 'merchant_labels', 1
UNION ALL SELECT 'relationship_vocabulary', count(*) FILTER (WHERE peer_relationship = 'merchant') FROM lk
UNION ALL SELECT 'hour_bucket_range', count(*) FILTER (WHERE extract(month FROM txn_ts) > 10) FROM lk""")
def _identity_leak_found(spark, d):
    """A frame that breaks every rule: a banner, a merchant's own label, missing relationships, months as hour buckets."""
    lines = lake.tokenize_ids(lake.lake_projection(peer_lake(spark, d, timed=True, wide=True))).withColumns({
        "peer_relationship": F.nullif("peer_relationship", F.lit("merchant")), "hour_bucket": F.month("txn_ts") - 1,
    })
    kept = [c for c in lake.LAKE_COLUMNS if c in lines.columns]
    return lake.identity_leak_check(lines.select(*kept, "banner_code", "merchant_department"))


@query("unknown_viewer_check", f"""WITH {MR} SELECT c_name, 'NATION_' || CAST(c_custkey % 30 AS VARCHAR) AS viewer,
  'NATION_' || CAST(c_custkey % 30 AS VARCHAR) IN (SELECT merchant_id FROM mr) AS known FROM customer""")
def _unknown_viewer_check(spark, d):
    """Which of a stream of requested viewers belong to the panel."""
    asked = census.table(spark, d, "customer").select(
        "c_name", F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("viewer")
    )
    known = census.merchants(spark, d).select(F.col("merchant_id").alias("viewer"), F.lit(True).alias("known"))
    return asked.join(known, "viewer", "left").select("c_name", "viewer", F.coalesce("known", F.lit(False)).alias("known"))


@query("tenant_scope", f"""WITH {ST}, {PR}, {IT}, {TX} SELECT it.txn_id, line_id, it.store_id, it.sku, qty, line_total FROM it
  JOIN st USING (store_id) WHERE banner_code = '{VIEWER}'
  AND txn_id IN (SELECT txn_id FROM tx WHERE txn_ts >= DATE '2000-01-03' AND txn_ts < DATE '2000-04-03')""")
def _tenant_scope(spark, d):
    """Own items whose order lies in the window: stores by banner, orders by window, items by semi join."""
    mine = census.stores(spark, d).filter(F.col("banner_code") == VIEWER)
    txns = census.orders(spark, d).filter(FIRST_QUARTER.holds(F.col("txn_ts")))
    own = census.items(spark, d).join(mine.select("store_id"), "store_id", "left_semi")
    return scope.items_of(own, txns).select("txn_id", "line_id", "store_id", "sku", "qty", "line_total")


@query("lake_window_scope", f"""WITH {lake_sql(timed=True)} SELECT department, {total('qty', PEER)} AS peer_units FROM lk
  WHERE txn_ts >= DATE '2000-01-03' AND txn_ts < DATE '2000-04-03' GROUP BY 1 HAVING count(*) FILTER (WHERE {PEER}) >= 50""")
def _lake_window_scope(spark, d):
    lines = lake.lake_projection(peer_lake(spark, d, timed=True))
    windowed = scope.lake_window_scope(lines, FIRST_QUARTER)
    return privacy.k_floor(privacy.lake_groups(windowed, ["department"], {"peer_units": sum_int("qty", compare.is_peer())}))


@query("k_anonymous_aggregate", f"""WITH {lake_sql()} SELECT department, category, count(*) AS n_lines, {total('qty')} AS units,
  {money('line_total')} AS sales, count(DISTINCT txn_id) AS txns FROM lk WHERE {PEER} GROUP BY 1, 2
  HAVING count(*) >= 50""")
def _k_anonymous_aggregate(spark, d):
    kept, _ = privacy.k_anonymous_aggregate(peer_lake(spark, d), ["department", "category"], {
        "n_lines": F.count(F.lit(1)), "units": F.sum("qty"), "sales": sum_money("line_total"),
        "txns": F.count_distinct("txn_id"),
    }, relationships=["peer"])
    return kept


@query("whole_table_peer_aggregate", f"""WITH {lake_sql()} SELECT count(*) AS n_lines, {avg_money('unit_price')} AS asp
FROM lk WHERE {PEER} HAVING count(*) >= 50""")
def _whole_table_peer_aggregate(spark, d):
    return compare.peer_aggregate(peer_lake(spark, d), [], {
        "n_lines": F.count(F.lit(1)), "asp": mean_money("unit_price")
    })


GS = """SELECT department, category, CAST(grouping_id(department, category) AS INT) AS level, count(*) AS n_lines,
  CAST(sum(qty) AS BIGINT) AS units, count(DISTINCT txn_id) AS n_txns FROM lk WHERE peer_relationship = 'peer' GROUP BY {} (department, category)
  HAVING count(*) >= 50"""


def _grouping_sets(spark, d, grouping):
    return privacy.distinct_over_sets(
        peer_lake(spark, d), ["department", "category"], "txn_id", {"n_lines": F.lit(1), "units": F.col("qty")}, "n_txns", ["peer"], grouping)


@query("grouping_sets_lake", f"WITH {lake_sql()} {GS.format('ROLLUP')}")
def _rollup_lake(spark, d):
    return _grouping_sets(spark, d, "rollup")


@query("cube_lake", f"WITH {lake_sql()} {GS.format('CUBE')}")
def _cube_lake(spark, d):
    return _grouping_sets(spark, d, "cube")


@query("lake_sketches", f"""WITH {lake_sql(timed=True)} SELECT category, count(*) AS n_rows, count(unit_price) AS n_values, count(DISTINCT txn_id) AS distinct_estimate,
  quantile_disc(unit_price, 0.5) AS median, quantile_disc(unit_price, 0.9) AS q90, 0.83::DOUBLE / 256 AS distinct_error, 2.446::DOUBLE / pow(4096, 0.9433::DOUBLE) AS rank_error
  FROM lk WHERE {PEER} GROUP BY 1 HAVING count(*) >= 50""")
def _lake_sketches(spark, d):
    """Stored sketches of each category and month, merged to categories.  At the size of the check the sketches still hold
    every id and value, so the estimates equal the exact figures; at larger ones they keep within the published errors."""
    lines = peer_lake(spark, d, timed=True).withColumn("month", F.date_format("txn_ts", "yyyy-MM"))
    path = sinks.shared_folder(spark, "sketches")
    sinks.write_layout(privacy.sketch_cells(lines, ["category", "month"], "txn_id", "unit_price"), path)
    return privacy.from_sketches(spark.read.parquet(path), ["category"], {"median": 0.5, "q90": 0.9})


@query("published_reconciliation", f"""WITH {LNT} SELECT strftime(txn_ts, '%Y-%m') AS txn_month, {TOKEN.format('banner_code')} AS merchant_token,
  count(*) AS lake_lines, count(*) AS own_lines, true AS match FROM lnt GROUP BY 1, 2""")
def _published_reconciliation(spark, d):
    """Every month and merchant of the written lake against the merchants' own lines; the hashes themselves are Spark's JSON."""
    root = published_root(spark, d)
    out = lake.published_reconciliation(
        spark, root, census.items(spark, d), census.products(spark, d), census.orders(spark, d), census.stores(spark, d))
    return out.drop("lake_hash", "own_hash")


@query("group_by_all_lake", f"""WITH {lake_sql()} SELECT category, neighborhood, {total('qty')} AS units FROM lk WHERE {PEER}
GROUP BY ALL HAVING count(*) >= 50""")
def _group_by_all(spark, d):
    """GROUP BY ALL, with the floor as HAVING, over a registered lake view."""
    peer_lake(spark, d).createOrReplaceTempView("lake_lines_all")
    return spark.sql(
        "SELECT category, neighborhood, units FROM (SELECT category, neighborhood, sum(qty) AS units, count(*) AS k "
        "FROM lake_lines_all WHERE peer_relationship = 'peer' GROUP BY ALL) WHERE k >= 50"
    )


LAF = """n AS (SELECT category, count(*) AS n, count(unit_price) AS n_values, CAST(sum(qty) AS BIGINT) AS total,
  CAST(sum(qty) AS DOUBLE) / count(*) AS mean, min(unit_price) AS lowest, max(unit_price) AS highest,
  CAST(sum(qty) AS DOUBLE) AS s, CAST(sum(qty * qty) AS DOUBLE) AS q, CAST(count(*) AS DOUBLE) AS c,
  (arg_min(department, (unit_price, department))) AS arg_lowest,
  (arg_max(department, (unit_price, department))) AS arg_highest,
  bool_and(private_label) AS all_flag, bool_or(private_label) AS any_flag,
  round(quantile_cont(unit_price, 0.5), 6) AS median, round(quantile_cont(unit_price, 0.9), 6) AS q90,
  quantile_disc(unit_price, 0.5) AS median_disc, arg_min(unit_price, (txn_id, line_id, sku, unit_price)) AS "first", arg_max(unit_price, (txn_id, line_id, sku, unit_price)) AS "last" FROM lk WHERE peer_relationship = 'peer' GROUP BY 1 HAVING count(*) >= 50),
m AS (SELECT category, arg_max(qty, (n, -qty)) AS mode, round(sum(n * log10(qty)), 6) AS product_log10, count(*) AS n_distinct FROM
  (SELECT category, qty, count(*) AS n FROM lk WHERE peer_relationship = 'peer' GROUP BY 1, 2) GROUP BY 1)"""


@query("lake_agg_functions", f"""WITH {lake_sql()}, {LAF} SELECT category, n, n_values, total, mean, lowest, highest,
  (q - s * s / c) / c AS var_pop, (q - s * s / c) / nullif(c - 1, 0) AS var_samp, sqrt((q - s * s / c) / c) AS stddev_pop,
  sqrt((q - s * s / c) / nullif(c - 1, 0)) AS stddev_samp, arg_lowest, arg_highest, all_flag, any_flag,
  n_distinct AS approx_distinct, "first", "last", n_distinct, mode, 1 AS product_sign, 0 AS product_zeros, product_log10, median, median_disc, q90 FROM n JOIN m USING (category)""")
def _lake_agg_functions(spark, d):
    out = privacy.lake_agg_functions(
        peer_lake(spark, d), ["category"], "unit_price", "qty", "department", F.col("private_label"), ["txn_id", "line_id", "sku", "unit_price"]
    )
    return rounded(out, "median", "q90")


@query("mix_index", f"""WITH {lake_sql()}, g AS (SELECT subcategory, {total('qty', SELF)} AS own_u, {total('qty', PEER)} AS peer_u,
  count(*) FILTER (WHERE {PEER}) AS k FROM lk WHERE peer_relationship <> 'merchant' GROUP BY 1),
s AS (SELECT *, CAST(own_u AS DOUBLE) / sum(own_u) OVER () AS own_share, CAST(peer_u AS DOUBLE) / sum(peer_u) OVER () AS peer_share,
  CAST(sum(own_u) OVER () AS DOUBLE) AS t FROM g)
SELECT subcategory, own_u, peer_u, own_share, peer_share, own_share / nullif(peer_share, 0) AS mix_index,
  t * peer_share - own_u AS opportunity_units FROM s WHERE k >= 50""")
def _mix_index(spark, d):
    return compare.mix_index(peer_lake(spark, d))


@query("own_drill_breadth", f"""WITH {LN} SELECT merchant_department, category, {total('qty')} AS units, count(DISTINCT sku) AS skus
FROM ln WHERE banner_code = '{VIEWER}' AND subcategory = 'red plate' GROUP BY 1, 2""")
def _own_drill_breadth(spark, d):
    return compare.own_drill_breadth(own_lines(spark, d), "red plate")


@query("product_drivers", f"""WITH {LN} SELECT product_name, {avg_money('unit_price')} AS asp, {total('qty')} AS units
FROM ln WHERE banner_code = '{VIEWER}' AND subcategory = 'red plate' GROUP BY 1 ORDER BY units DESC, product_name LIMIT 5""")
def _product_drivers(spark, d):
    return compare.product_drivers(own_lines(spark, d), "red plate", 5)


@query("velocity", f"""WITH {LN} SELECT category, {total('qty')} AS units, {money('line_total')} AS sales FROM ln
WHERE banner_code = '{VIEWER}' GROUP BY 1""")
def _velocity(spark, d):
    return compare.velocity(own_lines(spark, d))


@query("neighborhood_share", f"""WITH {lake_sql()} SELECT neighborhood, own_units, peer_units,
  CAST(own_units AS DOUBLE) / (own_units + peer_units) AS own_share FROM (SELECT neighborhood,
  coalesce({total('qty', SELF)}, 0) AS own_units, {total('qty', PEER)} AS peer_units
  FROM lk GROUP BY 1 HAVING count(*) FILTER (WHERE {PEER}) >= 50)""")
def _neighborhood_share(spark, d):
    return compare.neighborhood_share(peer_lake(spark, d))


@query("neighborhood_peer_units", f"""WITH {lake_sql()} SELECT neighborhood, {total('qty')} AS peer_units FROM lk WHERE {PEER}
GROUP BY 1 HAVING count(*) >= 50""")
def _neighborhood_peer_units(spark, d):
    labelled = lake.label_stores(census.stores(spark, d), census.merchants(spark, d), VIEWER)
    lines = census.items(spark, d).join(labelled.select("store_id", "peer_relationship"), "store_id")
    return compare.neighborhood_peer_units(lake.tokenize_ids(lines), lake.published_stores(labelled))


@query("monthly_own_vs_peer", f"""WITH {lake_sql(timed=True)} SELECT CAST(date_trunc('month', txn_ts) AS DATE) AS month,
  {total('qty', SELF)} AS own_units, {total('qty', PEER)} AS peer_units FROM lk GROUP BY 1
  HAVING count(*) FILTER (WHERE {PEER}) >= 50""")
def _monthly_own_vs_peer(spark, d):
    return compare.weekly_own_vs_peer(peer_lake(spark, d, timed=True), grain="month")


@query("weekly_own_vs_peer", f"""WITH {lake_sql(timed=True)} SELECT CAST(date_trunc('week', txn_ts) AS DATE) AS week,
  {total('qty', SELF)} AS own_units, {total('qty', PEER)} AS peer_units FROM lk GROUP BY 1
  HAVING count(*) FILTER (WHERE {PEER}) >= 50""")
def _weekly_own_vs_peer(spark, d):
    return compare.weekly_own_vs_peer(peer_lake(spark, d, timed=True), k=50)


def _gap_frames(spark, d):
    own = own_lines(spark, d).groupBy("banner_code", "department").agg(mean_money("unit_price").alias("own_asp"))
    peer = compare.peer_aggregate(peer_lake(spark, d), ["department"], {
        "peer_asp": mean_money("unit_price"), "txn_count": F.count_distinct("txn_id")
    })
    return own, peer


GAP = f"""WITH {lake_sql()}, o AS (SELECT department, {avg_money('unit_price')} AS own_value FROM lk WHERE {SELF} GROUP BY 1),
p AS (SELECT department, {avg_money('unit_price')} AS peer_benchmark, count(DISTINCT txn_id) AS txn_count FROM lk WHERE {PEER}
  GROUP BY 1 HAVING count(*) >= 50) SELECT department, own_value, peer_benchmark, txn_count, {{}} AS gap FROM o JOIN p USING (department)"""


@query("own_peer_gap", GAP.format("own_value - peer_benchmark"))
def _own_peer_gap(spark, d):
    return compare.own_peer_gap(*_gap_frames(spark, d), ["department"], "own_asp", "peer_asp", viewer=VIEWER)


@query("own_peer_ratio", GAP.format("own_value / nullif(peer_benchmark, 0)"))
def _own_peer_ratio(spark, d):
    return compare.own_peer_gap(*_gap_frames(spark, d), ["department"], "own_asp", "peer_asp", "ratio", viewer=VIEWER)


MOVERS = """r AS (SELECT *, dense_rank() OVER (ORDER BY period DESC) AS pr FROM tidy),
g AS (SELECT dim, max(v) FILTER (WHERE pr = 1) AS recent, sum(v) FILTER (WHERE pr > 1) / 4 AS baseline, count(*) AS np,
  min(n) AS least FROM r WHERE pr <= 5 GROUP BY 1),
m AS (SELECT dim, round(recent, 4) AS recent, round(baseline, 4) AS baseline, round((recent - baseline) / baseline, 4) AS delta_pct
  FROM g WHERE np = 5 AND least >= {k} AND baseline > 0),
t AS (SELECT *, CASE WHEN delta_pct > 0 THEN 'up' ELSE 'down' END AS direction FROM m WHERE delta_pct <> 0)
SELECT dim AS {dim}, recent, baseline, delta_pct, direction FROM t
QUALIFY row_number() OVER (PARTITION BY direction ORDER BY abs(delta_pct) DESC, dim) <= 3"""


def _tidy(lines, dim, orders):
    """Units and lines per month of lines already scoped to a viewer; a month that the panel's last day breaks is left out."""
    whole = compare.whole_months(lines, "txn_ts", orders)
    return whole.groupBy(dim, F.date_trunc("month", "txn_ts").alias("period")).agg(
        F.sum("qty").alias("units"), F.count(F.lit(1)).alias("n")
    )


def _tidy_sql(dim, where):
    return f"""WITH {lake_sql(timed=True)}, tidy AS (SELECT {dim} AS dim, date_trunc('month', txn_ts) AS period, CAST(sum(qty) AS DOUBLE) AS v, count(*) AS n
  FROM lk WHERE {where} AND last_day(CAST(txn_ts AS DATE)) <= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) GROUP BY 1, 2)"""


@query("top_movers", f"{_tidy_sql('department', SELF)}, {MOVERS.format(k=0, dim='department')}")
def _top_movers(spark, d):
    """The viewer's own departments; own figures need no floor."""
    return compare.top_movers(_tidy(own_lines(spark, d, timed=True), "department", census.orders(spark, d)), "department", "period", "units")


@query("top_movers_monthly", f"{_tidy_sql('segment', PEER)}, {MOVERS.format(k=50, dim='segment')}")
def _top_movers_monthly(spark, d):
    """The viewer's peers under the floor, which every month of a series has to reach."""
    peers = peer_lake(spark, d, timed=True).filter(compare.is_peer())
    return compare.top_movers(_tidy(peers, "segment", census.orders(spark, d)), "segment", "period", "units", count="n")


@query("category_performance", f"""WITH {LN} SELECT department, category, {avg_money('unit_price')} AS asp, {total('qty')} AS units,
  {money('line_total')} AS sales, count(DISTINCT txn_id) AS txns FROM ln WHERE banner_code = '{VIEWER}' GROUP BY 1, 2""")
def _category_performance(spark, d):
    return compare.own_category_performance(own_lines(spark, d), ["department", "category"])


@query("peer_category_performance", f"""WITH {lake_sql()} SELECT category, {avg_money('unit_price')} AS asp, {total('qty')} AS units,
  {money('line_total')} AS sales FROM lk WHERE {PEER} GROUP BY 1 HAVING count(*) >= 50""")
def _peer_category_performance(spark, d):
    return compare.peer_aggregate(peer_lake(spark, d), ["category"], {
        "asp": mean_money("unit_price"), "units": F.sum("qty"), "sales": sum_money("line_total")
    })


@query("peer_payment_counts", f"""WITH {lake_sql(timed=True)} SELECT tender, count(DISTINCT txn_id) AS n_txns FROM lk WHERE {PEER}
GROUP BY 1 HAVING count(*) >= 50""")
def _peer_payment_counts(spark, d):
    return compare.peer_aggregate(peer_lake(spark, d, timed=True), ["tender"], {"n_txns": F.count_distinct("txn_id")})


@query("peer_reconciliation", f"""WITH {MR}, {LN}, o AS (SELECT banner_code, segment, {total('qty')} AS u, {money('unit_price')} AS p,
  count(*) AS n FROM ln GROUP BY 1, 2), x AS (SELECT merchant_id AS viewer, CAST(sum(u) AS BIGINT) AS units,
  round_even(sum(p) * 100, 0) / 100 / sum(n) AS a FROM mr JOIN o ON o.segment = mr.segment AND o.banner_code <> mr.merchant_id GROUP BY 1),
tk AS (SELECT {TOKEN.format('banner_code')} AS who, segment, {total('qty')} AS u, {money('unit_price')} AS p, count(*) AS n FROM ln GROUP BY 1, 2),
y AS (SELECT merchant_id AS viewer, CAST(sum(tk.u) AS BIGINT) AS units, round_even(sum(tk.p) * 100, 0) / 100 / sum(tk.n) AS a
  FROM mr JOIN tk ON tk.segment = mr.segment AND tk.who <> {TOKEN.format('merchant_id')} GROUP BY 1)
SELECT viewer, y.units AS lake_units, y.a AS lake_avg, x.units AS pooled_units, x.a AS pooled_avg,
  y.units = x.units AND abs(y.a - x.a) <= 1e-6 AS match FROM x FULL JOIN y USING (viewer)""")
def _peer_reconciliation(spark, d):
    """The tokenised lines and stores, as the lake publishes them, against the merchants' own lines."""
    items, stores = census.items(spark, d), census.stores(spark, d)
    lines = lake.tokenize_ids(lake.enriched_lines(items, census.products(spark, d), stores))
    return lake.peer_reconciliation(lines, lake.tokenized_stores(stores), items, stores, census.merchants(spark, d))


@query("product_price_vs_peers", f"""WITH {lake_sql()}, t AS (SELECT category, {total('qty')} AS peer_qty,
  round({avg_money('unit_price')}, 2) AS p FROM lk WHERE {PEER} GROUP BY 1 HAVING count(*) >= 50 ORDER BY 2 DESC, 1 LIMIT 10),
o AS (SELECT category, round({avg_money('unit_price')}, 2) AS a FROM lk WHERE {SELF} GROUP BY 1)
SELECT category, a AS own_price, p AS peer_avg_price, round(a - p, 2) AS gap_usd, round(100.0::DOUBLE * (a - p) / p, 1)
  AS own_vs_peer_pct, peer_qty FROM t LEFT JOIN o USING (category)""")
def _product_price_vs_peers(spark, d):
    """By category: single products stay under the floor at small sizes."""
    return compare.product_price_vs_peers(own_lines(spark, d), peer_lake(spark, d), key="category")


# The segment of the viewer has four other merchants.
PEER_LABELS = ["peer_1", "peer_2", "peer_3", "peer_4"]


def _peer_prices() -> str:
    return ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE peer_label = '{x}') >= 50 THEN " + avg_money("unit_price", f"peer_label = '{x}'") + f" END AS price_{x}"
        for x in PEER_LABELS
    )


@query("price_by_peer_pivot", f"""WITH {lake_sql()}, b AS (SELECT banner_code,
    'peer_' || CAST(row_number() OVER (ORDER BY {TOKEN.format('banner_code')}) AS VARCHAR) AS peer_label
  FROM (SELECT DISTINCT banner_code FROM (SELECT banner_code, {rel()} FROM st) WHERE {PEER})),
t AS (SELECT category, {total('qty')} AS peer_qty, {_peer_prices()} FROM lk JOIN b USING (banner_code) WHERE {PEER} GROUP BY 1
  HAVING count(*) >= 50 ORDER BY 2 DESC, 1 LIMIT 10), o AS (SELECT category, {avg_money('unit_price')} AS own_price FROM lk WHERE {SELF} GROUP BY 1)
SELECT category, own_price, {', '.join(f'price_{x}, (own_price - price_{x}) / price_{x} * 100 AS pct_vs_{x}' for x in PEER_LABELS)}, peer_qty
FROM t LEFT JOIN o USING (category)""")
def _price_by_peer_pivot(spark, d):
    labelled = lake.label_stores(census.stores(spark, d), census.merchants(spark, d), VIEWER)
    peers = lake.label_peers(labelled).filter(compare.is_peer())
    lines = lake.enriched_lines(census.items(spark, d), census.products(spark, d), peers)
    return compare.price_by_peer_pivot(own_lines(spark, d), lines, PEER_LABELS, key="category")


@query("line_share", f"""WITH {lake_sql()} SELECT peer_relationship AS source, count(*) AS total_lines,
  count(*) FILTER (WHERE category = 'Brand#7') AS category_lines,
  CAST(count(*) FILTER (WHERE category = 'Brand#7') AS DOUBLE) * 100 / count(*) AS line_share_pct FROM lk
  WHERE peer_relationship <> 'merchant' GROUP BY 1
  HAVING peer_relationship = 'self' OR count(*) FILTER (WHERE category = 'Brand#7') >= 50""")
def _line_share(spark, d):
    return compare.line_share(peer_lake(spark, d), "Brand#7")


@query("peer_basket_size", f"""WITH {lake_sql()} SELECT neighborhood, count(*) AS baskets, CAST(sum(u) AS DOUBLE) / count(*) AS mean_units FROM
  (SELECT neighborhood, txn_id, sum(qty) AS u, count(*) AS n FROM lk WHERE {PEER} GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 50""")
def _peer_basket_size(spark, d):
    return compare.peer_basket_size(peer_lake(spark, d), by="neighborhood")


@query("hash_sample", """SELECT o_orderkey, o_totalprice FROM orders
WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 < 250000""")
def _hash_sample(spark, d):
    """A sampling operator: the same orders are chosen on every run and on either side of a join."""
    return census.table(spark, d, "orders").filter(md5_bucket(F.col("o_orderkey"), 1_000_000) < 250_000).select(
        "o_orderkey", "o_totalprice"
    )


