"""Common table expressions of the check SQL: the panel contract over the driver tables."""

from __future__ import annotations

VIEWER = "NATION_3"


def money(col: str, where: str | None = None) -> str:
    """Exact sum in cents, as a double."""
    f = f" FILTER (WHERE {where})" if where else ""
    return f"(CAST(sum(CAST(round_even({col} * 100, 0) AS BIGINT)){f} AS DOUBLE) / 100)"


def avg_money(col: str, where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"({money(col, where)} / nullif(count({col}){f}, 0))"


def total(col: str, where: str | None = None) -> str:
    f = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum({col}){f} AS BIGINT)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def share(cond: str) -> str:
    return f"(CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE) / count(*))"


MR = """mr AS (SELECT n_name AS merchant_id, n_name AS banner_code, n_nationkey AS merchant_no, r_name AS segment,
  count(*) AS store_count FROM nation JOIN region ON n_regionkey = r_regionkey
  JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)"""
ST = """st AS (SELECT s_suppkey AS store_id, n_name AS banner_code, r_name AS segment, n_nationkey AS zone_id,
  'N' || CAST(s_suppkey % 8 AS VARCHAR) AS neighborhood, (s_suppkey % 10) / 10.0 AS latitude,
  (s_suppkey % 7) / 10.0 AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PR = """pr AS (SELECT p_partkey AS sku, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS product_name,
  p_type AS department, p_brand AS category, p_name AS subcategory,
  CASE WHEN p_size > 40 THEN 'OVERSIZE' ELSE p_type END AS merchant_department,
  p_brand IN ('Brand#1', 'Brand#2') AS private_label, p_retailprice AS shelf_price, p_size AS size FROM part)"""
CU = """cu AS (SELECT c_custkey AS customer_token, c_nationkey AS home_zone, c_acctbal AS affluence,
  c_mktsegment AS loyalty_type, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS primary_banner FROM customer)"""
IT = """it AS (SELECT l_orderkey AS txn_id, l_linenumber AS line_id, l_partkey AS sku, l_suppkey AS store_id,
  CAST(l_quantity AS BIGINT) AS qty, round_even(l_extendedprice / l_quantity * 100, 0) / 100 AS unit_price,
  round_even(l_extendedprice * l_discount * 100, 0) / 100 AS discount,
  round_even(l_extendedprice * (1 - l_discount) * 100, 0) / 100 AS line_total,
  CASE WHEN l_discount >= 0.08::DOUBLE THEN 'P' || CAST(l_partkey % 10 AS VARCHAR) END AS promo_id,
  l_returnflag AS entry_mode, l_linestatus AS network FROM lineitem)"""
TX = """tx AS (SELECT o_orderkey AS txn_id, o_custkey AS customer_token, o_orderdate AS txn_ts,
  o_orderpriority AS tender FROM orders)"""
SE = """se AS (SELECT event_id AS txn_id, user_id AS customer_token, event_type AS banner_code,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'commit' ELSE 'browse' END AS segment, ts AS txn_ts,
  value AS subtotal, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""
# Lines with store and product facts; `lnt` adds the order.
LN = f"""{ST}, {PR}, {IT},
ln AS (SELECT it.*, st.* EXCLUDE (store_id), pr.* EXCLUDE (sku) FROM it JOIN st USING (store_id) JOIN pr USING (sku))"""
LNT = f"""{LN}, {TX}, lnt AS (SELECT ln.*, tx.* EXCLUDE (txn_id) FROM ln JOIN tx USING (txn_id))"""
VI = f"""{ST}, {IT}, {TX},
vr AS (SELECT txn_id, store_id, banner_code, segment, neighborhood, {money('line_total')} AS subtotal,
  {money('discount')} AS discount_total, count(*) AS n_lines, {total('qty')} AS n_units,
  max(entry_mode) AS entry_mode, max(network) AS network
  FROM it JOIN st USING (store_id) GROUP BY 1, 2, 3, 4, 5),
vi AS (SELECT vr.*, tx.* EXCLUDE (txn_id), entry_mode = 'R' AS wallet_at_tap,
  CASE WHEN entry_mode = 'R' THEN 'W' || network END AS wallet_provider,
  CAST(txn_id AS VARCHAR) || '-' || CAST(store_id AS VARCHAR) AS visit_id
  FROM vr JOIN tx USING (txn_id))"""


def rel(viewer: str = VIEWER) -> str:
    return (
        f"CASE WHEN banner_code = '{viewer}' THEN 'self' WHEN segment = (SELECT r_name FROM nation JOIN region "
        f"ON n_regionkey = r_regionkey WHERE n_name = '{viewer}') THEN 'peer' ELSE 'merchant' END AS peer_relationship"
    )


def lake(viewer: str = VIEWER, timed: bool = False) -> str:
    base, name = (LNT, "lnt") if timed else (LN, "ln")
    return f"{base}, lk AS (SELECT *, {rel(viewer)} FROM {name})"


SELF, PEER = "peer_relationship = 'self'", "peer_relationship = 'peer'"
