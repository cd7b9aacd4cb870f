"""Panel contract frames over the order/lineitem star schema.

Merchant (banner) = supplier's nation, segment = its region, store = supplier, basket = order, product = part,
sessions with a time of day = events.  Each function is a lazy projection of one or two tables; joins with the
facts happen in the operators, so that unused tables are never scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.joins import bounded, parted_join
from tallyscope.functions.money import round_cents, sum_money

NEIGHBORHOODS = 8
PROMO_FROM = 0.08
PRIVATE_BRANDS = ("Brand#1", "Brand#2")
FRESH_DEPARTMENTS = ("PROMO", "STANDARD")


# Declared schemas: no inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def merchants(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("store_count"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = n.join(counts, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("n_name").alias("merchant_id"),
        F.col("n_name").alias("banner_code"),
        F.col("n_nationkey").alias("merchant_no"),
        F.col("r_name").alias("segment"),
        "store_count",
    )
    return bounded(out)


def stores(spark: SparkSession, d: str) -> DataFrame:
    """Stores with merchant and segment."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    out = (
        table(spark, d, "supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("store_id"),
            F.col("n_name").alias("merchant_id"),
            F.col("n_name").alias("banner_code"),
            F.col("r_name").alias("segment"),
            F.col("n_nationkey").alias("zone_id"),
            F.concat(F.lit("N"), (key % NEIGHBORHOODS).cast("string")).alias("neighborhood"),
            F.col("r_name").alias("metro_region"),
            ((key % 10) / 10.0).alias("latitude"),
            ((key % 7) / 10.0).alias("longitude"),
        )
    )
    return bounded(out)


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Home zones = customers' nations, with a centroid and a weight."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("zone_id"),
        ((k % 5) / 5.0).alias("centroid_lat"),
        ((k % 3) / 3.0).alias("centroid_long"),
        ((k + 1) / 325.0).alias("residential_weight"),
        (F.lit(0.5) + (k % 4) / 4.0).alias("affluence"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    out = table(spark, d, "part").select(
        key.alias("sku"),
        F.concat_ws(" ", F.col("p_name"), key.cast("string")).alias("product_name"),
        F.col("p_type").alias("department"),
        F.col("p_brand").alias("category"),
        F.col("p_name").alias("subcategory"),
        F.when(size > 40, "OVERSIZE").otherwise(F.col("p_type")).alias("merchant_department"),
        F.col("p_brand").isin(*PRIVATE_BRANDS).alias("private_label"),
        F.col("p_retailprice").alias("shelf_price"),
        size.alias("size"),
    )
    return bounded(out)


def customers(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_token"),
        F.col("c_nationkey").alias("home_zone"),
        F.col("c_acctbal").alias("affluence"),
        F.col("c_mktsegment").alias("loyalty_type"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("primary_banner"),
    )
    return bounded(out)


def items(spark: SparkSession, d: str) -> DataFrame:
    price, off, qty = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("txn_id"),
        F.col("l_linenumber").alias("line_id"),
        F.col("l_partkey").alias("sku"),
        F.col("l_suppkey").alias("store_id"),
        qty.cast("bigint").alias("qty"),
        round_cents(price / qty).alias("unit_price"),
        round_cents(price * off).alias("discount"),
        round_cents(price * (1 - off)).alias("line_total"),
        F.when(off >= PROMO_FROM, F.concat(F.lit("P"), (F.col("l_partkey") % 10).cast("string"))).alias("promo_id"),
        F.col("l_returnflag").alias("entry_mode"),
        F.col("l_linestatus").alias("network"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Order-level transactions; the store stays on the line."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("customer_token"),
        F.col("o_orderdate").alias("txn_ts"),
        F.col("o_orderpriority").alias("tender"),
    )


def visits(spark: SparkSession, d: str, banner: str | None = None) -> DataFrame:
    """Store-level transactions: one row per order and store, totals rolled up from the lines.

    A banner narrows the stores first, so only that banner's lines are shuffled.  Lines meet their order before the
    roll-up: the join partitions them by order, which already fits the grouping, and a filter on the order's columns
    reaches the order scan, because they are grouping keys.
    """
    st = stores(spark, d)
    lines = items(spark, d)
    if banner is not None:
        st = st.filter(F.col("banner_code") == banner)
        lines = lines.join(st.select("store_id"), "store_id", "left_semi")
    dims = st.select("store_id", "banner_code", "segment", "neighborhood")
    placed = parted_join(lines, orders(spark, d), "txn_id")
    return visit_rollup(placed, ("customer_token", "txn_ts", "tender")).join(dims, "store_id").withColumn(
        "visit_id", F.concat_ws("-", "txn_id", "store_id")
    )


def visit_rollup(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Lines -> one row per order and store.

    All buffers are fixed-width (one-letter flags travel as codes), which keeps this, the widest aggregation of the
    panel, a hash aggregation; store facts join afterwards.  `carry` names columns of the order, further keys.
    """
    mode, network = F.char(F.max(F.ascii("entry_mode"))), F.char(F.max(F.ascii("network")))
    per = lines.groupBy("txn_id", "store_id", *carry).agg(
        sum_money("line_total").alias("subtotal"),
        sum_money("discount").alias("discount_total"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("qty").alias("n_units"),
        mode.alias("entry_mode"),
        network.alias("network"),
    )
    wallet = F.col("entry_mode") == "R"
    return per.withColumns({
        "wallet_at_tap": wallet,
        "wallet_provider": F.when(wallet, F.concat(F.lit("W"), F.col("network"))),
    })


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events as transactions with a time of day; the event type plays the banner."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("customer_token"),
        kind.alias("banner_code"),
        F.when(kind.isin("purchase", "signup"), "commit").otherwise("browse").alias("segment"),
        F.col("ts").alias("txn_ts"),
        F.col("value").alias("subtotal"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
