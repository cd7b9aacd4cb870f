"""Readers and sinks over files that Spark derives from the given tables and writes to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions.money import sum_money
from tallyscope.operators import shaping
from tallyscope.plans.registry import query
from tallyscope.plans.sql import IT, PR, VIEWER, money, total
from tallyscope.sources import census, readers, sinks

DEPARTMENTS = ["ECONOMY", "STANDARD", "MEDIUM", "SMALL", "LARGE", "PROMO"]


@query("write_sorted", """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority, true AS columns_sorted FROM orders""")
def _write_sorted(spark, d):
    """Orders through the sorted sink and back."""
    path = sinks.shared_folder(spark, "sorted")
    names = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"]
    sinks.write_sorted(census.table(spark, d, "orders").select(*names), path, ["o_orderkey"])
    back = spark.read.parquet(path)
    return back.withColumn("columns_sorted", F.lit(back.columns == sorted(names)))


@query("write_partitioned", """SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders""")
def _write_partitioned(spark, d):
    """Orders in one folder per status and back; the status comes from the folder names."""
    path = sinks.shared_folder(spark, "partitioned")
    orders = census.table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    sinks.write_partitioned(orders, path, ["o_orderstatus"], ["o_orderkey"])
    return spark.read.parquet(path)


@query("write_contract", f"""WITH {IT} SELECT 'raw' AS area, 'transactions' AS "table", count(*) AS n_rows FROM orders
UNION ALL SELECT 'raw', 'transaction_items', count(*) FROM it
UNION ALL SELECT 'eval', 'anomalies_groundtruth', count(*) FROM it WHERE promo_id IS NOT NULL""")
def _write_contract(spark, d):
    """Observable tables and the answer key, written apart and counted from their own folders."""
    root = sinks.shared_folder(spark, "contract")
    items = census.items(spark, d)
    tables = {
        "transactions": census.orders(spark, d), "transaction_items": items,
        "anomalies_groundtruth": items.filter("promo_id IS NOT NULL").select("txn_id", "line_id", "promo_id"),
    }
    keys = {"transactions": ["txn_id"], "transaction_items": ["txn_id", "line_id"], "anomalies_groundtruth": ["txn_id", "line_id"]}
    sinks.write_contract(tables, root, keys)
    areas = {"transactions": "raw", "transaction_items": "raw", "anomalies_groundtruth": "eval"}
    out = None
    for name, area in areas.items():
        part = readers.row_counts({name: spark.read.parquet(f"{root}/{area}/{name}.parquet")}).withColumn("area", F.lit(area))
        out = part if out is None else out.unionByName(part)
    return out


@query("read_products_csv", f"""WITH {PR} SELECT CAST(sku AS VARCHAR) AS sku, product_name, department AS merchant_department, category AS merchant_category,
  subcategory AS merchant_subcategory, CAST(size AS VARCHAR) AS size, private_label, shelf_price FROM pr""")
def _read_products_csv(spark, d):
    """The catalogue as CSV with header, read with declared types: sizes stay text, flags and prices are typed."""
    path = sinks.shared_folder(spark, "products-csv")
    p = census.products(spark, d)
    given = {"sku": "sku", "product_name": "product_name", "merchant_department": "department", "merchant_category": "category",
             "merchant_subcategory": "subcategory", "size": "size", "private_label": "private_label", "shelf_price": "shelf_price"}
    names = [c.split()[0] for c in readers.PRODUCT_SCHEMA.split(", ")]
    p.select(*[(F.col(given[c]) if c in given else F.lit(None).cast("string")).alias(c) for c in names]).write.option("header", True).csv(path)
    return readers.read_products_csv(spark, path).select(*given)


@query("read_canonical_map_csv", f"""WITH {PR} SELECT category AS banner_code, CAST(sku AS VARCHAR) AS sku, subcategory AS canonical_id FROM pr""")
def _read_canonical_map_csv(spark, d):
    path = sinks.shared_folder(spark, "canonical-csv")
    p = census.products(spark, d)
    p.select(F.col("category").alias("banner_code"), "sku", F.col("subcategory").alias("canonical_id")).write.option("header", True).csv(path)
    return readers.read_canonical_map_csv(spark, path)


def _base_catalog(spark, d):
    """One JSON array file per department: its product families by name, each with its least price.

    A file's array is as long as the vocabulary of family names, not as the catalogue.
    """
    root = sinks.shared_folder(spark, "base-catalog")
    families = census.products(spark, d).groupBy("department", "subcategory").agg(F.min("shelf_price").alias("base_price"))
    item = F.struct(F.col("subcategory").alias("name"), "subcategory", "base_price")
    arrays = families.groupBy("department").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("value"))
    arrays.write.partitionBy("department").text(root)
    return readers.read_base_catalog(spark, {c: f"{root}/department={c}" for c in DEPARTMENTS})


BASE = f"""{PR}, fam AS (SELECT department AS category, subcategory, min(shelf_price) AS base_price FROM pr GROUP BY 1, 2),
base AS (SELECT category || '-' || lpad(CAST(row_number() OVER (PARTITION BY category ORDER BY subcategory) AS VARCHAR), 4, '0') AS canonical_sku,
  subcategory AS name, category, subcategory, base_price FROM fam)"""


@query("read_base_catalog", f"WITH {BASE} SELECT * FROM base")
def _read_base_catalog(spark, d):
    return _base_catalog(spark, d)


@query("apply_overlay", f"""WITH {BASE} SELECT '{VIEWER}' AS merchant_id, canonical_sku, name, category, subcategory,
  round(base_price * CASE WHEN category IN ('PROMO', 'SMALL') THEN 1.02 WHEN category = 'LARGE' THEN 1.2 ELSE 1.0 END::DOUBLE, 2) AS price
FROM base WHERE length(name) % 2 = 0""")
def _apply_overlay(spark, d):
    """A merchant's overlay as JSON, listing the families with names of even length, on the base catalogue."""
    path = sinks.shared_folder(spark, "overlay")
    base = _base_catalog(spark, d)
    listed = base.filter(F.length("name") % 2 == 0).agg(F.sort_array(F.collect_list("canonical_sku")).alias("included_canonical_skus"))
    listed.select(
        F.lit(VIEWER).alias("merchant_id"), F.lit(0.5).alias("keep_fraction"), F.lit(1.02).alias("tight_multiplier"),
        F.lit(1.2).alias("loose_multiplier"), F.array(F.lit("PROMO"), F.lit("SMALL")).alias("tight_categories"),
        F.array(F.lit("LARGE")).alias("loose_categories"), "included_canonical_skus",
    ).coalesce(1).write.json(path)
    return readers.apply_overlay(base, readers.read_overlay(spark, path))


@query("numeric_column_check", f"""WITH {IT} SELECT network AS flag, {total('qty')} AS qty, {money('line_total')} AS line_total,
  (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE SELECT * FROM it) WHERE column_type = 'VARCHAR') AS refused FROM it GROUP BY 1""")
def _numeric_column_check(spark, d):
    """Every column tried as a series of a chart: those that pass are summed, the others are listed."""
    items = census.items(spark, d)
    refused = []
    for c in items.columns:
        try:
            shaping.numeric_column_check(items, ["network"], [c])
        except shaping.ChartColumnError:
            refused.append(c)
    checked = shaping.numeric_column_check(items, ["network"], ["qty", "line_total"])
    return checked.groupBy(F.col("network").alias("flag")).agg(
        F.sum("qty").alias("qty"), sum_money("line_total").alias("line_total"), F.lit(",".join(sorted(refused))).alias("refused"))
