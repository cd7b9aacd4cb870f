"""Every registered query, whole tables, against its check SQL; and invariants that hold without SQL."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import joins
from tallyscope.plans import PLANS, SQL
from tallyscope.plans.lake_queries import peer_lake
from tallyscope.sources import census
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_sql(spark, con, sf_dir, name):
    diff, _, _ = compare(spark, con, PLANS[name], SQL.get(name), sf_dir)
    assert diff is None, diff


def test_every_query_has_sql():
    assert set(PLANS) == set(SQL)


def test_entry_runs(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns[0] == "category" and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_declared_schemas_match_the_files(spark, sf_dir):
    for name in census.SCHEMAS:
        inferred = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        assert [(f.name, f.dataType) for f in inferred] == [
            (f.name, f.dataType) for f in census.table(spark, sf_dir, name).schema
        ]


def test_shares_add_up(spark, sf_dir):
    mix = PLANS["department_mix"](spark, sf_dir).filter("level = 0").agg(F.sum("pct_of_parent")).first()[0]
    assert mix == pytest.approx(100)
    zones = PLANS["zone_banner_mix"](spark, sf_dir).groupBy("home_zone").agg(F.sum("share").alias("s"))
    assert zones.filter(F.abs(F.col("s") - 1) > 1e-9).isEmpty()


def test_kept_and_suppressed_groups_add_up(spark, sf_dir):
    from tallyscope.operators.privacy import k_anonymous_aggregate, lake_groups
    from tallyscope.plans.lake_queries import peer_lake

    lake = peer_lake(spark, sf_dir)
    kept, summary = k_anonymous_aggregate(lake, ["category"], {"n": F.count(F.lit(1))})
    s = summary.first()
    assert kept.count() + s["n_suppressed"] == s["n_groups"]
    least = lake_groups(lake, ["category"], {"n": F.count(F.lit(1))}).join(kept.select("category"), "category")
    assert least.agg(F.min("_k")).first()[0] >= 50


def test_another_viewer_changes_labels_only(spark, sf_dir):
    from tallyscope.plans.lake_queries import peer_lake

    a, b = (peer_lake(spark, sf_dir, v, wide=True) for v in ("NATION_3", "NATION_8"))
    cols = [c for c in a.columns if c != "peer_relationship"]
    total = [x.agg(F.count(F.lit(1)), F.sum("qty"), F.sum(F.hash(*cols).cast("long"))).first() for x in (a, b)]
    assert total[0] == total[1]


PLAN_RULES = ["price_gap", "velocity", "kpi_strip", "viewer_lake", "attach_rate", "merchant_pair_overlap", "gravity_weights",
              "viewer_lake", "referential_integrity", "promo_lines", "anomaly_affected_txns", "promo_window_units"]


@pytest.mark.parametrize("name", PLAN_RULES)
def test_no_cross_product_in_the_plan(spark, sf_dir, name):
    plan = PLANS[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["viewer_lake", "lake_metadata"])
def test_viewers_are_not_exploded_beside_stores(spark, sf_dir, name):
    plan = PLANS[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(viewer" not in plan and "Join Cross" not in plan


def test_visits_take_one_shuffle_of_the_lines(spark, sf_dir):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = PLANS["kpi_strip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("FileScan parquet [l_") == 1
    # Lines and orders once each; the roll-up fits the partitioning of their join.
    assert plan.count("Exchange hashpartitioning(txn_id") == 2
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_facts_are_not_shuffled_to_meet_dimensions(spark):
    plan = PLANS["velocity"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan.split("FileScan parquet [l_partkey")[0].split("store_id")[0]
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in plan


def test_window_reaches_the_scan(spark, sf_dir):
    plan = PLANS["tenant_scope"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize("name", ["merchant_profile", "card_banner_share", "average_ticket"])
def test_order_join_is_split_by_the_files(spark, sf_dir, monkeypatch, name):
    """Partitions of lines and orders follow the size of their files, not the session: one task's memory does not grow."""
    size = sum(os.path.getsize(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    rows = []
    for part in (size, size // 40):
        monkeypatch.setattr(joins, "PART_BYTES", part)
        df = PLANS[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        split = {int(n) for n in re.findall(r"hashpartitioning\(txn_id#\w+, (\d+)\), REPARTITION_BY_NUM", plan)}
        assert split == {max(-(-size // part), spark.sparkContext.defaultParallelism)}
        rows.append(sorted(map(tuple, df.collect())))
    assert rows[0] == rows[1]


def test_products_of_few_bytes_and_many_rows_are_not_broadcast(spark, sf_dir, tmp_path):
    """A catalogue of 2 million products is small in its file: its rows would take hundreds of MB on the driver."""
    d, n = f"{tmp_path}/a b%20c", 10_000
    os.mkdir(d)
    for name in os.listdir(sf_dir):
        if name != "part.parquet":
            os.symlink(f"{sf_dir}/{name}", f"{d}/{name}")
    shifted = "SELECT * REPLACE (p_partkey + i * (SELECT max(p_partkey) + 1 FROM part) AS p_partkey)"
    connect(sf_dir).execute(f"COPY ({shifted} FROM part, range({n}) r(i) ORDER BY i, p_partkey) TO '{d}/part.parquet' (FORMAT parquet)")
    products = census.products(spark, d)
    assert joins.source_bytes(products) <= joins.BROADCAST_LIMIT
    assert joins.source_rows(products) == n * census.products(spark, sf_dir).count()
    joined = re.findall(r"(\w+Join) \[sku", peer_lake(spark, d, timed=True).select("sku", "category", "txn_ts")._jdf.queryExecution().sparkPlan().toString())
    assert joined == ["SortMergeJoin"]
    diff, count, _ = compare(spark, connect(d), PLANS["lake_sketches"], SQL["lake_sketches"], d)
    assert diff is None and count == PLANS["lake_sketches"](spark, sf_dir).count(), diff


def test_rows_of_a_source_are_those_of_its_files(spark, tmp_path):
    df = spark.range(1000).withColumn("part", F.when(F.col("id") % 3 != 0, F.concat(F.lit("a/ %"), F.col("id") % 3)))
    df.repartition(5).write.partitionBy("part").parquet(f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert joins.source_rows(back) == 1000 and 10 < joins.source_rows(back, 10) <= 1000
    assert joins.source_rows(back.filter("id < 5").join(spark.range(7), "id")) == 1000
    back.write.json(f"{tmp_path}/j")
    assert joins.source_rows(spark.read.json(f"{tmp_path}/j")) == joins.source_rows(df) == 0
