"""The published lake: partial and atomic publishing, reconciliation of what is written, stored sketches, distinct counts over sets."""

import collections
import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import lake, privacy, quality, shaping
from tallyscope.sources import sinks

BANNERS = ["NOR", "EAS", "SOU"]


def panel(spark, months=("2026-01", "2026-02", "2026-03"), per_month=4):
    stores = spark.createDataFrame([(f"S{b}", b, "a" if b != "SOU" else "b", "Uptown") for b in BANNERS],
                                   "store_id string, banner_code string, segment string, neighborhood string")
    merchants = spark.createDataFrame([(b, "a" if b != "SOU" else "b") for b in BANNERS], "merchant_id string, segment string")
    products = spark.createDataFrame([("milk", "Dairy", "Milk", "Whole"), ("bun", "Bread", "Bun", "Round")], "sku string, department string, category string, subcategory string")
    txns, items = [], []
    for m in months:
        for i in range(per_month):
            for b in BANNERS:
                t = f"{b}-{m}-{i}"
                txns.append((t, f"S{b}", "c", dt.datetime.fromisoformat(f"{m}-1{i}T13:00:00"), "credit", "visa", "tap", True, "w"))
                items += [(t, n, s, n + i, 3.5 * n, 0.0, 3.5 * n * (n + i)) for n, s in ((1, "milk"), (2, "bun"))]
    txns = spark.createDataFrame(txns, "txn_id string, store_id string, customer_token string, txn_ts timestamp_ntz, tender string, network string, entry_mode string, wallet_at_tap boolean, wallet_provider string")
    items = spark.createDataFrame(items, "txn_id string, line_id int, sku string, qty int, unit_price double, discount double, line_total double")
    return merchants, stores, items, txns, products


def folders(root):
    return {v: sorted(p for p in os.listdir(f"{root}/lines/data/{v}") if p.startswith("txn_month")) for v in os.listdir(f"{root}/lines/data")}


def test_a_late_day_rewrites_one_month(spark, tmp_path):
    root = str(tmp_path)
    merchants, stores, items, txns, products = panel(spark)
    lake.build_lake(root, items, products, txns, stores, merchants)
    before, old = folders(root), lake.lake_lines(spark, root)
    n = old.count()
    late = txns.filter("txn_id = 'NOR-2026-02-0'").withColumns({"txn_id": F.lit("late"), "txn_ts": F.lit(dt.datetime(2026, 2, 28, 9)).cast("timestamp_ntz")})
    extra = items.filter("txn_id = 'NOR-2026-02-0'").withColumn("txn_id", F.lit("late"))
    assert lake.add_late_lines(root, extra, products, late, stores) == ["2026-02"]
    new = {v: p for v, p in folders(root).items() if v not in before}
    assert list(new.values()) == [["txn_month=2026-02"]] and {v: p for v, p in folders(root).items() if v in before} == before
    assert lake.lake_lines(spark, root).count() == n + 2
    assert old.count() == n  # a reader that was at work keeps its files
    per = dict(lake.lake_lines(spark, root).groupBy("txn_month").count().collect())
    assert per == {"2026-01": 24, "2026-02": 26, "2026-03": 24}


def test_a_failed_write_leaves_the_old_lake(spark, tmp_path):
    root = str(tmp_path)
    merchants, stores, items, txns, products = panel(spark)
    lake.build_lake(root, items, products, txns, stores, merchants)
    n = lake.lake_lines(spark, root).count()
    broken = items.withColumn("qty", F.when(F.col("txn_id") == "EAS-2026-03-1", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("qty")))
    with pytest.raises(Exception, match="lost"):
        lake.add_late_lines(root, broken, products, txns, stores)
    assert lake.lake_lines(spark, root).count() == n
    # A manifest that was cut short is not followed either.
    number, held = sinks.manifest(spark, f"{root}/lines")
    part = spark.createDataFrame([(number + 1, 3, "2026-01", "nowhere")], sinks.MANIFEST)
    part.write.json(f"{root}/lines/manifests/{number + 1:012d}")
    assert sinks.manifest(spark, f"{root}/lines") == (number, held) and lake.lake_lines(spark, root).count() == n


def test_publishing_replaces_only_what_it_touches(spark, tmp_path):
    root, schema = str(tmp_path), "p string, v int"
    assert sinks.read_published(spark, root, "p") is None
    sinks.publish_partitions(spark.createDataFrame([("x", 1), ("y", 2)], schema), root, "p")
    sinks.publish_partitions(spark.createDataFrame([("y", 3)], schema), root, "p")
    sinks.append_published(spark.createDataFrame([("y", 4), ("z", 5)], schema), root, "p")
    assert sorted(tuple(r) for r in sinks.read_published(spark, root, "p").select("p", "v").collect()) == [("x", 1), ("y", 3), ("y", 4), ("z", 5)]
    assert sinks.manifest(spark, root)[0] == 3
    sinks.publish_partitions(spark.createDataFrame([("w", 6)], schema), root, "p", replace=True)
    assert [tuple(r) for r in sinks.read_published(spark, root, "p").select("p", "v").collect()] == [("w", 6)]
    with pytest.raises(ValueError, match="name a folder"):
        sinks.publish_partitions(spark.createDataFrame([("a/b", 1)], schema), root, "p")
    assert sinks.manifest(spark, root)[0] == 4


def test_reconciliation_reads_the_written_lake(spark, tmp_path):
    merchants, stores, items, txns, products = panel(spark)
    for name, change in (("same", None), ("altered", F.col("qty") + F.when(F.col("txn_id") == "EAS-2026-02-1", 1).otherwise(0))):
        root = str(tmp_path / name)
        written = items if change is None else items.withColumn("qty", change.cast("int"))
        lake.build_lake(root, written, products, txns, stores, merchants)
        got = lake.published_reconciliation(spark, root, items, products, txns, stores)
        bad = [tuple(r) for r in got.filter("NOT match").select("txn_month", "lake_lines", "own_lines").collect()]
        assert got.count() == 9 and bad == ([] if change is None else [("2026-02", 8, 8)])
    # a lost month is a mismatch as well
    lines = sinks.read_published(spark, str(tmp_path / "same") + "/lines", "txn_month", ["2026-01"])
    sinks.publish_partitions(lines, str(tmp_path / "same") + "/lines", "txn_month", replace=True)
    got = lake.published_reconciliation(spark, str(tmp_path / "same"), items, products, txns, stores)
    assert sorted({r["txn_month"] for r in got.filter("NOT match").collect()}) == ["2026-02", "2026-03"]


def store_on_the_line(items, txns):
    """The same panel with store and card on the lines; an order adds time and tender only."""
    line = ["store_id", "network", "entry_mode", "wallet_at_tap", "wallet_provider"]
    return items.join(txns.select("txn_id", *line), "txn_id"), txns.drop(*line)


def exchanges(df):
    """Columns that each exchange of the plan gets, by the text of its node."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    nodes = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", text)
    return text, [({c.split("#")[0] for c in columns.split(", ")}, arguments) for columns, arguments in nodes]


def test_lines_are_shuffled_with_ids_and_hashes(spark, tmp_path, monkeypatch):
    merchants, stores, items, txns, products = panel(spark)
    items, txns = store_on_the_line(items, txns)
    items, txns = (sinks.write_layout(df, str(tmp_path / n)) or spark.read.parquet(str(tmp_path / n)) for df, n in ((items, "items"), (txns, "txns")))
    written, root = [], str(tmp_path / "lake")
    write = sinks.write_layout
    monkeypatch.setattr(sinks, "write_layout", lambda df, *a: (written.append(df), write(df, *a)))
    lake.build_lake(root, items, products, txns, stores, merchants)
    text, dealt = exchanges(written[0])
    names = {"lake_txn_id", "lake_store_id", "lake_line_id", "category", "department", "merchant_token", "peer_segment"}
    (month,) = [c for c, a in dealt if "REBALANCE" in a]
    assert not month & {n for n in names if n.startswith("lake_")} and {"txn_id", "store_id", "line_id", "txn_month"} <= month
    assert not any(c & names for c, a in dealt if "hashpartitioning(txn_id" in a)
    # Orders are small enough to be broadcast here, but they are facts: a larger lake is built by the same plan.
    assert "SortMergeJoin" in text
    text, dealt = exchanges(lake.own_digest(items, products, txns, stores))
    assert "SortMergeJoin" in text
    assert sorted(sorted(c) for c, a in dealt if "hashpartitioning(txn_id" in a) == [["_line", "merchant_token", "txn_id"], ["tender", "txn_id", "txn_ts"]]


def test_own_digest_is_that_of_the_published_lines(spark, tmp_path):
    """Whether the store is on the line or on the order, and whichever of the two the lake was written from."""
    merchants, stores, items, txns, products = panel(spark)
    contracts = [(items, txns), store_on_the_line(items, txns)]
    want = sorted(map(tuple, lake.line_digest(lake.published_lines(items, products, txns, stores), "own").collect()))
    assert len(want) == 9 and sum(r[2] for r in want) == 72
    for i, (lines, orders) in enumerate(contracts):
        # Columns of orders that lines or products have as well do not replace them, and keep an order from being hashed apart.
        for extra in ({}, {"category": F.lit("x"), "qty": F.lit(0)}):
            assert sorted(map(tuple, lake.own_digest(lines, products, orders.withColumns(extra), stores).collect())) == want
        lake.build_lake(str(tmp_path / str(i)), lines, products, orders, stores, merchants)
        for other_lines, other_orders in contracts:
            got = lake.published_reconciliation(spark, str(tmp_path / str(i)), other_lines, products, other_orders, stores)
            assert [r["match"] for r in got.collect()] == [True] * 9


def test_every_published_fact_is_reconciled(spark, tmp_path):
    merchants, stores, items, txns, products = panel(spark)
    items, txns = store_on_the_line(items, txns)
    lake.build_lake(str(tmp_path), items, products, txns, stores, merchants)
    here = F.col("txn_id") == "EAS-2026-02-1"
    changes = [("unit_price", F.lit(0.01)), ("qty", F.col("qty") + 1), ("sku", F.lit("milk")), ("store_id", F.lit("SNOR")), ("line_id", F.col("line_id") + 5),
               ("entry_mode", F.lit(None).cast("string")), ("wallet_provider", F.lit("z")), ("tender", F.lit("cash")), ("tender", F.lit(None).cast("string")),
               ("txn_ts", F.lit(dt.datetime(2026, 2, 12, 13)).cast("timestamp_ntz"))]
    for name, value in changes:
        lines, orders = (df.withColumn(name, F.when(here, value).otherwise(F.col(name))) if name in df.columns else df for df in (items, txns))
        got = lake.published_reconciliation(spark, str(tmp_path), lines, products, orders, stores)
        assert {r["txn_month"] for r in got.filter("NOT match").collect()} == {"2026-02"}, name


def test_peers_of_a_published_lake_are_picked_in_the_scan(spark, tmp_path):
    root = str(tmp_path)
    merchants, stores, items, txns, products = panel(spark)
    lake.build_lake(root, items, products, txns, stores, merchants)
    lines, _ = lake.viewer_lake(spark, root, "NOR")
    assert dict(lines.groupBy("peer_relationship").count().collect()) == {"self": 24, "peer": 24, "merchant": 24}
    own, stores = lake.viewer_lake(spark, root, "NOR", ["self", "peer"])
    assert dict(own.groupBy("peer_relationship").count().collect()) == {"self": 24, "peer": 24} and stores.count() == 2
    peers, _ = lake.viewer_lake(spark, root, "NOR", ["peer"])
    assert peers.count() == 24
    plan = peers.groupBy("category").agg(F.sum("qty"))._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan and "EqualTo(peer_segment,a)" in plan


def facts(spark, n=4000):
    rng = random.Random(3)
    data = [(rng.choice(["self", "peer", "peer", "merchant"]), rng.choice(["d1", "d2", None]), rng.choice("abc"), rng.choice([rng.randrange(-5, 90000), rng.randrange(200)]) if rng.random() > 0.02 else None,
             rng.randrange(1, 9), round(rng.uniform(0, 50), 2)) for _ in range(n)]
    return data, spark.createDataFrame(data, "peer_relationship string, d string, c string, txn bigint, qty int, price double")


@pytest.mark.parametrize("grouping", ["plain", "rollup", "cube"])
def test_distinct_counts_over_grouping_sets(spark, grouping):
    data, df = facts(spark)
    got = privacy.distinct_over_sets(df, ["d", "c"], "txn", {"units": F.col("qty")}, "n_txns", ["peer"], grouping, 1)
    want = {}
    for level in {"plain": [0], "rollup": [0, 1, 3], "cube": [0, 1, 2, 3]}[grouping]:
        groups = collections.defaultdict(list)
        for r in data:
            if r[0] == "peer":
                groups[None if level & 2 else r[1], None if level & 1 else r[2], level].append(r)
        for k, g in groups.items():
            want[k] = (sum(r[4] for r in g), len({r[3] for r in g if r[3] is not None}))
    assert {(r["d"], r["c"], 0 if grouping == "plain" else r["level"]): (r["units"], r["n_txns"]) for r in got.collect()} == want


def test_cells_and_not_facts_are_expanded(spark):
    _, df = facts(spark, 200)
    plan = privacy.distinct_over_sets(df, ["d", "c"], "txn", {"units": F.col("qty")}, "n", ["peer"], "cube")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("bitmap_construct_agg")


def test_merged_sketches_keep_their_errors(spark):
    """Far more ids and values than the sketches hold, in cells merged to one."""
    n = 300_000
    df = spark.range(n).select(F.lit("peer").alias("peer_relationship"), (F.col("id") % 7).alias("cell"), (F.col("id") * 7919 % 100_003).alias("ident"),
                               F.when(F.col("id") % 11 != 0, (F.col("id") * 104729 % n).cast("double")).alias("v"))
    cells = privacy.sketch_cells(df, ["cell"], "ident", "v")
    assert cells.count() == 7
    (r,) = privacy.from_sketches(cells, [], {"q10": 0.1, "median": 0.5, "q99": 0.99}).collect()
    assert r["n_rows"] == n and r["n_values"] == n - -(-n // 11)
    assert abs(r["distinct_estimate"] / 100_003 - 1) < 4 * r["distinct_error"]
    values = sorted(i * 104729 % n for i in range(n) if i % 11)
    for name, q in (("q10", 0.1), ("median", 0.5), ("q99", 0.99)):
        rank = sum(x <= r[name] for x in values) / len(values)
        assert abs(rank - q) < 2 * r["rank_error"]
    few = privacy.sketch_cells(df.limit(10).withColumn("v", F.lit(None).cast("double")), ["cell"], "ident", "v")
    assert privacy.from_sketches(few, [], {"m": 0.5}, k=1).first()["m"] is None
    assert privacy.from_sketches(few, [], {"m": 0.5}).count() == 0


def test_every_aggregate_takes_every_row(spark):
    data = [("peer", "g", i, (i * 7) % 5 - 1 if i % 10 == 3 else (i * 7) % 5 + 1, float(i % 13), i % 2 == 0, f"a{i % 3}") for i in range(200)]
    df = spark.createDataFrame(data, "peer_relationship string, g string, i int, q int, v double, flag boolean, arg string").repartition(7)
    r = privacy.lake_agg_functions(df, ["g"], "v", "q", "arg", F.col("flag"), ["i"]).first()
    values = [x[3] for x in data]
    assert r["first"] == 0.0 and r["last"] == float(199 % 13) and r["approx_distinct"] == r["n_distinct"] == len(set(values))
    assert r["product_zeros"] == values.count(0) and r["product_sign"] == (0 if 0 in values else 1)
    product = 1
    for x in values:
        product *= abs(x) or 1
    assert abs(r["product_log10"] - (len(str(product)) - 1)) <= 1
    signs = spark.createDataFrame([(3, -2), (2, 5), (1, -1)], "n bigint, v bigint")
    assert tuple(signs.agg(*privacy.log_product("n", "v")).first()) == (1, 0, round(3 * 0.30103 + 2 * 0.69897, 6))


def test_whole_keys_meet_a_bit_table(spark):
    parents = spark.createDataFrame([(k,) for k in [*range(0, 500, 3), -1, -64, -65, 2**62]], "k bigint")
    child = [*range(-70, 510), 2**62, 2**62 + 1, None, None, 3, 4, 4]
    df = spark.createDataFrame([(k,) for k in child], "k bigint").repartition(3)
    held = {r[0] for r in parents.collect()}
    lost = [k for k in child if k is not None and k not in held]
    out = quality.referential_integrity([("fk", df, "k", parents, "k"), ("text", df.select(F.col("k").cast("string").alias("k")), "k", parents.select(F.col("k").cast("string").alias("k")), "k")])
    assert [tuple(r) for r in out.collect()] == [(n, len(lost), len(set(lost))) for n in ("fk", "text")]
    empty = quality.referential_integrity([("fk", df, "k", parents.limit(0), "k")])
    assert tuple(empty.first())[1:] == (len(child) - 2, len({k for k in child if k is not None}))


def test_chart_values_of_any_size(spark):
    data = [("a", 6e10, 0), ("a", 7e10, 0), ("b", 1e12, 0), ("b", 1e12 + 0.0001, 1), ("c", 0.0001, 0), ("c", 0.0002, 1), ("d", None, 0), ("e", float("nan"), 0)]
    df = spark.createDataFrame(data, "x string, v double, o int")
    got = {r["x"]: r["v"] for r in shaping.series_by_x(df, "x", ["v"]).collect()}
    assert got == {"a": 6.5e10, "b": pytest.approx(1e12 + 0.00005, rel=1e-15), "c": pytest.approx(0.00015), "d": None, "e": None}
    got = {r["x"]: r["v"] for r in shaping.waterfall_contributions(df, "x", "v").collect()}
    assert got["b"] == pytest.approx(2e12 + 0.0001, rel=1e-15) and got["c"] == pytest.approx(0.0003) and got["a"] == 1.3e11
