"""Operators on small frames written by hand, contract errors, and brute-force checks."""

import collections
import datetime as dt
import json
import random
import re
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyscope.functions import calendar, hashing, money, ranking, text
from tallyscope.functions.joins import bounded, source_bytes
from tallyscope.operators import (
    baskets, cards, claims, compare, customers, lake, privacy, quality, report, scope, shaping, transforms, weeks,
)
from tallyscope.sources import readers, sinks

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- movers -----------------------------------------------------------------------------------------------------

def plain_movers(data, floor=50, least=0.0, n=3):
    """data: (group, period, value, rows).  The newest period against the mean of the four before it, by plain loops."""
    newest = sorted({p for _, p, _, _ in data})[-5:]
    out = []
    for g in {x[0] for x in data}:
        mine = {p: (v, c) for x, p, v, c in data if x == g and p in newest}
        if len(newest) < 5 or len(mine) < 5 or any(c < floor for _, c in mine.values()):
            continue
        base = sum(mine[p][0] for p in newest[:-1]) / 4
        change = round((mine[newest[-1]][0] - base) / base, 4) if base > 0 and base >= least else 0
        if change:
            out.append((-abs(change), change < 0, g, mine[newest[-1]][0], base, change, "up" if change > 0 else "down"))
    ranked, seen = [], collections.Counter()
    for _, _, g, recent, base, change, way in sorted(out):
        seen[way] += 1
        if seen[way] <= n:
            ranked.append((g, recent, base, change, way))
    return ranked


@pytest.mark.parametrize("seed", range(4))
def test_movers_match_plain_loops(spark, seed):
    """Histories of seven months with gaps, thin months, still and tiny series, and several groups that move alike."""
    rng = random.Random(seed)
    months = [f"2025-{m:02d}" for m in range(3, 10)]
    data = []
    for i in range(90):
        level = rng.choice([0.5, 8, 64, 512])
        for m in months:
            if rng.random() > 0.02:
                move = rng.choice([0.75, 1.25, 1.5, 2.5]) if m == months[-1] else 1.0
                data.append((f"g{i:02d}", m, level * move, rng.choice([49, 50, 51]) if rng.random() < 0.03 else 400))
    df = spark.createDataFrame(data, "grp string, month string, sold double, rows int").repartition(3)
    for floor, least in ((50, 0.0), (50, 10.0), (1, 0.0)):
        got = rows(compare.top_movers(df, "grp", "month", "sold", "rows", k=floor, min_volume=least))
        assert got == plain_movers(data, floor, least) and 2 < len(got) <= 6
    early = [x for x in data if x[1] < months[4]]
    none = compare.top_movers(spark.createDataFrame(early, df.schema), "grp", "month", "sold", "rows")
    assert rows(none) == [] and none.columns == ["grp", "recent", "baseline", "delta_pct", "direction"]


# ---- own against peers ------------------------------------------------------------------------------------------

def gap_frames(spark):
    """Own averages at timestamps against peer rows at dates: one pair that meets, one over zero, one without a partner."""
    stamp = dt.datetime(2025, 8, 11)
    own = spark.createDataFrame(
        [("NOR", "Bakery", "west", stamp, 12.5), ("NOR", "Bakery", "east", stamp, 9.75), ("NOR", "Frozen", "west", stamp, 3.0)],
        "banner_code string, category string, zone string, start timestamp_ntz, own_avg double")
    peer = spark.createDataFrame(
        [("Bakery", "west", D(2025, 8, 11), "peer", 10.0, 812), ("Bakery", "east", D(2025, 8, 11), "peer", 0.0, 90), ("Bakery", "north", D(2025, 8, 11), "peer", 4.0, 77)],
        "category string, zone string, start date, peer_relationship string, idx double, txn_count int")
    return own, peer


def test_gap_joins_on_dates_of_either_type(spark):
    own, peer = gap_frames(spark)
    got = {r["zone"]: r for r in compare.own_peer_gap(own, peer, ["category", "zone", "start"], "own_avg", "idx", viewer="NOR").collect()}
    assert set(got) == {"west", "east"} and got["west"]["gap"] == 2.5 and got["west"]["txn_count"] == 812 and got["east"]["gap"] == 9.75


def test_gap_ratio_over_zero_is_null(spark):
    own, peer = gap_frames(spark)
    out = compare.own_peer_gap(own, peer, ["category", "zone", "start"], "own_avg", "idx", "ratio")
    got = {r["zone"]: r["gap"] for r in out.collect()}
    assert got["east"] is None and got["west"] is not None


def test_gap_refuses_foreign_rows_and_identities(spark):
    own, peer = gap_frames(spark)
    on = ["category", "zone", "start"]
    with pytest.raises(compare.GrainError):
        compare.own_peer_gap(own, peer, ["category", "nope"], "own_avg", "idx")
    with pytest.raises(compare.GrainError):
        compare.own_peer_gap(own, peer, on, "nope", "idx")
    with pytest.raises(compare.ViewerScopeError):
        compare.own_peer_gap(own, peer.withColumn("merchant_id", F.lit("X")), on, "own_avg", "idx")
    foreign = own.withColumn("banner_code", F.lit("EAS"))
    with pytest.raises(Exception, match="other merchants"):
        compare.own_peer_gap(foreign, peer, on, "own_avg", "idx", viewer="NOR").collect()


# ---- lake -------------------------------------------------------------------------------------------------------

BANNERS = [("NOR", "grocery"), ("EAS", "grocery"), ("SOU", "qsr"), ("MID", "qsr")]


def panel(spark):
    merchants = spark.createDataFrame(BANNERS, "merchant_id string, segment string")
    stores = spark.createDataFrame([(f"S{b}", b, b, s, "Uptown") for b, s in BANNERS],
                                   "store_id string, banner_code string, merchant_id string, segment string, neighborhood string")
    items = spark.createDataFrame([(f"T{b}", i, "milk", 1, 3.5, 0.0, None, 3.5) for b, _ in BANNERS for i in (1, 2)],
                                  "txn_id string, line_id int, sku string, qty int, unit_price double, discount double, promo_id string, line_total double")
    txns = spark.createDataFrame([(f"T{b}", f"S{b}", "c1", dt.datetime(2026, 4, 1, 13), "credit", "visa", "contactless", True, None if b == "EAS" else "apple")
                                  for b, _ in BANNERS],
                                 "txn_id string, store_id string, customer_token string, txn_ts timestamp_ntz, tender string, network string, entry_mode string, wallet_at_tap boolean, wallet_provider string")
    products = spark.createDataFrame([("milk", "Dairy & Eggs", "Milk", "Whole Milk")], "sku string, department string, category string, subcategory string")
    return merchants, stores, items, txns, products


def test_every_viewer_gets_a_labelled_lake(spark, tmp_path):
    merchants, stores, items, txns, products = panel(spark)
    meta = lake.build_lake(str(tmp_path), items, products, txns, stores, merchants)
    assert sorted(rows(meta.select("viewer", "segment_peer_count", "n_lines", "n_stores"))) == [(b, 1, 8, 4) for b in sorted(x for x, _ in BANNERS)]
    assert readers.register_lake_views(spark, str(tmp_path), "NOR")
    lines = spark.table("lake_transactions")
    assert lines.count() == 8 and set(lines.columns) == set(lake.LAKE_COLUMNS)
    labels = dict(rows(lines.groupBy("peer_relationship").count()))
    assert labels == {"self": 2, "peer": 2, "merchant": 4}
    first = lines.filter("peer_relationship = 'peer'").first()
    assert first["hour_bucket"] == 5 and first["wallet_type"] == "none" and first["txn_date"] == D(2026, 4, 1)
    assert all(r[1] == 0 for r in rows(lake.identity_leak_check(lines)))
    assert set(spark.table("lake_stores").columns) == set(lake.STORE_COLUMNS)
    assert not readers.register_lake_views(spark, str(tmp_path), "NOPE")
    assert not readers.register_lake_views(spark, str(tmp_path / "absent"), "NOR")


def test_leak_check_counts_violations(spark):
    bad = spark.createDataFrame([("self", 3, "K"), ("other", 12, "K")], "peer_relationship string, hour_bucket int, banner_code string")
    assert dict(rows(lake.identity_leak_check(bad.withColumn("merchant_category", F.lit("x"))))) == {
        "identity_columns": 1, "merchant_labels": 1, "relationship_vocabulary": 1, "hour_bucket_range": 1}


def test_unknown_viewer_fails(spark):
    merchants, stores, *_ = panel(spark)
    with pytest.raises(scope.UnknownViewerError):
        scope.check_viewer(merchants, "XXX")
    assert scope.check_viewer(merchants, "NOR") == "NOR"
    with pytest.raises(Exception, match="unknown viewer"):
        lake.label_stores(stores, merchants, "XXX").collect()


def test_tokens(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string").select(hashing.token(F.col("v"), "s").alias("t"))
    a, b, a2, none = [r[0] for r in rows(df)]
    assert a == a2 != b and none is None and re.fullmatch("[0-9a-f]{16}", a)


def k_frame(spark):
    data = [("at", "peer")] * 50 + [("under", "peer")] * 49 + [("under", "self")] * 9 + [("own", "self")] * 90
    return spark.createDataFrame(data, "g string, peer_relationship string")


def test_floor_counts_peer_rows_only(spark):
    kept, summary = privacy.k_anonymous_aggregate(k_frame(spark), ["g"], {"n": F.count(F.lit(1))})
    assert rows(kept) == [("at", 50)] and rows(summary) == [(3, 2)]


def test_limit_applies_after_the_floor(spark):
    kept, _ = privacy.k_anonymous_aggregate(k_frame(spark), ["g"], {"n": F.count(F.lit(1))}, order=[F.desc("n")], limit=1)
    assert rows(kept) == [("at", 50)]


def test_lake_contract(spark):
    df = k_frame(spark)
    for bad in (lambda: privacy.lake_groups(df, ["g"], {}), lambda: privacy.lake_groups(df.drop("peer_relationship"), [], {"n": F.count(F.lit(1))}),
                lambda: privacy.lake_groups(df, ["g"], {"n": F.count(F.lit(1))}, []), lambda: privacy.lake_groups(df, ["g"], {"_k": F.count(F.lit(1))}),
                lambda: privacy.lake_groups(df.withColumn("banner_code", F.lit("x")), ["g", "banner_code"], {"n": F.count(F.lit(1))})):
        with pytest.raises(privacy.LakeContractError):
            bad()
    assert rows(compare.peer_aggregate(df, [], {"n": F.count(F.lit(1))})) == [(99,)]


def test_peer_figures_carry_no_name_and_keep_the_floor(spark):
    data = [("B1", "peer", "big", 1.0, i) for i in range(60)] + [("B2", "peer", "big", 2.0, i) for i in range(49)] + [("B2", "peer", "rare", 9.0, 1)] * 49
    data += [("ME", "self", "big", 3.0, 1), ("ME", "self", "rare", 4.0, 1)]
    lines = spark.createDataFrame(data, "banner_code string, peer_relationship string, category string, unit_price double, txn_id int").withColumn("qty", F.lit(1))
    own, peers = lines.filter("peer_relationship = 'self'"), lines.filter("peer_relationship = 'peer'")
    labels = lake.label_peers(lines.select("banner_code", "peer_relationship").distinct())
    by_name = {r["banner_code"]: r["peer_label"] for r in labels.collect()}
    assert by_name["ME"] is None and {by_name["B1"], by_name["B2"]} == {"peer_1", "peer_2"}
    named = peers.join(labels.select("banner_code", "peer_label"), "banner_code")
    got = [r.asDict() for r in compare.price_by_peer_pivot(own, named, ["peer_1", "peer_2"], key="category").collect()]
    assert [(r["category"], r[f"price_{by_name['B1']}"], r[f"price_{by_name['B2']}"]) for r in got] == [("big", 1.0, None)]
    assert [r["category"] for r in compare.product_price_vs_peers(own, lines, key="category").collect()] == ["big"]
    assert {r["source"] for r in compare.line_share(lines, "rare").collect()} == {"self"}
    assert rows(compare.peer_basket_size(lines, by="category")) == [("big", 60, 109 / 60)]
    for bad in (lambda: compare.peer_basket_size(lines, by="banner_code"), lambda: compare.price_by_peer_pivot(own, peers, ["B1"], label="banner_code")):
        with pytest.raises(compare.ViewerScopeError):
            bad()


def test_tenant_scope_follows_transactions(spark):
    merchants, stores, items, txns, products = panel(spark)
    txns = txns.join(stores.select("store_id", "banner_code"), "store_id")
    tables = {"transactions": txns, "transaction_items": items, "stores": stores, "merchants": merchants}
    out = scope.tenant_scope(tables, "NOR", scope.Window(D(2026, 3, 1), D(2026, 5, 25)))
    assert {n: df.count() for n, df in out.items()} == {"transactions": 1, "transaction_items": 2, "stores": 1, "merchants": 1}
    early = scope.tenant_scope(tables, "NOR", scope.Window(D(2026, 3, 1), D(2026, 4, 1)))
    assert early["transaction_items"].isEmpty()


# ---- sources and sinks ------------------------------------------------------------------------------------------

def test_allow_list(spark, tmp_path):
    for table, cols in (("customers", None), ("zones", None), ("nope", None), ("stores", ["store_id", "zone_id"])):
        with pytest.raises(readers.ForbiddenColumnError):
            readers.check_columns(table, cols)
    assert readers.check_columns("stores", ["store_id"]) == ["store_id"]
    spark.range(3).select(F.col("id").alias("merchant_id"), F.lit("x").alias("secret"), F.lit("n").alias("name")).write.parquet(f"{tmp_path}/merchants.parquet")
    assert readers.allowlisted_read(spark, str(tmp_path), "merchants", ["merchant_id", "name"]).columns == ["merchant_id", "name"]


def test_path_guard(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/eval/a.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/raw/a.parquet")
    assert readers.check_source_paths(spark.read.parquet(f"{tmp_path}/raw/a.parquet"), f"{tmp_path}/eval").count() == 1
    with pytest.raises(readers.SourcePathError):
        readers.check_source_paths(spark.read.parquet(f"{tmp_path}/*/a.parquet"), f"{tmp_path}/eval")


def test_sorted_sink_is_ordered_and_stable(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("z"), F.col("id").alias("a"))
    for p in ("one", "two"):
        sinks.write_sorted(df, f"{tmp_path}/{p}", ["z"], files=3)
    back = spark.read.parquet(f"{tmp_path}/one")
    assert back.columns == ["a", "z"]
    files = [[r[0] for r in rows(spark.read.parquet(f).select("z"))] for f in sorted(back.inputFiles())]
    assert sorted(sum(files, [])) == list(range(1000)) and all(f == sorted(f) for f in files)
    a, b = (sinks.content_hash(spark.read.parquet(f"{tmp_path}/{p}"), "t").first() for p in ("one", "two"))
    assert a == b
    assert sinks.content_hash(back.limit(999), "t").first() != a


def test_partitioned_and_contract_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("a", 0)], "k string, v int")
    sinks.write_partitioned(df, f"{tmp_path}/p", ["k"], ["v"])
    assert (tmp_path / "p" / "k=a").is_dir() and spark.read.parquet(f"{tmp_path}/p").count() == 3
    with pytest.raises(ValueError):
        sinks.write_partitioned(df, f"{tmp_path}/q", [])
    sinks.write_contract({"t": df, "anomalies_groundtruth": df}, f"{tmp_path}/c", {"t": ["v"]})
    assert (tmp_path / "c/raw/t.parquet").exists() and (tmp_path / "c/eval/anomalies_groundtruth.parquet").exists()


def test_salted_sink_spreads_a_hot_partition(spark, tmp_path):
    df = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").otherwise("cold").alias("k"), "id")
    # Small partitions would rightly be coalesced into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_partitioned(df, f"{tmp_path}/s", ["k"], ["id"], salt=8)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = list((tmp_path / "s" / "k=hot").glob("*.parquet"))
    assert len(files) > 1 and spark.read.parquet(f"{tmp_path}/s").count() == 4000
    for f in files:
        ids = [r[0] for r in rows(spark.read.parquet(str(f)).select("id"))]
        assert ids == sorted(ids)


def test_csv_and_json_catalogues(spark, tmp_path):
    head = readers.PRODUCT_SCHEMA.replace(",", "").split()[::2]
    row = ["grocery", "NOR", "NOR", "s1", "Milk", "d", "b", "True", "012", "Dairy", "Milk", "Whole", "Dairy", "Milk", "Whole", "3.5"]
    (tmp_path / "p.csv").write_text(",".join(head) + "\n" + ",".join(row) + "\n")
    got = readers.read_products_csv(spark, f"{tmp_path}/p.csv").first()
    assert (got["size"], got["private_label"], got["shelf_price"]) == ("012", True, 3.5)
    (tmp_path / "m.csv").write_text("banner_code,sku,canonical_id\nNOR,s1,c1\n")
    assert rows(readers.read_canonical_map_csv(spark, f"{tmp_path}/m.csv")) == [("NOR", "s1", "c1")]
    (tmp_path / "dairy.json").write_text(json.dumps([{"name": "Milk", "subcategory": "milk", "base_price": 2}, {"name": "Brie", "subcategory": "cheese", "base_price": 5.5}], indent=1))
    (tmp_path / "baby.json").write_text(json.dumps([{"name": "Wipes", "subcategory": "wipes", "base_price": 4.0}]))
    base = readers.read_base_catalog(spark, {"DAIRY": f"{tmp_path}/dairy.json", "BABY": f"{tmp_path}/baby.json"})
    assert sorted(r[0] for r in rows(base)) == ["BABY-0001", "DAIRY-0001", "DAIRY-0002"]
    (tmp_path / "o.json").write_text(json.dumps({"merchant_id": "WES", "keep_fraction": 0.8, "tight_multiplier": 0.9, "loose_multiplier": 1.2,
                                                 "tight_categories": ["DAIRY"], "loose_categories": ["PET"], "included_canonical_skus": ["DAIRY-0002", "BABY-0001"]}, indent=1))
    priced = readers.apply_overlay(base, readers.read_overlay(spark, f"{tmp_path}/o.json"))
    assert sorted(rows(priced.select("canonical_sku", "price"))) == [("BABY-0001", 4.0), ("DAIRY-0002", 4.95)]


def test_broadcast_is_behind_a_size_check(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    assert 0 < source_bytes(df) < 1 << 20
    hint = "ResolvedHint"
    assert hint in bounded(df)._jdf.queryExecution().analyzed().toString()
    assert hint not in bounded(df, limit=10)._jdf.queryExecution().analyzed().toString()


# ---- cards ------------------------------------------------------------------------------------------------------

def weekly_txns(spark, per_week):
    start, data = dt.datetime(2026, 3, 2), []
    for w, amounts in enumerate(per_week):
        data += [(f"t{w}_{i}", start + dt.timedelta(days=7 * w), float(a), "s1", "N1") for i, a in enumerate(amounts)]
    return spark.createDataFrame(data, "txn_id string, txn_ts timestamp_ntz, subtotal double, store_id string, neighborhood string")


def test_kpi_last_week_against_four_before(spark):
    txns = weekly_txns(spark, [[900], [100], [100], [100], [100], [75, 75]])
    a, z = D(2026, 3, 2), D(2026, 4, 12)
    out = cards.kpi_strip(txns, a, z)
    got = {r["metric"]: (r["value"], r["delta_pct"]) for r in out.collect()}
    assert got == {"sales": (150.0, 50.0), "transactions": (2.0, 100.0), "avg_basket": (75.0, -25.0)}
    narrow = cards.kpi_strip(txns, a, D(2026, 3, 8))
    assert {r["delta_pct"] for r in narrow.collect()} == {None}


def test_kpi_spine_counts_missing_weeks_as_zero(spark):
    txns = weekly_txns(spark, [[100], [], [50]])
    a, z = D(2026, 3, 1), D(2026, 3, 25)
    out = cards.kpi_strip(txns, a, z, weeks.week_spine(spark, a, z)).filter("metric = 'sales'")
    assert [r["week_value"] for r in out.orderBy("week").collect()] == [100.0, 0.0, 50.0]


def test_week_roles_take_the_opening_weeks(spark):
    txns = weekly_txns(spark, [[1]] * 7)
    roles = weeks.recent_baseline_weeks(weeks.complete_weeks(txns, D(2026, 3, 2), D(2026, 4, 18)))
    got = sorted(rows(roles))
    assert [w.isoformat() for w, r in got if r == "baseline"] == ["2026-03-02", "2026-03-09", "2026-03-16", "2026-03-23"]
    assert [w.isoformat() for w, r in got if r == "recent"] == ["2026-04-06"]
    assert rows(weeks.recent_baseline_weeks(weeks.complete_weeks(txns, D(2026, 3, 3), D(2026, 3, 7)))) == []


def test_sku_performance_with_and_without_baseline(spark):
    def line(sku, week, n):
        return [(sku, sku, "c", dt.datetime(2026, 3, 2) + dt.timedelta(days=7 * week), 2.0)] * n

    data = line("a", 0, 4) + line("a", 1, 8) + line("b", 0, 6) + line("b", 1, 3) + line("new", 1, 1)
    lines = spark.createDataFrame(data, "sku string, product_name string, category string, txn_ts timestamp_ntz, line_total double")
    roles = weeks.recent_baseline_weeks(weeks.complete_weeks(lines, D(2026, 3, 2), D(2026, 3, 15)))
    got = {r["sku"]: r for r in cards.sku_performance(lines, roles).collect()}
    assert got["a"]["deviation_pct"] == 100.0 and got["a"]["trend_dev_pct"] == 81.8 and got["a"]["house_growth_pct"] == 10.0
    assert got["new"]["deviation_pct"] is None and got["new"]["recent_revenue"] == 2.0
    assert [r[0] for r in rows(cards.promotion_candidates(cards.sku_performance(lines, roles), 15))] == ["b"]


def test_store_without_transactions_and_zero_baseline(spark):
    txns = weekly_txns(spark, [[100], [130]])
    stores = spark.createDataFrame([("s1", "N1"), ("s2", "N2")], "store_id string, neighborhood string")
    assert sorted(rows(cards.stores_summary(stores, txns))) == [("s1", "N1", 2, 230.0), ("s2", "N2", 0, 0.0)]
    roles = weeks.recent_baseline_weeks(weeks.complete_weeks(txns, D(2026, 3, 2), D(2026, 3, 15)))
    out = cards.store_deviation(stores, txns, roles)
    assert rows(out) == [("s1", "N1", 100.0, 130, 30.0, True)]
    assert rows(cards.store_deviation_summary(out.withColumn("store_id", F.lit(1))))[0][:3] == (1, 0, 1)


def test_mix_of_a_zero_parent(spark):
    lines = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "z", 0.0)], "c string, s string, line_total double")
    got = {(r["l0"], r["l1"]): r["pct_of_parent"] for r in cards.department_mix(lines, ["c", "s"]).collect()}
    assert got == {("a", None): 100.0, ("b", None): 0.0, ("a", "x"): 75.0, ("a", "y"): 25.0, ("b", "z"): 0.0}
    assert rows(cards.top3_concentration(cards.department_mix(lines, ["c", "s"]))) == [("a,b", 100.0)]


def test_payment_mix_null_provider_and_untapped(spark):
    data = [("chip", "visa", False, None), ("contactless", "visa", True, "apple"), ("contactless", "mc", True, None), ("chip", "mc", False, "x")]
    got = {(r["dimension"], r["code"]): (r["n"], r["pct"]) for r in
           cards.payment_mix(spark.createDataFrame(data, "entry_mode string, network string, wallet_at_tap boolean, wallet_provider string")).collect()}
    assert got[("wallet", "apple")] == (1, 25.0) and got[("wallet", None)] == (1, 25.0) and ("wallet", "x") not in got
    assert got[("wallet_adoption", "all")] == (2, 50.0) and got[("entry_mode", "chip")] == (2, 50.0)


def test_heatmap_zero_and_suppressed_cells(spark):
    data = [(dt.datetime(2026, 3, 1, 9),)] * 3 + [(dt.datetime(2026, 3, 2, 10),)] * 60 + [(dt.datetime(2026, 3, 7, 10),)] * 50
    cells = cards.hour_dow_heatmap(spark.createDataFrame(data, "txn_ts timestamp_ntz"))
    got = {(r["dow"], r["hour"]): r for r in cards.heatmap_suppressed(cells).collect()}
    assert len(got) == 168 and got[(0, 9)]["n"] is None and got[(1, 10)]["n"] == 60 and got[(3, 3)]["n"] == 0
    peaks = cards.traffic_peaks(cards.heatmap_suppressed(cells)).first()
    assert (peaks["peak_dow"], peaks["peak_hour"], peaks["slow_dow"], peaks["slow_n"]) == ("Mon", 10, "Sat", 50)
    assert (peaks["wd_we_higher"], peaks["wd_we_ratio"], peaks["suppressed_count"]) == ("weekend", 108, 1)


def test_closed_day_and_dayparts(spark):
    data = [(dt.datetime(2026, 3, 2, h),) for h in (5, 6, 10, 11, 14, 15, 17, 18, 21, 22)]
    got = {(r[0], r[1]): r[2] for r in rows(cards.timing_curves(spark.createDataFrame(data, "txn_ts timestamp_ntz"), calendar.daypart(F.hour("txn_ts"))))}
    assert got[("dow", "0")] == 0 and got[("dow", "1")] == 10
    assert [got[("daypart", p)] for p in ("breakfast", "midday", "afternoon", "dinner", "late")] == [2, 2, 2, 2, 2]


# ---- ranks ------------------------------------------------------------------------------------------------------

def test_quantiles_with_a_hot_value(spark):
    values = [5.0] * 400 + [float(i * i % 977) / 3 for i in range(800)]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 2.0), ("one", None)], "g string, v double")
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "v", {"m": 0.5, "p95": 0.95}).collect()}
    s = sorted(values)
    pos = 0.95 * (len(s) - 1)
    assert got["g"]["m"] == pytest.approx(statistics.median(values))
    assert got["g"]["p95"] == pytest.approx(s[int(pos)] + (s[int(pos) + 1] - s[int(pos)]) * (pos - int(pos)))
    assert got["one"]["m"] == 2.0


def test_ntile_when_one_value_holds_most_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 1.0).otherwise(F.col("id") / 10.0).alias("v"), F.xxhash64("id").bitwiseAND(2**40 - 1).alias("t"))
    tiled = ranking.ntile(df, "v", "t", 3)
    assert dict(rows(tiled.groupBy("tile").count())) == {1: 334, 2: 333, 3: 333}
    spark_ntile = df.withColumn("tile", F.ntile(3).over(Window.orderBy("v", "t")))
    assert tiled.exceptAll(spark_ntile).isEmpty()
    assert rows(ranking.ntile(df.limit(0), "v", "t", 3)) == []
    assert sorted(r["tile"] for r in ranking.ntile(df.limit(2), "v", "t", 3).collect()) == [1, 2]


def test_an_outlier_does_not_fill_one_range(spark):
    df = spark.range(20000).select(F.when(F.col("id") == 0, 1e15).otherwise(F.sqrt("id")).alias("v"))
    lo, hi = df.agg(F.min("v"), F.max("v")).first()
    largest = df.groupBy(ranking._bin(F.col("v"), F.lit(lo), F.lit(hi)).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 2000
    want = sorted(r["v"] for r in df.collect())
    got = ranking.exact_quantiles(df, [], "v", {"m": 0.5}, {"d": 0.9}).first()
    assert got["m"] == pytest.approx((want[9999] + want[10000]) / 2) and got["d"] == want[17999]
    signed = spark.range(-500, 501).select((F.col("id") / 7.0).alias("v"))
    assert ranking.exact_quantiles(signed, [], "v", {"m": 0.5}).first()["m"] == 0


def test_top_fraction_ignores_how_ties_fall(spark):
    df = spark.createDataFrame([(5,), (5,), (5,), (1,), (1,), (1,), (1,), (1,), (1,), (1,)], "v bigint")
    assert ranking.top_fraction_sum(df, [], "v", 0.2).select("top_total", "total").first() == (10, 22)
    assert ranking.top_fraction_sum(df.limit(1), [], "v", 0.2).first()["top_total"] == 5


# ---- baskets, customers, quality --------------------------------------------------------------------------------

def test_lift_by_hand(spark):
    data = [(1, "A"), (1, "B"), (2, "A"), (3, "B"), (4, "C"), (4, "C")]
    out = baskets.affinity_support(spark.createDataFrame(data, "txn_id int, subcategory string"), [("A", "B"), ("Z", "B"), ("A", "Z")]).collect()
    assert (out[0]["n_baskets"], out[0]["support_anchor"], out[0]["p_partner"], out[0]["p_cond"], out[0]["lift"]) == (4, 2, 0.5, 0.5, 1.0)
    assert out[1]["lift"] is None and out[2]["lift"] is None


def test_attach_rate_by_hand(spark):
    data = [(t, g) for t in range(10) for g in ("A", "B")] + [(t, "A") for t in range(10, 20)] + [(t, "A") for t in range(10)] + [(99, "A"), (99, "X")]
    out = rows(baskets.attach_rate(spark.createDataFrame(data, "txn_id int, g string"), "g", 15, floor=5))
    assert out == [("B", "A", 10, 10, 1.0), ("A", "B", 10, 21, pytest.approx(10 / 21))]


def test_companion_counts_line_pairs(spark):
    data = [("m", 1, "a"), ("m", 1, "a"), ("m", 1, "b"), ("m", 2, "a"), ("m", 2, "c"), ("m", 3, "c")]
    out = baskets.top_companion(spark.createDataFrame(data, "m string, txn_id int, sku string"), "m", n_anchors=1)
    assert rows(out.select("anchor", "companion", "co", "prob")) == [("a", "b", 2, 0.67)]


def test_pairs_and_fanout(spark):
    txns = spark.createDataFrame([("x", "A"), ("x", "B"), ("x", "C"), ("y", "A"), ("y", "B"), ("y", "A")], "customer_token string, banner_code string")
    people = spark.createDataFrame([("x",), ("y",), ("z",)], "customer_token string")
    assert sorted(rows(customers.merchant_pair_overlap(txns))) == [("A", "B", 2), ("A", "C", 1), ("B", "C", 1)]
    assert sorted(rows(customers.customer_fanout(txns, people))) == [(0, 1), (2, 1), (3, 1)]


def test_orphans_by_hand(spark):
    child = spark.createDataFrame([(1,), (1,), (7,), (7,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(quality.referential_integrity([("fk", child, "k", parent, "k")])) == [("fk", 2, 1)]


def test_rounded_union_keeps_the_first_frame(spark):
    a = spark.createDataFrame([("x", 1.00001), ("n", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.00002), ("y", 2.0), ("n", None)], "k string, v double")
    out = report.union_rounded_dedup([a, b])
    assert sorted(rows(out), key=str) == [("n", None), ("x", 1.00001), ("y", 2.0)]


def test_later_promotion_wins_and_prices_round(spark):
    promos = spark.createDataFrame([("P1", "s", D(2026, 3, 1), D(2026, 3, 4), 0.1), ("P2", "s", D(2026, 3, 3), D(2026, 3, 3), 0.5)],
                                   "promo_id string, sku string, start_date date, end_date date, depth_pct double")
    lines = spark.createDataFrame([(d, "s", 3, dt.datetime(2026, 3, d, 12)) for d in (1, 3, 5)], "txn_id int, sku string, qty int, txn_ts timestamp_ntz")
    products = spark.createDataFrame([("s", 9.99)], "sku string, shelf_price double")
    out = transforms.flat_line_pricing(transforms.promo_lines(lines, promos), products)
    assert sorted(rows(out.select("txn_id", "promo_id", "discount", "unit_price", "line_total"))) == [
        (1, "P1", 1.0, 8.99, 26.97), (3, "P2", 5.0, 4.99, 14.97), (5, None, 0.0, 9.99, 29.97)]


def test_running_promotions_match_brute_force(spark):
    """Nested, overlapping, touching, equal, open-ended and empty intervals, against a look at every interval for every day."""
    rng = random.Random(11)
    day0 = D(2026, 1, 1)
    promos = []
    for i in range(60):
        a = day0 + dt.timedelta(rng.randrange(40))
        z = None if i % 10 == 0 else a + dt.timedelta(rng.choice([-1, 0, 1, 3, 10, 30]))
        promos.append((f"P{i:02d}", rng.choice(["s", "t", "u", None]), None if i == 33 else a, z, i / 100))
    lines = [(i, rng.choice(["s", "t", "v", None]), day0 + dt.timedelta(rng.randrange(-3, 80))) for i in range(400)]
    want = {}
    for i, sku, day in lines:
        live = [(p[2], p[0]) for p in promos if sku is not None and p[1] == sku and p[2] and p[2] <= day and (p[3] is None or p[3] >= day)]
        want[i] = max(live)[1] if live else None
    schedule = spark.createDataFrame(promos, "promo_id string, sku string, start_date date, end_date date, depth_pct double")
    df = spark.createDataFrame([(i, s, dt.datetime.combine(d, dt.time(9))) for i, s, d in lines], "txn_id int, sku string, txn_ts timestamp_ntz")
    assert dict(rows(transforms.promo_lines(df, schedule).select("txn_id", "promo_id"))) == want and len(set(want.values())) > 15
    parts = transforms.promo_segments(schedule)
    held = rows(parts.orderBy("sku", "first").select("sku", "first", "last"))
    assert len(held) <= 2 * len(promos)
    assert all(a[0] != b[0] or (a[2] is not None and a[2] < b[1]) for a, b in zip(held, held[1:]))
    dated = schedule.filter("end_date IS NOT NULL")
    got = {(r["sku"], r["day"]): r["promo_id"] for r in transforms.promo_calendar(dated).collect()}
    each = {}
    for p in promos:
        if p[1] and p[2] and p[3]:
            for n in range((p[3] - p[2]).days + 1):
                k = p[1], p[2] + dt.timedelta(n)
                each[k] = max(each.get(k, (D(1, 1, 1), "")), (p[2], p[0]))
    assert got == {k: v[1] for k, v in each.items()}


def test_long_promotions_make_no_rows_per_day(spark):
    promos = spark.createDataFrame([("P1", "s", D(1900, 1, 1), D(2900, 1, 1), 0.1), ("P2", "s", D(2000, 1, 1), None, 0.2)],
                                   "promo_id string, sku string, start_date date, end_date date, depth_pct double")
    assert rows(transforms.promo_segments(promos).select("first", "last", "promo_id")) == [
        (D(1900, 1, 1), D(1999, 12, 31), "P1"), (D(2000, 1, 1), D(2900, 1, 1), "P2"), (D(2900, 1, 2), None, "P2")]


def test_attach_rate_with_colliding_buckets(spark):
    """Rare pairs that share a bucket with a frequent one are counted exactly and leave."""
    rng = random.Random(12)
    baskets_of = [rng.sample(range(40), rng.randrange(1, 7)) for _ in range(400)]
    lines = [(t, f"i{x}") for t, b in enumerate(baskets_of) for x in b + b[:1]] + [(9999, None), (0, None)]
    df = spark.createDataFrame(lines, "txn_id int, g string")
    both, single = collections.Counter(), collections.Counter()
    for b in baskets_of:
        single.update(b)
        both.update((x, y) for x in b for y in b if x != y)
    want = {(f"i{x}", f"i{y}"): (c, single[x]) for (x, y), c in both.items() if c >= 6}
    for n_buckets in (64, 1 << 20):
        out = rows(baskets.attach_rate(df, "g", 10**6, floor=6, n_buckets=n_buckets))
        assert {(r[0], r[1]): (r[2], r[3]) for r in out} == want and len(want) > 20


def test_unknown_density_fails(spark):
    df = spark.createDataFrame([("High",), ("swamp",)], "d string")
    with pytest.raises(Exception, match="unknown zone density"):
        df.select(transforms.metro_region(F.col("d"))).collect()


def test_window_width(spark):
    df = spark.range(1).select(scope.window_too_narrow(D(2026, 3, 1), D(2026, 3, 14)), scope.window_too_narrow(D(2026, 3, 1), D(2026, 3, 15)))
    assert rows(df) == [(True, False)]


def test_row_filter_and_chart_checks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert scope.row_filter(df, {"k": ["a", "c"], "v": 3}).count() == 1
    with pytest.raises(LookupError):
        scope.row_filter(df, {"zz": 1})
    with pytest.raises(shaping.ChartColumnError):
        shaping.numeric_column_check(df, ["k"], ["k"])
    with pytest.raises(shaping.ChartColumnError):
        shaping.series_by_x(df, "zz", ["v"])


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "g string, peer_relationship string, qty bigint, unit_price double, lake_store_id string")
    assert rows(compare.price_gap(empty, ["g"])) == [] and rows(compare.mix_index(empty, ["g"])) == []
    assert rows(ranking.exact_quantiles(empty, ["g"], "unit_price", {"m": 0.5})) == []
    assert empty.agg(money.mean_money("unit_price"), money.sum_money("unit_price")).first() == (None, None)


# ---- one key with a third of all rows ---------------------------------------------------------------------------

def skewed_lines(spark, n=6000):
    """Ticket 0, customer 0 and product 0 hold a third of the lines each."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(n).select(
        F.when(hot, 0).otherwise(i % 997 + 1).alias("txn_id"), F.when(i % 3 == 1, 0).otherwise(i % 89).alias("sku"),
        F.concat(F.lit("g"), (i % 12).cast("string")).alias("g"), (i % 7 + 1).alias("qty"),
        F.when(hot, 5.25).otherwise((i % 1201) / 4).alias("price"),
    ).repartition(7)


def test_basket_measures_on_a_hot_ticket(spark):
    lines = skewed_lines(spark)
    per = {}
    for r in lines.collect():
        per.setdefault(r["txn_id"], []).append(r)
    groups = {t: {r["g"] for r in rs} for t, rs in per.items()}
    want = {}
    for gs in groups.values():
        for a in gs:
            for b in gs - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    want = {k: v for k, v in want.items() if v >= 40}
    got = {(r[0], r[1]): r[2] for r in rows(baskets.attach_rate(lines, "g", 500, floor=40))}
    assert got == want and want
    units = sorted((sum(r["qty"] for r in rs) for rs in per.values()), reverse=True)
    out = baskets.heavy_tail_share(lines).first()
    assert out["top_total"] == sum(units[: int(len(units) * 0.2)]) and out["total"] == sum(units)


def test_companions_of_a_hot_product(spark):
    lines = skewed_lines(spark, 1500).withColumn("m", F.lit("m"))
    per = {}
    for r in lines.collect():
        per.setdefault(r["txn_id"], []).append(r["sku"])
    co = {}
    for skus in per.values():
        for b in skus:
            if b != 0:
                co[b] = co.get(b, 0) + skus.count(0)
    best = min(co, key=lambda s: (-co[s], s))
    got = baskets.top_companion(lines, "m", n_anchors=1).first()
    assert (got["anchor"], got["companion"], got["co"]) == (0, best, co[best])


def test_quantile_of_a_hot_value_over_all_rows(spark):
    lines = skewed_lines(spark)
    values = sorted(r["price"] for r in lines.collect())
    got = ranking.exact_quantiles(lines, [], "price", {"m": 0.5}, {"d": 0.9}).first()
    assert got["m"] == statistics.median(values) and got["d"] == values[int(0.9 * len(values)) - 1]


# ---- claims -----------------------------------------------------------------------------------------------------

def result_cells(spark):
    data = [("tenant", "r1", {"category": "Dairy", "zone": "Z1"}, "price", 4.0), ("tenant", "r2", {"category": "Dairy", "zone": "Z2"}, "price", 6.0),
            ("lake", "r1", {"category": "Dairy"}, "index", 0.9229), ("lake", "r2", {"category": "Meat"}, "index", 1.1), ("lake", "r3", {"category": "Meat"}, "price", 9.0)]
    return spark.createDataFrame(data, "frame string, row_id string, dims map<string,string>, column string, value double")


LOOKUP = "claim_id int, frame string, row_filter map<string,array<string>>, column string, agg string"


def test_cell_lookup_rules(spark):
    asked = [(1, None, {"category": ["Dairy"], "zone": ["Z1"]}, "price", None), (2, None, {"category": ["Dairy"]}, "price", None),
             (3, None, {"category": ["Dairy"]}, "price", "mean"), (4, None, {"category": ["Dairy"], "zone": ["Z1", "Z2"]}, "price", "sum"),
             (5, "tenant", {"category": ["Meat"]}, "price", None), (6, None, {"category": ["Meat"]}, "price", None), (7, None, {"nope": ["x"]}, "price", None),
             (8, None, {"category": ["Dairy"], "zone": ["Z1", "Z1"]}, "price", None)]
    out = claims.claim_cell_lookup(spark.createDataFrame(asked, LOOKUP), result_cells(spark))
    assert {r["claim_id"]: r["true_value"] for r in out.collect()} == {1: 4.0, 2: None, 3: 5.0, 4: 10.0, 5: None, 6: 9.0, 7: None, 8: 4.0}


def test_cells_and_dimensions_without_a_value(spark):
    cells = spark.createDataFrame(
        [("lake", "a", {"category": "X"}, "price", None), ("lake", "b", {"category": "X"}, "price", 4.0), ("tenant", "c", {"category": None}, "price", 7.0), ("lake", "d", {"category": "Y"}, "price", None)],
        "frame string, row_id string, dims map<string,string>, column string, value double",
    )
    asked = [(1, None, {"category": ["X"]}, "price", "mean"), (2, None, {"category": ["X"]}, "price", "sum"), (3, None, {"category": [None]}, "price", None), (4, None, {"category": ["Y"]}, "price", None)]
    out = claims.claim_cell_lookup(spark.createDataFrame(asked, LOOKUP), cells)
    assert {r["claim_id"]: r["true_value"] for r in out.collect()} == {1: None, 2: None, 3: None, 4: None}


def test_listed_values_do_not_multiply(spark):
    """Three lists of 50 values are 150 entries, and the rarest name alone meets the cells."""
    lists = {n: [f"{n}{i}" for i in range(50)] for n in "abc"}
    asked = spark.createDataFrame([(1, None, lists, "v", "sum"), (2, None, {"a": ["a1"], "b": []}, "v", "sum"), (3, "lake", {}, "v", "sum"), (4, None, None, "v", "sum")], LOOKUP)
    cells = [("lake", f"r{i}", {"a": f"a{i % 60}", "b": f"b{i % 2}", "c": f"c{i % 70}" if i % 5 else None}, "v", float(i)) for i in range(600)]
    cells += [("lake", "twice", {"a": "a1", "b": "b1", "c": "c1"}, "v", 5.0)] * 2
    df = spark.createDataFrame(cells, "frame string, row_id string, dims map<string,string>, column string, value double")
    assert claims.filter_entries(asked, ["claim_id"]).filter("claim_id = 1").count() == 150
    lead = claims.leading_names(asked, claims.cell_profiles(df), ["claim_id"])
    assert rows(lead.filter("claim_id = 1")) == [(1, "c")]
    hit = [c for c in cells if all(c[2][n] in lists[n] for n in "abc")]
    got = dict(rows(claims.claim_cell_lookup(asked, df).select("claim_id", "true_value")))
    assert got == {1: sum(c[4] for c in hit), 2: None, 3: sum(c[4] for c in cells), 4: None} and len(hit) > 100


def test_derivations_and_references(spark):
    def op(cat, frame, column="price", agg="sum"):
        return (frame, {"category": [cat]}, column, agg)

    schema = "claim_id int, op string, agg string, operands array<struct<frame:string,row_filter:map<string,array<string>>,column:string,agg:string>>"
    asked = [(1, "difference", None, [op("Dairy", "tenant"), op("Meat", "lake")]), (2, "ratio", None, [op("Dairy", "tenant"), op("Meat", "lake")]),
             (3, "pct_change", None, [op("Dairy", "tenant"), op("Gone", "lake")]), (4, "aggregate", "mean", [op("Dairy", "tenant"), op("Meat", "lake")]),
             (5, "ratio", None, [op("Dairy", "tenant")])]
    out = claims.claim_derivation(spark.createDataFrame(asked, schema), result_cells(spark))
    assert {r["claim_id"]: r["true_value"] for r in out.collect()} == {1: 1.0, 2: pytest.approx(10 / 9), 3: None, 4: 9.5, 5: None}
    refs = spark.createDataFrame([(1, "category", "Dairy", "index"), (2, "category", "Fish", "index")], "claim_id int, by string, value string, metric string")
    assert sorted(rows(claims.claim_value_ref(refs, result_cells(spark)))) == [(1, 0.9229), (2, None)]


def test_dispositions(spark):
    data = [(1, 2.0, 2.0), (2, 0.92, 0.9229), (3, 0.8, 0.9), (4, 0.0, 0.0), (5, float("nan"), 1.0), (6, 1.0, None)]
    out = claims.claim_disposition(spark.createDataFrame(data, "i int, value double, true_value double"))
    assert [r["status"] for r in out.orderBy("i").collect()] == ["passed", "normalized", "stripped", "passed", "stripped", "stripped"]


def test_direction_words(spark):
    data = [("Sales rose in March", -1.0), ("Sales fell in March", 2.0), ("Sales rose then fell", -1.0), ("Sales were up", 1.0), ("", -1.0)]
    out = claims.direction_contradiction(spark.createDataFrame(data, "t string, v double"), "t", "v")
    assert [r["contradiction"] for r in out.collect()] == [True, True, False, False, False]


def test_narration_and_names(spark):
    texts = [("Let me pull peer data",), ("Milk leads at $4.20.",), ("Would you like me to go on",), ("Shall we?",), ("still going ...",)]
    out = claims.narration_flags(spark.createDataFrame(texts, "t string"), "t")
    assert [r["narration"] for r in out.collect()] == [True, False, True, True, True]
    leak = spark.createDataFrame([("Oakshop beats Blue Diner",), ("Oakshopland",), ("nothing",)], "t string")
    got = claims.name_leak_scan(leak, "t", ["Oakshop", "Blue Diner"], F.lit("Oakshop"))
    assert [r["leaked"] for r in got.collect()] == ["Blue Diner", "", ""]


def brute_mentions(prose, names):
    def word(ch):
        return ch == "_" or ch.isalnum()

    out = []
    for n in names:
        at = prose.find(n)
        while at >= 0:
            if not (at and word(prose[at - 1])) and not (at + len(n) < len(prose) and word(prose[at + len(n)])):
                out.append(n)
                break
            at = prose.find(n, at + 1)
    return ",".join(sorted(out))


def test_name_index_matches_brute_force(spark):
    names = ["Oak", "Oak shop", "Oak shop 9", "Blue-Diner", "#1 Mart", "Ünal", "a_b", "7", "Mart!", "Oak  shop"]
    prose = ["Oak shop 9 beats Blue-Diner", "Oakshop a_b", "a_b_c 77 7", "(#1 Mart) and x#1 Mart", "##1 Mart", "Mart!x Mart! y", "", None, "Ünal.Oak  shop", "Oak shop 99, Oak shop",
             "#1 Mart", "shop Oak", "Blue-Diner's 7th"]
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(prose)], "i int, t string, name int")
    got = claims.name_leak_index(df, "i", "t", spark.createDataFrame([(n,) for n in names], "name string"), F.lit("7"))
    assert {r["i"]: r["leaked"] for r in got.collect()} == {i: brute_mentions(p or "", [n for n in names if n != "7"]) for i, p in enumerate(prose)}
    got = df.filter("t IS NOT NULL").select("i", F.array_join(F.array_sort(text.mentions(F.col("t"), names)), ",").alias("m")).collect()
    assert {r["i"]: r["m"] for r in got} == {i: brute_mentions(p, names) for i, p in enumerate(prose) if p is not None}
    assert claims.name_leak_index(df, "i", "t", spark.createDataFrame([], "name string"), F.lit(None).cast("string")).filter("leaked != ''").count() == 0


def test_names_that_begin_alike_do_not_meet_each_others_texts(spark):
    """A catalogue whose names share their first words: places and names meet by the whole name, however written around it."""
    names = [f"large ring {i}" for i in range(300)] + ["large ring", "(large) ring 7+", "ring 5-"]
    prose = [f"Sent: large ring {i}; large ring {i + 1}, (large) ring 7+ring, x" for i in range(40)] + ["ring 5-", "ring 5-x", "ring 5--x", "(large) ring 7+"]
    df = spark.createDataFrame(list(enumerate(prose)), "i int, t string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    out = claims.name_leak_index(df, "i", "t", known, F.lit(None).cast("string"))
    assert {r["i"]: r["leaked"] for r in out.collect()} == {i: brute_mentions(p, names) for i, p in enumerate(prose)}
    plan = text.name_mentions(df, "i", "t", known)._jdf.queryExecution().executedPlan().toString()
    key = re.search(r"Join(?:ExecTransformer)? \[(\w+)#\d+\]", plan).group(1)
    per_key = text_keys(known, key)
    assert per_key < 3


def text_keys(known, key):
    """The most names that meet a place of a text under one key of the lookup."""
    first = known.select(F.regexp_extract("name", r"([\p{L}\p{N}_]+)", 1).alias("_first"), F.regexp_replace("name", r"^\W+|\W+$", "").alias("_core"))
    return first.groupBy(key).count().agg(F.max("count")).first()[0]


def test_query_log_lints(spark):
    log = spark.createDataFrame([("MID", "select Category, neighborhood from t where DAYOFWEEK(ts) = 1", 0), ("NOR", "select merchant_category from t where dayofweek(ts)=1", 3)],
                                "v string, q string, n int")
    out = claims.query_log_grain(claims.dow_filter_lint(log, "q", "v", {"MID": 0}), "q", "n").collect()
    assert [(r["grain"], r["empty_result"], r["suspect"]) for r in out] == [("category,neighborhood", True, True), ("merchant_category", False, False)]


def brute_numbers(prose):
    """Independent scan: positions from a plain regular expression, words by slicing the text around each hit."""
    number = re.compile(r"(?<![A-Za-z])(?:≈|~|about\s+|roughly\s+)?\$?(?:-?\d{1,3}(?:,\d{3})+|-?\d+(?:\.\d+)?)(?:\s*%|\s*x|\s*×|\s*bps)?", re.I | re.A)
    out = []
    for m in number.finditer(prose):
        tok, before, after = m.group(), prose[: m.start()][-60:], prose[m.end():][:60]
        lw, rw = [w.lower() for w in re.findall(r"\w+", before)][-2:], [w.lower() for w in re.findall(r"\w+", after)][:2]
        if any(c in tok for c in "%$.") or tok.lower().endswith(("x", "×", "bps")) or re.search(r"(?:≈|~|about\s+|roughly\s+)\s*$", before[-12:], re.I):
            kind = "metric"
        elif rw and rw[0] in text.STRUCTURAL_FOLLOWERS or lw and lw[-1] in text.STRUCTURAL_PREFIXES:
            kind = "structural"
        else:
            kind = "metric" if set(lw + rw) & set(text.METRIC_WORDS) else "structural"
        value = re.search(r"-?\d{1,3}(?:,\d{3})+|-?\d+(?:\.\d+)?", tok).group().replace(",", "")
        out.append((tok, float(value), kind))
    return out


SENTENCES = [
    "Across 12 weeks and 5 merchants the price index 5 rose about 7% to $1,234.50, roughly 3 x the 40 bps of Zone 5.", "h264 1 2 3 4",
    "", "no digits", "share 5", "5 percentage points; Q 3; ~9; 1,000,000 rows", "-4.5% and -7 lift 8 stores", "9", "x9y 10×11 12bps13% growth 14",
]


def test_number_scan_matches_brute_force(spark, sf_dir):
    docs = [(i, s) for i, s in enumerate(SENTENCES)]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).cast("int").alias("i"), "text").collect()
    docs += [(r["i"], r["text"]) for r in real]
    df = spark.createDataFrame(docs, "i int, text string")
    got = {}
    for r in claims.numeric_token_scan(df, "i", "text").orderBy("i", "pos").collect():
        got.setdefault(r["i"], []).append((r["token"], r["value"], r["kind"]))
    want = {i: brute_numbers(t) for i, t in docs if brute_numbers(t)}
    assert got == want
