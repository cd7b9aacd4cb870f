"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs whole (noop sink, all columns) and is timed end to end, planning included, as the best of
$BENCH_RUNS runs after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # Build the viewer-labelled lake, aggregate over peers, peer x date.
    "enriched_lines", "tokenize_ids", "viewer_lake", "k_anonymous_aggregate", "price_gap", "mix_index",
    "weekly_own_vs_peer", "neighborhood_share", "top_movers", "peer_reconciliation",
    # Sixteen own-data cards.
    "kpi_strip", "stores_summary", "sku_performance", "store_deviation", "store_deviation_summary", "department_mix",
    "top3_concentration", "payment_mix", "hour_dow_heatmap", "heatmap_suppressed", "traffic_peaks",
    "promotion_candidates", "top_performers", "worst_stores_first", "timing_curves", "velocity",
    # Baskets, customers, quality, claims.
    "attach_rate", "affinity_lift", "top_companion", "basket_shape", "heavy_tail_share", "merchant_pair_overlap",
    "primary_concentration", "referential_integrity", "average_ticket", "claim_cell_lookup", "numeric_token_scan",
]


def published_lake(spark, sf_dir: str, runs: int) -> dict[str, float]:
    """Write the lake to the shared folder, then the category aggregate and peer x date over the published files."""
    from pyspark.sql import functions as F

    from tallyscope.functions.money import mean_money, sum_money
    from tallyscope.operators import compare, lake
    from tallyscope.sources import census, readers, sinks

    times = {}
    root = sinks.shared_folder(spark, "bench-lake")
    t0 = time.perf_counter()
    lake.build_lake(
        root, census.items(spark, sf_dir), census.products(spark, sf_dir), census.orders(spark, sf_dir),
        census.stores(spark, sf_dir), census.merchants(spark, sf_dir),
    )
    times["build_lake_all_viewers"] = time.perf_counter() - t0
    readers.register_lake_views(spark, root, "NATION_3")

    def best(make) -> float:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        return min(took)

    def published():
        return spark.table("lake_segment_transactions")

    metrics = {"units": F.sum("qty"), "asp": mean_money("unit_price"), "sales": sum_money("line_total")}
    times["published_category_aggregate"] = best(lambda: compare.peer_aggregate(published(), ["category"], metrics))
    times["published_peer_by_date"] = best(lambda: compare.weekly_own_vs_peer(published(), "txn_date", grain="day"))
    return {k: round(v, 3) for k, v in times.items()}


def main() -> None:
    from tallyscope.plans import PLANS
    from tallyscope.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    def run(name: str) -> float:
        t0 = time.perf_counter()
        PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("velocity")
    times = {}
    for name in names:
        times[name] = round(min(run(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    if not os.environ.get("BENCH_QUERIES"):
        times.update(published_lake(spark, sf_dir, runs))
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
