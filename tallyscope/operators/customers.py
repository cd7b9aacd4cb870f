"""Customer measures across merchants: overlap, fan-out, cohorts, loyalty, zones.

A customer's set of merchants is bounded by the panel, so sets are built map-side and equal sets are counted once;
pair and cohort counts come from the distinct sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.money import mean_fixed, ratio, sum_money
from tallyscope.operators.privacy import K_FLOOR

CARD = "customer_token"


def merchant_sets(txns: DataFrame, col: str = "banner_code") -> DataFrame:
    """(merchants, n): sorted sets of merchants and the number of customers with exactly that set."""
    per = txns.groupBy(CARD).agg(F.array_sort(F.collect_set(col)).alias("merchants"))
    return per.groupBy("merchants").agg(F.count(F.lit(1)).alias("n"))


def merchant_pair_overlap(txns: DataFrame, col: str = "banner_code") -> DataFrame:
    """Customers shared by each pair of merchants a < b."""
    sets = merchant_sets(txns, col)
    pairs = sets.select("n", "merchants", F.posexplode("merchants").alias("i", "merchant_a")).select(
        "n", "merchant_a",
        F.explode(F.slice("merchants", F.col("i") + 2, F.greatest(F.size("merchants") - F.col("i") - 1, F.lit(0)))).alias("merchant_b"),
    )
    return pairs.groupBy("merchant_a", "merchant_b").agg(F.sum("n").alias("shared_customers"))


def customer_fanout(txns: DataFrame, customers: DataFrame, col: str = "banner_code") -> DataFrame:
    """Customers active at exactly N merchants; N = 0 comes from customers without transactions."""
    active = merchant_sets(txns, col).groupBy(F.size("merchants").alias("n_merchants")).agg(
        F.sum("n").alias("n_customers")
    )
    idle = customers.select(CARD).join(txns.select(CARD).distinct(), CARD, "left_anti").agg(
        F.count(F.lit(1)).alias("n_customers")
    ).select(F.lit(0).alias("n_merchants"), "n_customers")
    return active.unionByName(idle)


def customer_merchant_sets(txns: DataFrame, col: str = "banner_code") -> DataFrame:
    return merchant_sets(txns, col).select(F.array_join("merchants", ",").alias("merchant_set"), F.col("n").alias("n_customers"))


def cohort_sizes(txns: DataFrame, group: Sequence[str], other: Sequence[str], col: str = "banner_code") -> DataFrame:
    """Customers at all of `group`, at any two of it, at some of both groups, at every merchant."""
    sets = merchant_sets(txns, col)
    inside = F.size(F.array_intersect("merchants", F.array(*[F.lit(x) for x in group])))
    across = F.size(F.array_intersect("merchants", F.array(*[F.lit(x) for x in other])))
    panel = txns.agg(F.count_distinct(col)).scalar()

    def customers(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return sets.agg(
        customers(inside == len(group)).alias("n_at_all"),
        customers(inside >= 2).alias("n_at_any_2"),
        customers((inside > 0) & (across > 0)).alias("n_at_both_groups"),
        customers(F.size("merchants") == panel).alias("n_at_every"),
    )


def cohort_spend(txns: DataFrame, days: int = 30, least: int = 3, col: str = "banner_code") -> DataFrame:
    """Customers at `least` merchants in the trailing days of the panel: their mean spend at each merchant."""
    last = txns.agg(F.max(F.col("txn_ts").cast("date"))).scalar()
    near = txns.filter(F.col("txn_ts").cast("date") >= F.date_sub(last, days - 1))
    spend = near.groupBy(CARD, col).agg(sum_money("subtotal").alias("s"))
    cohort = spend.groupBy(CARD).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least)
    return spend.join(cohort, CARD, "left_semi").groupBy(col).agg(
        F.count(F.lit(1)).alias("n_customers"), (sum_money("s") / F.count(F.lit(1))).alias("avg_spend")
    )


def segment_participation(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of active cards in two or more segments; each segment's active share of all customers."""
    both = F.sum(F.when(F.size("merchants") >= 2, F.col("n")))
    cards = customers.agg(F.count(F.lit(1))).scalar()
    head = merchant_sets(txns, "segment").agg(ratio(both, F.sum("n")).alias("share")).select(
        F.lit("both").alias("segment"), "share"
    )
    each = txns.groupBy("segment").agg(ratio(F.count_distinct(CARD), cards).alias("share"))
    return head.unionByName(each)


def card_banner_share(txns: DataFrame, col: str = "banner_code") -> DataFrame:
    """Each card's visits by banner and their share of the card's visits."""
    counts = txns.groupBy(CARD, col).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(CARD).agg(F.sum("n").alias("t"))
    return counts.join(totals, CARD).select(CARD, col, "n", ratio("n", "t").alias("share"))


def primary_concentration(txns: DataFrame, col: str = "banner_code") -> DataFrame:
    """Mean over cards of the largest banner share of visits."""
    counts = txns.groupBy(CARD, col).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(CARD).agg(ratio(F.max("n"), F.sum("n")).alias("share"))
    return per.agg(F.count(F.lit(1)).alias("cards"), mean_fixed("share").alias("concentration"))


def top_sku_repeat(txns: DataFrame, items: DataFrame, cards: DataFrame, least: int = 5) -> DataFrame:
    """Over the given cards with at least `least` trips: mean of the largest share of trips holding one product."""
    mine = txns.join(cards.select(CARD), CARD, "left_semi").select(CARD, "txn_id")
    trips = mine.groupBy(CARD).agg(F.count_distinct("txn_id").alias("trips")).filter(F.col("trips") >= least)
    held = items.select("txn_id", "sku").join(mine, "txn_id").groupBy(CARD, "sku").agg(
        F.count_distinct("txn_id").alias("in_trips")
    )
    best = held.groupBy(CARD).agg(F.max("in_trips").alias("most"))
    per = best.join(trips, CARD).select(ratio("most", "trips").alias("share"))
    return per.agg(F.count(F.lit(1)).alias("cards"), mean_fixed("share").alias("top_sku_share"))


def repeat_customer_ratio(txns: DataFrame, col: str = "banner_code", days: int = 2) -> DataFrame:
    """Per merchant: customers, and those seen on at least two distinct days."""
    per = txns.groupBy(col, CARD).agg(F.count_distinct(F.col("txn_ts").cast("date")).alias("d"))
    n = F.count(F.lit(1))
    return per.groupBy(col).agg(
        n.alias("total_customers"), F.count_if(F.col("d") >= days).alias("repeat_customers"),
        (F.count_if(F.col("d") >= days) * 100 / n).alias("repeat_pct"),
    )


def loyalty_primary_share(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of trips at the customer's primary banner, by loyalty type."""
    joined = txns.join(customers.select(CARD, "loyalty_type", "primary_banner"), CARD)
    at = F.count_if(F.col("banner_code") == F.col("primary_banner"))
    return joined.groupBy("loyalty_type").agg(
        F.count(F.lit(1)).alias("trips"), ratio(at, F.count(F.lit(1))).alias("share_at_primary")
    )


def zone_banner_mix(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """Banner share of each home zone's trips."""
    counts = txns.join(customers.select(CARD, "home_zone"), CARD).groupBy("home_zone", "banner_code").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy("home_zone").agg(F.sum("n").alias("t"))
    return counts.join(totals, "home_zone").select("home_zone", "banner_code", "n", ratio("n", "t").alias("share"))


def zone_footprint(txns: DataFrame, customers: DataFrame, zones: DataFrame) -> DataFrame:
    per = txns.join(customers.select(CARD, "home_zone"), CARD).groupBy("home_zone").agg(
        F.count(F.lit(1)).alias("txns"), sum_money("subtotal").alias("dollars")
    )
    z = zones.select(F.col("zone_id").alias("home_zone"), "residential_weight", "affluence")
    return per.join(z, "home_zone", "left").orderBy(F.desc("residential_weight"), "home_zone")


def both_segment_cards(txns: DataFrame) -> DataFrame:
    return txns.groupBy(CARD).agg(F.count_distinct("segment").alias("s")).filter(F.col("s") >= 2).select(CARD)


def cross_segment_cells(txns: DataFrame, customers: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Cards active in two or more segments, by home zone, and whether the cell survives k."""
    return customers.join(both_segment_cards(txns), CARD, "left_semi").groupBy("home_zone").agg(
        F.count(F.lit(1)).alias("cards")
    ).withColumn("survives_k", F.col("cards") >= k)


def zone_table(zones: DataFrame, customers: DataFrame, txns: DataFrame, stores: DataFrame, banners: Sequence[str]) -> DataFrame:
    """Per zone: cards, both-segment cards, stores by banner and in total; 0 where there are none."""
    zone = F.col("home_zone").alias("zone_id")
    cards = customers.groupBy(zone).agg(F.count(F.lit(1)).alias("customers"))
    both = customers.join(both_segment_cards(txns), CARD, "left_semi").groupBy(zone).agg(F.count(F.lit(1)).alias("both"))
    st = stores.groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("store_count"),
        *[F.count_if(F.col("banner_code") == b).alias(f"stores_{b}") for b in banners],
    )
    out = zones.select("zone_id").join(cards, "zone_id", "left").join(both, "zone_id", "left").join(st, "zone_id", "left")
    return out.na.fill(0)


def customer_cross_tab(customers: DataFrame, rows: str, columns: str, values: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Counts of one attribute against the listed values of another, one column per value."""
    names = list(values)
    return customers.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(v) for v in names], F.count(F.lit(1)).alias("total")
    )


def zone_distribution(customers: DataFrame, stores: DataFrame) -> DataFrame:
    """Customers by neighborhood through the distinct zone-to-neighborhood mapping of the stores."""
    mapping = stores.select(F.col("zone_id").alias("home_zone"), "neighborhood").distinct()
    per_zone = customers.groupBy("home_zone").agg(F.count(F.lit(1)).alias("n"))
    return per_zone.join(mapping, "home_zone").groupBy("neighborhood").agg(F.sum("n").alias("n_customers"))
