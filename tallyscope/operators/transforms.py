"""Deterministic table transforms: calendars, promotions, anomalies, gravity, pricing and assortment rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.calendar import dow_monday0
from tallyscope.functions.hashing import uniform
from tallyscope.functions.intervals import days_of, running, segments
from tallyscope.functions.money import ratio, round_cents

# Pull of distance, and what a logistic tender model uses.
DISTANCE_OFFSET = 0.5
CREDIT_BASE, CREDIT_SLOPE = 0.05, 2.5
WALLET_BOOST = 0.15
# Zone density to region.
REGION_OF = {
    "urban_core": ["high"],
    "inner_suburbs": ["medium", "med-high"],
    "outer_suburbs": ["low", "low-med"],
}
KVI_DAMPEN, SPECIALTY_AMPLIFY = 0.35, 1.5


def _days(start: str | Column, end: str | Column) -> Column:
    return F.explode(F.sequence(start, end, F.expr("interval 1 day")))


def promo_segments(promotions: DataFrame, order: Sequence[str] = ("start_date", "promo_id")) -> DataFrame:
    """(sku, first, last, promo_id, depth_pct): where promotions overlap the later one (by `order`) runs; a NULL end is open."""
    return segments(promotions, ["sku"], ["promo_id", "depth_pct"], order)


def promo_calendar(promotions: DataFrame, order: Sequence[str] = ("start_date", "promo_id")) -> DataFrame:
    """One row per day and product under promotion; where promotions overlap the later one (by `order`) wins."""
    return days_of(promo_segments(promotions, order)).select("day", "sku", "promo_id", "depth_pct")


def promo_lines(lines: DataFrame, promotions: DataFrame, ts: str = "txn_ts") -> DataFrame:
    """Lines with the promotion running for their product on their day, if any; no interval is spread over its days."""
    base = lines.drop("promo_id", "depth_pct").withColumn("day", F.col(ts).cast("date"))
    live = running(base, promo_segments(promotions), ["sku"], ["promo_id", "depth_pct"])
    return base.join(live, ["day", "sku"], "left")


def flat_line_pricing(lines: DataFrame, products: DataFrame) -> DataFrame:
    """discount = shelf x depth, unit = shelf - discount, total = unit x qty, each rounded to cents."""
    priced = lines.drop("shelf_price", "discount", "unit_price", "line_total").join(
        products.select("sku", "shelf_price"), "sku", "left"
    )
    depth = F.coalesce(F.col("depth_pct"), F.lit(0.0))
    return (
        priced.withColumn("discount", round_cents(F.col("shelf_price") * depth))
        .withColumn("unit_price", round_cents(F.col("shelf_price") - F.col("discount")))
        .withColumn("line_total", round_cents(F.col("unit_price") * F.col("qty")))
    )


def anomaly_affected_txns(txns: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Transactions inside a scheduled decline (zone, banner, days), with the strongest magnitude."""
    keys = ["zone_id", "banner_code"]
    declines = segments(anomalies.filter(F.col("anomaly_type") == "demand_decline"), keys, ["magnitude"], ["magnitude"])
    dated = txns.withColumn("day", F.col("txn_ts").cast("date"))
    return dated.join(running(dated, declines, keys, ["magnitude"]), [*keys, "day"])


def anomaly_calendar(anomalies: DataFrame) -> DataFrame:
    """Spikes per (day, store, category) and share shifts per (day, banner); the later schedule row wins."""
    of_kind = anomalies.withColumns({
        "target": F.when(F.col("anomaly_type") == "category_spike", F.col("store_id").cast("string")).when(F.col("anomaly_type") == "share_shift", F.col("banner_code")),
        # A share shift is of the whole banner: its category does not count.
        "_category": F.when(F.col("anomaly_type") == "category_spike", F.coalesce("category", F.lit(""))).otherwise(F.lit("")),
        "_none": (F.col("anomaly_type") == "share_shift") | F.col("category").isNull(), "multiplier": F.col("magnitude"), "kind": F.col("anomaly_type"),
    }).filter(F.col("kind").isin("category_spike", "share_shift"))
    days = days_of(segments(of_kind, ["kind", "target", "_category", "_none"], ["multiplier"], ["start_date", "anomaly_id"]))
    return days.select("kind", "day", "target", F.when(~F.col("_none"), F.col("_category")).alias("category"), "multiplier")


def day_weights(
    txns: DataFrame, dow_weights: Sequence[float], gain: float = 1.0, early_mult: float = 1.0, mid_mult: float = 1.0,
    early: tuple[int, int] = (1, 10), mid: tuple[int, int] = (15, 17), drift_pct: float = 0.0,
    events: Sequence[tuple[dt.date, dt.date, float]] = (), closed_dow: int | None = None,
) -> DataFrame:
    """Every day of the panel: weekday x pay cycle x linear drift x event weight, with the transactions seen."""
    d = F.col("txn_ts").cast("date")
    daily = txns.groupBy(d.alias("day")).agg(F.count(F.lit(1)).alias("n_txns"))
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    cal = span.select("a", "z", _days("a", "z").alias("day"))
    dom, dow = F.dayofmonth("day"), dow_monday0(F.col("day"))
    pay = F.when(dom.between(*early), 1 + (early_mult - 1) * gain).when(
        dom.between(*mid), 1 + (mid_mult - 1) * gain).otherwise(1.0)
    steps = F.greatest(F.lit(1), F.datediff("z", "a"))
    season = 1 + drift_pct / 100 * (F.datediff("day", "a") / steps)
    for a, z, mult in events:
        season = season * F.when(F.col("day").between(F.lit(a), F.lit(z)), mult).otherwise(1.0)
    weight = F.get(F.array(*[F.lit(float(w)) for w in dow_weights]), dow) * pay * season
    if closed_dow is not None:
        weight = F.when(dow == closed_dow, 0.0).otherwise(weight)
    return cal.select("day", weight.alias("weight")).join(daily, "day", "left").na.fill(0, ["n_txns"])


def gravity_weights(zones: DataFrame, stores: DataFrame, attraction: Column, beta: float, d0: float = DISTANCE_OFFSET) -> DataFrame:
    """Every zone and store: distance in degrees and pull A / (d + d0)^beta.

    The pairing is the result itself; the zone list (a panel dimension) is exploded next to each store.
    """
    listed = zones.agg(F.sort_array(F.collect_list(F.struct("zone_id", "centroid_lat", "centroid_long")))).scalar()
    pairs = stores.drop("zone_id").withColumn("_z", F.explode(listed)).select("*", "_z.*")
    dx, dy = F.col("centroid_lat") - F.col("latitude"), F.col("centroid_long") - F.col("longitude")
    return pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy)).select(
        "zone_id", "store_id", "banner_code", "distance",
        (attraction / F.pow(F.col("distance") + d0, F.lit(beta))).alias("weight"),
    )


def store_share_within_banner(weights: DataFrame) -> DataFrame:
    """A store's pull as a share of its banner's pull in the zone."""
    total = weights.groupBy("zone_id", "banner_code").agg(F.sum("weight").alias("t"))
    return weights.join(total, ["zone_id", "banner_code"]).select(
        "zone_id", "banner_code", "store_id", ratio("weight", "t").alias("share")
    )


def banner_choice_probability(weights: DataFrame, primary: DataFrame, loyal: Mapping[str, Sequence[float]]) -> DataFrame:
    """P(banner) per zone and loyalty type: loyalty weight x gravity pull, normalised within the zone.

    `primary` is (zone_id, loyalty_type, banner_code): the primary banner takes the first loyalty weight, every
    other banner the second.
    """
    pull = weights.groupBy("zone_id", "banner_code").agg(F.sum("weight").alias("pull"))
    first, other = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, w in loyal.items():
        first = F.when(F.col("loyalty_type") == kind, float(w[0])).otherwise(first)
        other = F.when(F.col("loyalty_type") == kind, float(w[1])).otherwise(other)
    p = primary.select("zone_id", "loyalty_type", F.col("banner_code").alias("primary_banner"))
    raw = pull.join(p, "zone_id").withColumn(
        "raw", F.when(F.col("banner_code") == F.col("primary_banner"), first).otherwise(other) * F.col("pull")
    )
    total = raw.groupBy("zone_id", "loyalty_type").agg(F.sum("raw").alias("t"))
    return raw.join(total, ["zone_id", "loyalty_type"]).select(
        "zone_id", "loyalty_type", "banner_code", ratio("raw", "t").alias("probability")
    )


def metro_region(density: Column) -> Column:
    """Region of a density word; an unknown word fails the job."""
    out = None
    for region, words in REGION_OF.items():
        hit = F.lower(density).isin(words)
        out = F.when(hit, region) if out is None else out.when(hit, region)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown zone density "), density)))


def wallet_provider_rule(entry_mode: Column, enrolled: Column, tapped: Column, provider: Column) -> Column:
    """A provider is recorded only for a contactless tap by an enrolled card."""
    return F.when((entry_mode == "contactless") & enrolled & tapped, provider)


def entry_mode_distribution(base: DataFrame, contactless: str = "contactless", chip: str = "chip",
                            boost: float = WALLET_BOOST) -> DataFrame:
    """(group, entry_mode, share) for wallet holders: up to `boost` moves from chip to contactless."""
    mode = F.col("entry_mode")
    chips = base.filter(mode == chip).select("group", F.least(F.col("share"), F.lit(boost)).alias("shift"))
    shift = F.coalesce("shift", F.lit(0.0))
    moved = F.when(mode == contactless, F.col("share") + shift).when(mode == chip, F.col("share") - shift)
    return base.join(chips, "group", "left").select("group", "entry_mode", moved.otherwise(F.col("share")).alias("share"))


def shelf_price(anchor: Column, spread: Column, dept_mult: Column, kvi: Column, specialty: Column, private_label: Column,
                pl_factor: Column, banner: Column, product: Column) -> Column:
    """Anchor x spread x damped or amplified department position x +/-5 % hash index x private-label factor."""
    delta = (dept_mult - 1) * F.when(kvi, KVI_DAMPEN).when(specialty, SPECIALTY_AMPLIFY).otherwise(1.0)
    index = 1.0 + (uniform(F.concat_ws("|", F.lit("comp"), banner, product)) - 0.5) * 0.10
    return round_cents(anchor * spread * (1.0 + delta) * index * F.when(private_label, pl_factor).otherwise(1.0))


def hash_assortment(products: DataFrame, role: str, product: str, carriage: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """A banner carries a product when its hash uniform is below the carriage of the product's role."""
    banners = sorted({b for row in carriage.values() for b in row})
    out = products.withColumn("banner_code", F.explode(F.array(*[F.lit(b) for b in banners])))
    limit = F.lit(0.0)
    for r, row in carriage.items():
        for b, x in row.items():
            limit = F.when((F.col(role) == r) & (F.col("banner_code") == b), float(x)).otherwise(limit)
    draw = uniform(F.concat_ws("|", F.lit("carry"), F.col("banner_code"), F.col(product).cast("string")))
    return out.filter(draw < limit)


def affinity_pair_validity(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Names used by affinity pairs that no product carries."""
    named = pairs.select(F.explode(F.array("anchor", "partner")).alias("subcategory")).distinct()
    return named.join(products.select("subcategory").distinct(), "subcategory", "left_anti")


def panel_invariants(merchants: DataFrame, stores: DataFrame, zones: DataFrame, segments: DataFrame,
                     expected_stores: int | None = None) -> DataFrame:
    """One row per rule with its violations; `merchants` carries segment, store_count and attractiveness."""
    n = F.count(F.lit(1))

    def rule(name: str, df: DataFrame, value: Column = n) -> DataFrame:
        return df.agg(value.cast("bigint").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    placed = stores.groupBy("merchant_id").agg(n.alias("placed"))
    wrong = merchants.join(placed, "merchant_id", "left").filter(F.col("store_count") != F.coalesce("placed", F.lit(0)))
    total = F.sum("store_count")
    parts = [
        rule("weights_sum_to_one", zones, (F.abs(F.sum("residential_weight") - 1) > 1e-9).cast("int")),
        rule("unknown_segment", merchants.join(segments, "segment", "left_anti")),
        rule("unknown_zone", stores.join(zones.select("zone_id"), "zone_id", "left_anti")),
        rule("store_count_differs", wrong),
        rule("attractiveness_not_positive", merchants.filter(~(F.coalesce("attractiveness", F.lit(0.0)) > 0))),
    ]
    if expected_stores is not None:
        parts.append(rule("store_total_differs", merchants, (total != expected_stores).cast("int")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def credit_propensity(affluence: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(CREDIT_BASE + CREDIT_SLOPE * (affluence - 1.0))))


def department_tilt(rows: DataFrame, base: Mapping[str, float], tilt: Mapping[str, float],
                    events: Sequence[tuple[dt.date, dt.date, float, Sequence[str]]] = (),
                    banner_boost: Mapping[tuple[str, str], float] | None = None) -> DataFrame:
    """Weight of each department for each row (affluence, day, banner): base x event x exp(k(affluence-1)) x banner."""
    table = F.array(*[
        F.struct(F.lit(g).alias("department"), F.lit(float(w)).alias("base"), F.lit(float(tilt.get(g, 0.0))).alias("k"))
        for g, w in base.items()
    ])
    out = rows.select("*", F.inline(table))
    weight = F.col("base") * F.exp(F.col("k") * (F.col("affluence") - 1.0))
    for a, z, mult, deps in events:
        hit = F.col("day").between(F.lit(a), F.lit(z)) & F.col("department").isin(*deps)
        weight = weight * F.when(hit, mult).otherwise(1.0)
    for (banner, dep), mult in (banner_boost or {}).items():
        hit = (F.col("banner_code") == banner) & (F.col("department") == dep)
        weight = weight * F.when(hit, mult).otherwise(1.0)
    return out.withColumn("weight", weight).drop("base", "k")
