"""Data-quality battery: banded measures, referential checks, catalogue rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.calendar import dow_monday0, in_hours
from tallyscope.functions.hashing import hash48
from tallyscope.functions.joins import BROADCAST_LIMIT, source_bytes
from tallyscope.functions.money import mean_fixed, mean_int, mean_money, ratio, share_of, sum_money, to_cents
from tallyscope.functions.ranking import exact_quantiles, ntile, top_n

PANEL_DAYS = 90
DAYS_A_YEAR = 365


def n_rows() -> Column:
    return F.count(F.lit(1))


def banded(measures: DataFrame, bands: DataFrame) -> DataFrame:
    """Measures against their bands: PASS inside [lo, hi], WATCH outside; measures without a band drop out."""
    return measures.join(bands, "metric").withColumn(
        "status", F.when(F.col("value").between(F.col("lo"), F.col("hi")), "PASS").otherwise("WATCH")
    )


def band_rows(measures: DataFrame, metric: Column, value: Column) -> DataFrame:
    return measures.select(metric.alias("metric"), value.cast("double").alias("value"))


def volume_by_segment(txns: DataFrame, expected: Mapping[str, float], lo: float = 0.7, hi: float = 1.2) -> DataFrame:
    """Transactions in total and per segment against expectation times [lo, hi]."""
    grouped = txns.rollup("segment").agg(F.grouping("segment").alias("g"), n_rows().alias("n"))
    name = F.when(F.col("g") == 1, "total").otherwise(F.col("segment"))
    want = F.lit(None).cast("double")
    for k, v in expected.items():
        want = F.when(name == k, float(v)).otherwise(want)
    return grouped.select(name.alias("segment"), "n", want.alias("expected")).withColumn(
        "in_band", F.col("n").between(F.col("expected") * lo, F.col("expected") * hi)
    )


def average_ticket(txns: DataFrame, by: Sequence[str]) -> DataFrame:
    return txns.groupBy(*by).agg(n_rows().alias("n_txns"), mean_money("subtotal").alias("aov"))


def store_auv(txns: DataFrame, scale: float = 1.0, days: int = PANEL_DAYS, by: str = "banner_code") -> DataFrame:
    """Mean sales per store, annualised and scaled to the full panel."""
    per = txns.groupBy(by, "store_id").agg(sum_money("subtotal").alias("s"))
    return per.groupBy(by).agg((sum_money("s") / n_rows() * (DAYS_A_YEAR / days) / scale).alias("auv"))


def banner_dollar_split(txns: DataFrame) -> DataFrame:
    """Banner's share of its segment's dollars, and its dollars over those of the segment's other banners."""
    per = txns.groupBy("segment", "banner_code").agg(sum_money("subtotal").alias("dollars"))
    seg = per.groupBy("segment").agg(sum_money("dollars").alias("t"))
    return per.join(seg, "segment").select(
        "segment", "banner_code", "dollars", ratio("dollars", "t").alias("share"),
        ratio(F.col("dollars"), F.rint((F.col("t") - F.col("dollars")) * 100) / 100).alias("ratio_to_others"),
    )


def weekend_ratio(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    d = dow_monday0(F.col("txn_ts"))
    we, wd = F.count_if(d >= 5), F.count_if(d <= 4)
    return txns.groupBy(*by).agg((ratio(we, F.lit(2)) / (wd.cast("double") / 5)).alias("weekend_weekday_ratio"))


def daypart_share(txns: DataFrame, bands: Mapping[str, tuple[int, int]], closed_dow: int = 6) -> DataFrame:
    """Per banner: share of transactions in each hour band (bands may wrap over midnight), and closed-day count."""
    ts = F.col("txn_ts")
    return txns.groupBy("banner_code").agg(
        *[share_of(in_hours(ts, a, b)).alias(name) for name, (a, b) in bands.items()],
        F.count_if(dow_monday0(ts) == closed_dow).alias("closed_day_txns"),
    )


def pay_cycle_lift(txns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Transactions per day of month in days 1-10, 15-17 and 20-28, and the first two over the third."""
    d = F.dayofmonth("txn_ts")
    per = txns.groupBy(*by).agg(
        (F.count_if(d <= 10) / 10).alias("early"), (F.count_if(d.between(15, 17)) / 3).alias("mid"),
        (F.count_if(d.between(20, 28)) / 9).alias("flat"),
    )
    return per.withColumns({"early_lift": ratio("early", "flat"), "mid_lift": ratio("mid", "flat")})


def private_label_share(lines: DataFrame, by: str = "banner_code") -> DataFrame:
    pl = F.sum(F.when(F.col("private_label"), F.col("qty")).otherwise(0))
    return lines.groupBy(by).agg(ratio(pl, F.sum("qty")).alias("pl_unit_share"))


def department_share(lines: DataFrame, composite: Sequence[str] = (), name: str = "composite") -> DataFrame:
    """Department share of dollars, and one composite of several departments."""
    per = lines.groupBy("department").agg(sum_money("line_total").alias("dollars"))
    t = per.agg(sum_money("dollars")).scalar()
    rows = per.select("department", "dollars", ratio(F.col("dollars"), t).alias("share"))
    if not composite:
        return rows
    joint = per.filter(F.col("department").isin(*composite)).agg(sum_money("dollars").alias("dollars"))
    return rows.unionByName(joint.select(F.lit(name).alias("department"), "dollars", ratio(F.col("dollars"), t).alias("share")))


def tier_cuts(rows: DataFrame, value: str = "affluence", low: float = 0.33, high: float = 0.66, weight: str | None = None) -> Column:
    """Both quantiles as one scalar struct."""
    cuts = exact_quantiles(rows, [], value, {"low": low, "high": high}, weight=weight)
    return cuts.select(F.struct("low", "high")).scalar()


def tier(value: Column, cuts: Column) -> Column:
    return F.when(value < cuts["low"], "low").when(value > cuts["high"], "high").otherwise("mid")


def fresh_by_affluence(lines: DataFrame, fresh: Sequence[str]) -> DataFrame:
    """Fresh share of dollars in the low, mid and high affluence tiers; cuts are quantiles over LINES.

    Lines are summed per affluence value and department first: the cuts and the shares need nothing finer.
    """
    hit = F.col("department").isin(*fresh)
    cents = to_cents("line_total")
    summed = lines.groupBy("affluence").agg(
        n_rows().alias("n"), F.sum(F.when(hit, cents)).alias("fresh"), F.sum(cents).alias("whole"))
    t = tier(F.col("affluence"), tier_cuts(summed, weight="n"))
    return summed.groupBy(t.alias("tier")).agg(
        F.sum("n").alias("n_lines"), ratio(F.sum("fresh") / 100, F.sum("whole") / 100).alias("fresh_share")
    )


def affluence_ntile(lines: DataFrame, fresh: Sequence[str], identity: Sequence[str], n: int = 3) -> DataFrame:
    """As above with equal-sized tiles: NTILE(n) over lines by affluence, ties in the order of a row hash."""
    keyed = lines.withColumn("_tie", hash48(F.concat_ws("|", *[F.col(c).cast("string") for c in identity])))
    hit = F.col("department").isin(*fresh)
    return ntile(keyed, "affluence", "_tie", n).groupBy("tile").agg(
        n_rows().alias("n_lines"), ratio(sum_money("line_total", hit), sum_money("line_total")).alias("fresh_share")
    )


def tier_profile(txns: DataFrame, lines: DataFrame, fresh: Sequence[str], credit: str, contactless: str) -> DataFrame:
    """By affluence tier (quantiles over transactions): basket, items, private-label and fresh share, payment shares."""
    cuts = tier_cuts(txns)
    t = tier(F.col("affluence"), cuts).alias("tier")
    a = txns.groupBy(t).agg(
        mean_money("subtotal").alias("basket"), mean_int("n_lines").alias("items"),
        share_of(F.col("tender") == credit).alias("credit"),
        share_of(F.col("entry_mode") == contactless).alias("contactless"),
    )
    hit = F.col("department").isin(*fresh)
    b = lines.groupBy(t).agg(
        ratio(F.sum(F.when(F.col("private_label"), F.col("qty")).otherwise(0)), F.sum("qty")).alias("pl_share"),
        ratio(sum_money("line_total", hit), sum_money("line_total")).alias("fresh_share"),
    )
    return a.join(b, "tier")


def payment_rates(txns: DataFrame, contactless: str, debit: str, by: Sequence[str] = ("banner_code",)) -> DataFrame:
    return txns.groupBy(*by).agg(
        share_of(F.col("entry_mode") == contactless).alias("contactless"),
        share_of(F.col("wallet_at_tap")).alias("wallet_tap"), share_of(F.col("tender") == debit).alias("debit"),
    )


def price_equality_check(lines: DataFrame) -> DataFrame:
    """Lines whose unit price differs from the shelf price in cents."""
    a, b = F.rint(F.col("unit_price") * 100), F.rint(F.col("shelf_price") * 100)
    return lines.filter(F.col("shelf_price").isNotNull()).agg(
        n_rows().alias("n_lines"), F.count_if(a != b).alias("n_mismatch")
    )


def cheapest_banner_share(products: DataFrame, by: str = "subcategory", banner: str = "banner_code") -> DataFrame:
    """Banner with the lowest median shelf price per group sold by two or more banners; share of wins."""
    med = exact_quantiles(products, [by, banner], "shelf_price", {"mp": 0.5})
    shared = med.groupBy(by).agg(n_rows().alias("b")).filter(F.col("b") >= 2).select(by)
    won = top_n(med.join(shared, by, "left_semi"), [by], [F.col("mp"), F.col(banner)], 1)
    wins = won.groupBy(banner).agg(n_rows().alias("wins"))
    return wins.withColumn("share_pct", ratio(F.col("wins"), wins.agg(F.sum("wins")).scalar()) * 100)


def pl_price_gap(products: DataFrame, by: Sequence[str] = ("banner_code", "subcategory")) -> DataFrame:
    """Mean over groups that hold both kinds of 1 - private-label mean price / national mean price."""
    pl = F.col("private_label")
    per = products.groupBy(*by).agg(
        mean_money("shelf_price", ~pl).alias("nb"), mean_money("shelf_price", pl).alias("pl")
    ).filter(F.col("nb").isNotNull() & F.col("pl").isNotNull())
    return per.agg(n_rows().alias("n_groups"), mean_fixed(1 - ratio("pl", "nb")).alias("gap"))


def dormant_table_check(items: DataFrame, promotions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """What must be absent while promotions and anomalies are switched off: one row per rule with its count."""
    a = items.agg(
        F.count("promo_id").alias("p"), F.count_if(F.col("discount") != 0).alias("d")
    ).select(F.inline(F.array(
        F.struct(F.lit("lines_with_promo").alias("rule"), F.col("p").alias("violations")),
        F.struct(F.lit("lines_with_discount").alias("rule"), F.col("d").alias("violations")),
    )))
    b = promotions.agg(n_rows().alias("violations")).select(F.lit("promotions").alias("rule"), "violations")
    c = anomalies.agg(n_rows().alias("violations")).select(F.lit("anomalies").alias("rule"), "violations")
    return a.unionByName(b).unionByName(c)


def _member_words(parent: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): the whole-number keys of a parent as bits, 64 neighbouring keys to a row."""
    k = F.col(key).cast("bigint")
    bit = F.expr(f"shiftleft(1L, CAST(CAST(`{key}` AS BIGINT) & 63 AS INT))")
    return parent.filter(k.isNotNull()).groupBy(F.shiftright(k, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _orphans(child: DataFrame, ck: str, parent: DataFrame, pk: str) -> DataFrame:
    """(_key, n) of the child keys that the parent lacks."""
    held = child.filter(F.col(ck).isNotNull()).select(F.col(ck).alias("_key"))
    whole = {t.typeName() for t in (child.schema[ck].dataType, parent.schema[pk].dataType)} <= {"byte", "short", "integer", "long"}
    if not whole:
        return held.groupBy("_key").agg(n_rows().alias("n")).join(parent.select(F.col(pk).alias("_key")), "_key", "left_anti")
    words = _member_words(parent, pk)
    met = held.withColumn("_word", F.shiftright(F.col("_key").cast("bigint"), 6)).join(
        F.broadcast(words) if source_bytes(parent.select(pk)) <= BROADCAST_LIMIT // 16 else words, "_word", "left")
    bit = F.expr("shiftright(_bits, CAST(CAST(_key AS BIGINT) & 63 AS INT)) & 1")
    return met.filter(F.coalesce(bit, F.lit(0)) == 0).groupBy("_key").agg(n_rows().alias("n"))


def referential_integrity(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphans per foreign key: (name, child, child key, parent, parent key).  NULL keys are not orphans.

    Whole-number parent keys become an exact bit table, which children pass where they stand if its source is within a sixteenth of the
    broadcast limit; only orphans are shuffled and counted.  Beyond the limit the join is on words of 64 keys.  Other keys are
    counted per value first, so that a hot key is one row in the anti join.  (A Bloom filter can clear no child: its hits are
    only probable.)
    """
    out = None
    for name, child, ck, parent, pk in checks:
        part = _orphans(child, ck, parent, pk).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), n_rows().alias("orphan_keys")
        ).select(F.lit(name).alias("foreign_key"), "orphan_rows", "orphan_keys")
        out = part if out is None else out.unionByName(part)
    return out


def lines_with_taxonomy(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items left-joined to products: an unknown product keeps its lines with NULL taxonomy."""
    return items.join(products, "sku", "left")


def calibration_step(txns: DataFrame, targets: Mapping[str, float], current: Column, damp: float = 0.6) -> DataFrame:
    """One damped proportional update of a merchant's weight: (target share / actual share) ** damp."""
    split = txns.groupBy("banner_code").agg(sum_money("subtotal").alias("s"))
    want = F.lit(None).cast("double")
    for b, t in targets.items():
        want = F.when(F.col("banner_code") == b, float(t)).otherwise(want)
    total = split.filter(want.isNotNull()).agg(sum_money("s")).scalar()
    out = split.filter(want.isNotNull()).withColumns({"target": want, "actual": ratio(F.col("s"), total)})
    factor = F.pow(F.col("target") / F.greatest(F.col("actual"), F.lit(1e-6)), F.lit(damp))
    return out.select("banner_code", "target", "actual", factor.alias("factor"),
                      F.round(current * factor, 3).alias("next_weight"))
