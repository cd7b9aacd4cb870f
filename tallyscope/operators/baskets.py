"""Basket measures: lift, attachment, companions, size and shape.

A basket is one value of `txn`.  Everything starts from a map-side aggregation per basket, so a basket that holds
a third of all lines is one small row before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.money import ratio
from tallyscope.functions.ranking import exact_quantiles, top_fraction_sum, top_n

ATTACH_FLOOR = 200


def affinity_support(
    lines: DataFrame, pairs: Sequence[tuple[str, str]], anchor_col: str = "subcategory",
    partner_col: str | None = None, txn: str = "txn_id",
) -> DataFrame:
    """P(partner | anchor) / P(partner) over baskets, for all pairs in one pass.

    One flag per name and basket, then counts; undefined quotients are NULL.
    """
    partner_col = partner_col or anchor_col
    flags: dict[tuple[str, str], str] = {}
    for a, p in pairs:
        flags.setdefault((anchor_col, a), f"_f{len(flags)}")
        flags.setdefault((partner_col, p), f"_f{len(flags)}")
    per = lines.groupBy(txn).agg(*[F.bool_or(F.col(c) == v).alias(f) for (c, v), f in flags.items()])
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for i, (a, p) in enumerate(pairs):
        fa, fp = flags[anchor_col, a], flags[partner_col, p]
        aggs += [F.count_if(F.col(fa)).alias(f"_a{i}"), F.count_if(F.col(fp)).alias(f"_p{i}"),
                 F.count_if(F.col(fa) & F.col(fp)).alias(f"_b{i}")]
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("anchor"), F.lit(p).alias("partner"), F.col("_n").alias("n_baskets"),
            F.col(f"_a{i}").alias("support_anchor"), ratio(f"_p{i}", "_n").alias("p_partner"),
            ratio(f"_b{i}", f"_a{i}").alias("p_cond"),
        )
        for i, (a, p) in enumerate(pairs)
    ])
    return per.agg(*aggs).select(F.inline(rows)).withColumn("lift", ratio("p_cond", "p_partner"))


def affinity_lift(lines: DataFrame, pairs: Sequence[tuple[str, str]], **kw) -> DataFrame:
    return affinity_support(lines, pairs, **kw).select("anchor", "partner", "p_partner", "p_cond", "lift")


def combo_attach(
    lines: DataFrame, anchor: str, side: str, drink: str, by: str = "banner_code", col: str = "category",
    txn: str = "txn_id",
) -> DataFrame:
    """Per banner: P(side), P(drink) and P(both) given the anchor."""
    c = F.col(col)
    per = lines.groupBy(by, txn).agg(
        F.bool_or(c == anchor).alias("a"), F.bool_or(c == side).alias("s"), F.bool_or(c == drink).alias("d")
    ).filter("a")
    n = F.count(F.lit(1))
    return per.groupBy(by).agg(
        n.alias("n_anchor"), (F.count_if("s") / n).alias("side"), (F.count_if("d") / n).alias("drink"),
        (F.count_if(F.col("s") & F.col("d")) / n).alias("full"),
    )


def full_buckets(pairs: DataFrame, weight: str, bucket: Column, n_buckets: int, floor: int) -> Column:
    """Array of `n_buckets` / 64 longs whose bits are the buckets with a total weight of `floor` or more; a scalar.

    Its size is fixed: it depends neither on the pairs nor on the items.
    """
    full = pairs.groupBy(bucket.alias("_b")).agg(F.sum(weight).alias("_m")).filter(F.col("_m") >= floor)
    longs = full.groupBy(F.shiftright("_b", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_b & 63 AS INT))")).alias("bits"))
    every = pairs.sparkSession.range(n_buckets // 64).join(longs, "id", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w")).select("w.bits").scalar()


def attach_rate(lines: DataFrame, item: str, n: int, txn: str = "txn_id", floor: int = ATTACH_FLOOR, n_buckets: int = 1 << 20) -> DataFrame:
    """Of the baskets with A, the share that also hold B, for pairs seen together at least `floor` times; top n.

    Items below the floor leave by an equi-join on the item.  Each basket becomes its set of items, equal sets are
    counted once, and pairs come from distinct sets only.  A first pass adds up the pairs in hash buckets; the second counts
    exactly those pairs whose bucket reached the floor, so rare pairs are never shuffled one by one.
    """
    held = lines.filter(F.col(item).isNotNull()).select(txn, F.col(item).alias("item")).distinct()
    base = held.groupBy("item").agg(F.count(F.lit(1)).alias("a_baskets")).filter(F.col("a_baskets") >= floor)
    sets = (
        held.join(base.select("item"), "item", "left_semi").groupBy(txn).agg(F.array_sort(F.collect_list("item")).alias("items"))
        .filter(F.size("items") > 1).groupBy("items").agg(F.count(F.lit(1)).alias("m"))
    )
    pairs = sets.select("m", "items", F.posexplode("items").alias("i", "item_a")).select(
        "m", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))
    pairs = pairs.withColumn("_bucket", F.pmod(F.xxhash64("item_a", "item_b"), F.lit(n_buckets)))
    full = full_buckets(pairs, "m", F.col("_bucket"), n_buckets, floor)
    word = F.get(full, F.shiftright("_bucket", 6).cast("int"))
    may = F.expr("shiftright(_w, CAST(_bucket & 63 AS INT)) & 1") == 1
    both = pairs.withColumn("_w", word).filter(may).groupBy("item_a", "item_b").agg(F.sum("m").alias("both_ct")).filter(F.col("both_ct") >= floor)
    ways = F.array(F.struct("item_a", "item_b"), F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    return both.select("both_ct", F.inline(ways)).join(base.withColumnRenamed("item", "item_a"), "item_a").select(
        "item_a", "item_b", "both_ct", "a_baskets", ratio("both_ct", "a_baskets").alias("attach_rate")
    ).orderBy(F.desc("attach_rate"), F.desc("both_ct"), "item_a", "item_b").limit(n)


def top_companion(lines: DataFrame, by: str, n_anchors: int = 3, txn: str = "txn_id", item: str = "sku") -> DataFrame:
    """For the n products with most lines per merchant, the product most often on the same ticket.

    Lines are counted per ticket and product first.  Anchors (a handful per merchant) then meet the tickets that
    hold them, so the work is linear in the lines; pairs of other products are never formed.
    """
    per = lines.groupBy(by, txn, item).agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy(by, item).agg(F.sum("c").alias("anchor_lines"))
    anchors = top_n(sizes, [by], [F.desc("anchor_lines"), F.col(item)], n_anchors).drop("rn")
    held = per.join(anchors, [by, item]).select(
        by, txn, F.col(item).alias("anchor"), F.col("c").alias("ca"), "anchor_lines"
    )
    met = per.join(held, [by, txn]).filter(F.col(item) != F.col("anchor"))
    co = met.groupBy(by, "anchor", "anchor_lines", F.col(item).alias("companion")).agg(
        F.sum(F.col("c") * F.col("ca")).alias("co")
    )
    best = top_n(co, [by, "anchor"], [F.desc("co"), F.col("companion")], 1).drop("rn")
    return best.withColumn("prob", F.round(ratio("co", "anchor_lines"), 2))


def basket_histogram(lines: DataFrame, cap: int = 25, txn: str = "txn_id") -> DataFrame:
    per = lines.groupBy(txn).agg(F.least(F.sum("qty"), F.lit(cap)).cast("bigint").alias("units"))
    return per.groupBy("units").agg(F.count(F.lit(1)).alias("n_baskets"))


def basket_shape(baskets: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median, p95, smallest and largest value per group; quantiles interpolate exactly."""
    scale = 1 if dict(baskets.dtypes)[value] in ("bigint", "int") else 100
    whole = F.rint(F.col(value) * scale).cast("bigint")
    plain = baskets.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_txns"),
        (F.sum(whole).cast("double") / scale / F.count(F.lit(1))).alias("mean"),
        F.min(F.col(value).cast("double")).alias("min"), F.max(F.col(value).cast("double")).alias("max"),
    )
    return plain.join(exact_quantiles(baskets, [by], value, {"median": 0.5, "p95": 0.95}), by)


def heavy_tail_share(lines: DataFrame, by: Sequence[str] = (), fraction: float = 0.2, txn: str = "txn_id") -> DataFrame:
    """Share of units held by the largest fifth of baskets."""
    per = lines.groupBy(*by, txn).agg(F.sum("qty").alias("units"))
    out = top_fraction_sum(per, by, "units", fraction)
    return out.select(*by, "total", "top_total", ratio("top_total", "total").alias("top_share"))


def basket_pattern_match(
    lines: DataFrame, wanted: Sequence[str], lo: int, hi: int, n: int, col: str = "subcategory", txn: str = "txn_id"
) -> DataFrame:
    """Baskets holding every wanted group, with a line count in range; the first n by id."""
    size = F.count(F.lit(1))
    per = lines.groupBy(txn).agg(
        size.alias("n_lines"), *[F.bool_or(F.col(col) == w).alias(f"_w{i}") for i, w in enumerate(wanted)]
    )
    cond = F.col("n_lines").between(lo, hi)
    for i in range(len(wanted)):
        cond = cond & F.col(f"_w{i}")
    return per.filter(cond).select(txn, "n_lines").orderBy(txn).limit(n)
