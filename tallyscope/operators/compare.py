"""Own versus peer: price gaps, mix indices, shares, movers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.calendar import week_of
from tallyscope.functions.money import mean_money, ratio, sum_int, sum_money
from tallyscope.functions.ranking import top_n
from tallyscope.operators.lake import IDENTITY_COLUMNS
from tallyscope.operators.privacy import K_FLOOR, k_floor, lake_groups


def is_self() -> Column:
    return F.col("peer_relationship") == "self"


def is_peer() -> Column:
    return F.col("peer_relationship") == "peer"


class GrainError(ValueError):
    """Own and peer frames do not share the join keys or values asked for."""


class ViewerScopeError(ValueError):
    """A frame holds another merchant's rows, or names an identity."""


def own_peer_gap(
    own: DataFrame, peer: DataFrame, on: Sequence[str], own_value: str, peer_value: str,
    gap_op: Literal["difference", "ratio"] = "difference", viewer: str | None = None,
    own_banner_col: str | None = "banner_code",
) -> DataFrame:
    """Inner join on the grain keys: own_value, peer_benchmark and their gap.

    Names are checked before the plan is built.  A foreign banner among the own rows fails the job on the
    executors, without a separate pass over the data.  Date-typed keys meet as dates when one side is a timestamp.
    """
    for side, df, value in (("own", own, own_value), ("peer", peer, peer_value)):
        missing = [c for c in [*on, value] if c not in df.columns]
        if missing:
            raise GrainError(f"{side} frame lacks {missing}")
    leaked = {"banner_code", "merchant_id", "merchant", "name"} & set(peer.columns)
    if leaked:
        raise ViewerScopeError(f"peer frame carries identity columns {sorted(leaked)}")
    if gap_op not in ("difference", "ratio"):
        raise ValueError(f"unknown gap_op {gap_op!r}")
    temporal = (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)
    for c in on:
        a, b = own.schema[c].dataType, peer.schema[c].dataType
        if a != b and isinstance(a, temporal) and isinstance(b, temporal):
            own, peer = own.withColumn(c, F.col(c).cast("date")), peer.withColumn(c, F.col(c).cast("date"))
    if viewer is not None and own_banner_col and own_banner_col in own.columns:
        # A predicate, unlike an unused column, is never pruned.
        own = own.filter(
            F.when(F.col(own_banner_col) == viewer, True).otherwise(
                F.raise_error(F.lit(f"own frame for {viewer} holds rows of other merchants")).cast("boolean")
            )
        )
    left = own.select(*on, F.col(own_value).alias("own_value"))
    right = peer.withColumnRenamed(peer_value, "peer_benchmark")
    a, b = F.col("own_value"), F.col("peer_benchmark")
    gap = a - b if gap_op == "difference" else ratio(a, b)
    return left.join(right, list(on)).withColumn("gap", gap)


def price_gap(
    lake: DataFrame, dims: Sequence[str] = ("category", "subcategory"), store: str = "lake_store_id", k: int = K_FLOOR,
    ascending: bool = True,
) -> DataFrame:
    """Own and peer mean price, units and stores per group, gap = own / peer - 1, NULL gaps last."""
    groups = price_gap_groups(lake, dims, store)
    gap = F.col("gap")
    order = [gap.asc_nulls_last() if ascending else gap.desc_nulls_last(), F.col("own_units").desc_nulls_last(),
             *[F.col(d) for d in reversed(dims)]]
    return k_floor(groups, k, order)


def price_gap_groups(lake: DataFrame, dims: Sequence[str], store: str = "lake_store_id") -> DataFrame:
    """Lines collapse per group and store first, map-side; store counts are then row counts, with no distinct."""
    per_store = lake.groupBy(*dims, "peer_relationship", store).agg(
        sum_money("unit_price").alias("_price"), F.count("unit_price").alias("_priced"), F.sum("qty").alias("_qty"),
        F.count(F.lit(1)).alias("_rows"),
    )

    def asp(side: Column) -> Column:
        return F.try_divide(sum_money("_price", side), F.sum(F.when(side, F.col("_priced"))))

    groups = lake_groups(per_store, dims, {
        "own_asp": asp(is_self()),
        "peer_asp": asp(is_peer()),
        "own_units": sum_int("_qty", is_self()),
        "peer_units": sum_int("_qty", is_peer()),
        "own_stores": F.count_if(is_self() & F.col(store).isNotNull()),
        "peer_stores": F.count_if(is_peer() & F.col(store).isNotNull()),
    }, rows="_rows")
    return groups.withColumn("gap", ratio("own_asp", "peer_asp") - 1)


def mix_index(lake: DataFrame, dims: Sequence[str] = ("subcategory",), k: int = K_FLOOR) -> DataFrame:
    """Own share of units over peer share, and the units missing to market parity.

    Totals are scalar aggregates over the grouped rows, of all groups, before the floor.
    """
    g = lake_groups(lake, dims, {"own_u": sum_int("qty", is_self()), "peer_u": sum_int("qty", is_peer())})
    own_t, peer_t = g.agg(F.sum("own_u")).scalar(), g.agg(F.sum("peer_u")).scalar()
    out = g.withColumns({"own_share": ratio(F.col("own_u"), own_t), "peer_share": ratio(F.col("peer_u"), peer_t)})
    out = out.withColumns({
        "mix_index": ratio("own_share", "peer_share"),
        "opportunity_units": own_t.cast("double") * F.col("peer_share") - F.col("own_u").cast("double"),
    })
    return k_floor(out, k, [F.col("mix_index").asc_nulls_last(), *[F.col(d) for d in dims]])


def own_drill_breadth(lines: DataFrame, subcategory: str) -> DataFrame:
    """Merchant-level units and distinct products inside one functional subcategory."""
    return (
        lines.filter(F.col("subcategory") == subcategory)
        .groupBy("merchant_department", "category")
        .agg(F.sum("qty").alias("units"), F.count_distinct("sku").alias("skus"))
        .orderBy(F.desc("units"), "merchant_department", "category")
    )


def product_drivers(lines: DataFrame, subcategory: str, n: int) -> DataFrame:
    return (
        lines.filter(F.col("subcategory") == subcategory)
        .groupBy("product_name")
        .agg(mean_money("unit_price").alias("asp"), F.sum("qty").alias("units"))
        .orderBy(F.desc("units"), "product_name")
        .limit(n)
    )


def velocity(lines: DataFrame, dim: str = "category") -> DataFrame:
    return (
        lines.groupBy(dim)
        .agg(F.sum("qty").alias("units"), sum_money("line_total").alias("sales"))
        .orderBy(F.desc("units"), dim)
    )


def neighborhood_share(lake: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Own and peer units by neighborhood and own / (own + peer)."""
    g = lake_groups(lake, ["neighborhood"], {
        "own_units": F.coalesce(sum_int("qty", is_self()), F.lit(0)), "peer_units": sum_int("qty", is_peer())
    })
    return k_floor(g.withColumn("own_share", ratio("own_units", F.col("own_units") + F.col("peer_units"))), k)


def neighborhood_peer_units(lake_lines: DataFrame, lake_stores: DataFrame, k: int = K_FLOOR) -> DataFrame:
    """Peer units by neighborhood, the neighborhood coming from the store table by token."""
    joined = lake_lines.join(lake_stores.select("lake_store_id", "neighborhood"), "lake_store_id")
    return k_floor(lake_groups(joined, ["neighborhood"], {"peer_units": F.sum("qty")}, ["peer"]), k)


def weekly_own_vs_peer(lake: DataFrame, date_col: str = "txn_ts", k: int = K_FLOOR, grain: str = "week") -> DataFrame:
    """Own and peer units per period, in its order; `grain` is `day`, `week` (its Monday) or `month` (its first day)."""
    start = {"week": week_of(F.col(date_col)), "day": F.col(date_col).cast("date"), "month": F.trunc(date_col, "month")}[grain]
    return k_floor(lake_groups(lake.withColumn(grain, start), [grain], {
        "own_units": sum_int("qty", is_self()), "peer_units": sum_int("qty", is_peer())
    }), k, [F.col(grain)])


def peer_aggregate(
    lake: DataFrame, dims: Sequence[str], metrics: dict[str, Column], k: int = K_FLOOR
) -> DataFrame:
    """Floored aggregate over peer rows only; without dims, one row for the whole peer group."""
    return k_floor(lake_groups(lake, dims, metrics, ["peer"]), k)


def own_category_performance(lines: DataFrame, dims: Sequence[str]) -> DataFrame:
    return lines.groupBy(*dims).agg(
        mean_money("unit_price").alias("asp"),
        F.sum("qty").alias("units"),
        sum_money("line_total").alias("sales"),
        F.count_distinct("txn_id").alias("txns"),
    )


def whole_months(lines: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """Lines of months that are over by the last day that `calendar` has in its column `ts`."""
    last = calendar.agg(F.max(F.col(ts).cast("date"))).scalar()
    return lines.filter(F.last_day(F.col(ts).cast("date")) <= last)


def top_movers(
    tidy: DataFrame, dim: str, period: str, value: str, count: str | None = None, k: int = K_FLOOR,
    min_volume: float = 0.0, n: int = 3, n_base: int = 4,
) -> DataFrame:
    """Recent period against the mean of the `n_base` periods IMMEDIATELY before it, per dimension value.

    `tidy` has one row per dimension value and period.  Incomplete series, periods under k counted rows and small
    baselines drop out; the n largest rises and falls remain.  The period list comes from one scalar aggregate.
    """
    need = n_base + 1
    periods = tidy.agg(F.sort_array(F.collect_set(period), asc=False).alias("p"))
    last = periods.select(F.when(F.size("p") >= need, F.slice("p", 1, need))).scalar()
    near = tidy.withColumn("_last", last).filter(F.array_contains("_last", F.col(period)))
    is_recent = F.col(period) == F.element_at("_last", 1)
    v = F.col(value).cast("double")
    base_values = F.sort_array(F.collect_list(F.when(~is_recent, F.struct(F.col(period), v.alias("v")))))
    grouped = near.groupBy(dim).agg(
        F.max(F.when(is_recent, v)).alias("recent"),
        # At most n_base entries, added in period order.
        (F.aggregate(base_values, F.lit(0.0), lambda s, x: s + x["v"]) / n_base).alias("baseline"),
        F.count(v).alias("_periods"),
        F.min(F.col(count) if count else F.lit(k)).alias("_least"),
    )
    delta = (F.col("recent") - F.col("baseline")) / F.col("baseline")
    kept = grouped.filter(
        (F.col("_periods") == need) & (F.col("_least") >= k) & (F.col("baseline") > 0)
        & (F.col("baseline") >= min_volume) & F.col(dim).isNotNull()
    ).select(
        dim, F.round("recent", 4).alias("recent"), F.round("baseline", 4).alias("baseline"),
        F.round(delta, 4).alias("delta_pct"),
    ).filter(F.col("delta_pct") != 0).withColumn("direction", F.when(F.col("delta_pct") > 0, "up").otherwise("down"))
    size = F.abs(F.col("delta_pct"))
    return top_n(kept, ["direction"], [size.desc(), F.col(dim)], n).drop("rn").orderBy(
        size.desc(), F.desc("direction"), F.col(dim)
    )


def product_price_vs_peers(
    own: DataFrame, lake: DataFrame, n: int = 10, key: str = "product_name", k: int = K_FLOOR
) -> DataFrame:
    """The n products (or groups) peers sell most, with own and peer mean price, of those with k peer lines."""
    peers = lake.filter(is_peer()).groupBy(key).agg(
        F.sum("qty").alias("peer_qty"), mean_money("unit_price").alias("_peer"), F.count(F.lit(1)).alias("_k")
    )
    top = k_floor(peers, k, [F.desc("peer_qty"), F.col(key)], n)
    mine = own.groupBy(key).agg(mean_money("unit_price").alias("_own"), F.sum("qty").alias("own_qty"))
    a, b = F.round("_own", 2), F.round("_peer", 2)
    return top.join(mine, key, "left").select(
        key, a.alias("own_price"), b.alias("peer_avg_price"), F.round(a - b, 2).alias("gap_usd"),
        F.round(F.try_divide(100.0 * (a - b), b), 1).alias("own_vs_peer_pct"), "peer_qty",
    )


def price_by_peer_pivot(own: DataFrame, peers: DataFrame, labels: Sequence[str], n: int = 10,
                        key: str = "product_name", label: str = "peer_label", k: int = K_FLOOR) -> DataFrame:
    """Own mean price next to each anonymous peer's, for the n products (or groups) the peers together sell most.

    A product under k peer lines is left out; the price of a peer under k lines of its own is NULL.
    """
    if label in IDENTITY_COLUMNS:
        raise ViewerScopeError(f"{label} names the peers")

    def price(x: str) -> Column:
        its = F.col(label) == x
        return F.when(F.count_if(its) >= k, mean_money("unit_price", its)).alias(f"price_{x}")

    wide = peers.groupBy(key).agg(
        F.sum("qty").alias("peer_qty"), F.count(F.lit(1)).alias("_k"), *[price(x) for x in labels]
    )
    mine = own.groupBy(key).agg(mean_money("unit_price").alias("own_price"))
    out = k_floor(wide, k, [F.desc("peer_qty"), F.col(key)], n).join(mine, key, "left")
    return out.select(
        key, "own_price", *[f"price_{x}" for x in labels],
        *[(F.try_divide(F.col("own_price") - F.col(f"price_{x}"), F.col(f"price_{x}")) * 100).alias(f"pct_vs_{x}")
          for x in labels], "peer_qty",
    )


def line_share(lake: DataFrame, category: str, k: int = K_FLOOR) -> DataFrame:
    """Lines of one category among all lines, own next to peers; the peers' row needs k lines of the category."""
    hit = F.count_if(F.col("category") == category)
    shares = lake.filter(is_self() | is_peer()).groupBy(F.col("peer_relationship").alias("source")).agg(
        F.count(F.lit(1)).alias("total_lines"), hit.alias("category_lines"),
        (hit.cast("double") * 100 / F.count(F.lit(1))).alias("line_share_pct"),
    )
    return shares.filter((F.col("source") == "self") | (F.col("category_lines") >= k))


def peer_basket_size(lake: DataFrame, by: str = "peer_segment", txn: str = "txn_id", k: int = K_FLOOR) -> DataFrame:
    """Items per basket, then the mean over baskets of each group with k peer lines."""
    if by in IDENTITY_COLUMNS:
        raise ViewerScopeError(f"{by} names the peers")
    per = lake.filter(is_peer()).groupBy(by, txn).agg(F.sum("qty").alias("units"), F.count(F.lit(1)).alias("lines"))
    return k_floor(per.groupBy(by).agg(
        F.count(F.lit(1)).alias("baskets"), (F.sum("units").cast("double") / F.count(F.lit(1))).alias("mean_units"),
        F.sum("lines").alias("_k"),
    ), k)
