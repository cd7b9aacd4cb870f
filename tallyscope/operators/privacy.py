"""k-anonymous aggregation over labelled lake lines.

The floor counts PEER rows of a group.  It is a filter on the aggregate (a HAVING), evaluated on the executors,
before any ordering or limit: a suppressed group never takes a place in a top-k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.ranking import exact_quantiles
from tallyscope.operators.lake import IDENTITY_COLUMNS

K_FLOOR = 50
Grouping = Literal["plain", "rollup", "cube"]


class LakeContractError(ValueError):
    """The request does not have the shape of a k-anonymous aggregate."""


def _is_peer() -> Column:
    return F.col("peer_relationship") == "peer"


def lake_groups(
    lake: DataFrame,
    dims: Sequence[str],
    metrics: Mapping[str, Column],
    relationships: Sequence[str] = ("self", "peer"),
    grouping: Grouping = "plain",
    rows: str | None = None,
) -> DataFrame:
    """All groups with their metrics and the hidden peer-row count `_k`.

    The relationships in scope must be named; "self" and "peer" are the own-versus-peer reading.  Columns that
    identify are no dimensions.  When the frame is pre-aggregated, `rows` names its column of line counts.
    """
    if not metrics:
        raise LakeContractError("a lake query must aggregate")
    if "peer_relationship" not in lake.columns:
        raise LakeContractError("the lake frame has no peer_relationship")
    if not relationships or not set(relationships) <= {"self", "peer", "merchant"}:
        raise LakeContractError("name the relationships in scope")
    if "_k" in metrics or "_k" in dims:
        raise LakeContractError("_k is reserved")
    if named := sorted(IDENTITY_COLUMNS.intersection(dims)):
        raise LakeContractError(f"{named} identify a merchant or a person")
    scoped = lake.filter(F.col("peer_relationship").isin(*relationships))
    peers = F.count_if(_is_peer()) if rows is None else F.coalesce(F.sum(F.when(_is_peer(), F.col(rows))), F.lit(0))
    aggs = [m.alias(n) for n, m in metrics.items()] + [peers.alias("_k")]
    if grouping == "plain":
        return (scoped.groupBy(*dims) if dims else scoped.groupBy()).agg(*aggs)
    grouped = scoped.rollup(*dims) if grouping == "rollup" else scoped.cube(*dims)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), *aggs)


def k_floor(groups: DataFrame, k: int = K_FLOOR, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Groups with at least k peer rows, `_k` stripped; then order and limit."""
    kept = groups.filter(F.col("_k") >= k).drop("_k")
    if order:
        kept = kept.orderBy(*order)
    return kept.limit(limit) if limit is not None else kept


def suppression_summary(groups: DataFrame, k: int = K_FLOOR) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("_k") < k).alias("n_suppressed")
    )


def k_anonymous_aggregate(
    lake: DataFrame,
    dims: Sequence[str],
    metrics: Mapping[str, Column],
    k: int = K_FLOOR,
    relationships: Sequence[str] = ("self", "peer"),
    grouping: Grouping = "plain",
    order: Sequence[Column] = (),
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept groups, one-row suppression summary).  Both read one aggregate; its exchange is reused."""
    groups = lake_groups(lake, dims, metrics, relationships, grouping)
    return k_floor(groups, k, order, limit), suppression_summary(groups, k)


def distinct_over_sets(
    lake: DataFrame, dims: Sequence[str], ident: str, sums: Mapping[str, Column], name: str = "n_distinct",
    relationships: Sequence[str] = ("self", "peer"), grouping: Grouping = "rollup", k: int = K_FLOOR,
) -> DataFrame:
    """Exact distinct whole-number ids, and sums, over all grouping sets, from one shuffle of the facts.

    Ids become bits of one bitmap per finest cell and range of ids.  Bitmaps of the same range are united for coarser cells and
    their bits added up over the ranges, so no row is expanded once per grouping set: only cells are.  A null id counts as a row
    and not as an id.
    """
    bucket, bits = F.bitmap_bucket_number(F.col(ident).cast("bigint")), F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ident).cast("bigint")))
    rows = lake.withColumn("_range", bucket)
    cells = lake_groups(rows, [*dims, "_range"], {**{n: F.sum(c) for n, c in sums.items()}, "_bits": bits}, relationships)
    if grouping == "plain":
        sets = [list(dims)]
    elif grouping == "rollup":
        sets = [list(dims[:i]) for i in range(len(dims), -1, -1)]
    else:
        sets = [[d for j, d in enumerate(dims) if not i >> j & 1] for i in range(1 << len(dims))]
    added = [F.sum(n).alias(n) for n in [*sums, "_k"]]
    united = cells.groupingSets([[*x, "_range"] for x in sets], *dims, "_range").agg(
        F.shiftright(F.grouping_id(), 1).cast("int").alias("level"), F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_d"), *added)
    out = united.groupBy(*dims, "level").agg(*added, F.sum("_d").alias(name))
    return k_floor(out if grouping != "plain" else out.drop("level"), k)


# Size of the stored sketches and what it promises: relative standard error of distinct counts, normalised rank error of quantiles.
HLL_LG, KLL_K = 16, 4096
DISTINCT_ERROR, RANK_ERROR = 0.83 / 2 ** (HLL_LG / 2), 2.446 / KLL_K ** 0.9433


def sketch_cells(lake: DataFrame, dims: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Peer cells to be stored: dims, n_values, mergeable sketches of the distinct ids and of the values, and the row count."""
    return lake_groups(lake, dims, {
        "n_values": F.count(value), "distinct_sketch": F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(HLL_LG)),
        "value_sketch": F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)),
    }, ["peer"]).withColumnRenamed("_k", "n_rows")


def from_sketches(cells: DataFrame, dims: Sequence[str], quantiles: Mapping[str, float], k: int = K_FLOOR) -> DataFrame:
    """Stored cells merged to the coarser `dims`, under the floor: estimates and the errors they are published with.

    `distinct_error` is one relative standard error, `rank_error` the share of the rows by which a quantile's rank may be off.
    A cell whose stored values are all null has no quantiles.
    """
    merged = cells.groupBy(*dims).agg(
        F.sum("n_rows").alias("_k"), F.sum("n_values").alias("n_values"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("value_sketch").alias("_v"))
    some = F.when(F.col("n_values") > 0, F.col("_v"))
    return k_floor(merged.withColumn("n_rows", F.col("_k")).select(
        *dims, "n_rows", "n_values", F.hll_sketch_estimate("_d").alias("distinct_estimate"),
        *[F.kll_sketch_get_quantile_double(some, F.lit(float(q))).alias(n) for n, q in quantiles.items()],
        F.lit(DISTINCT_ERROR).alias("distinct_error"), F.lit(RANK_ERROR).alias("rank_error"), "_k"), k)


def log_product(n: str, value: str) -> list[Column]:
    """The product of n-fold values as sign, number of zeros and decimal exponent: no product is too large for it."""
    v, times = F.col(value), F.col(n)
    zeros = F.sum(F.when(v == 0, times).otherwise(0))
    odd = F.sum(F.when(v < 0, times).otherwise(0)) % 2 == 1
    return [
        F.when(zeros > 0, 0).when(odd, -1).otherwise(1).alias("product_sign"), zeros.alias("product_zeros"),
        F.round(F.coalesce(F.sum(F.when(v != 0, times * F.log10(F.abs(v)))), F.lit(0.0)), 6).alias("product_log10")]


def lake_agg_functions(
    lake: DataFrame, dims: Sequence[str], value: str, count_value: str, arg: str, flag: Column, order: Sequence[str], k: int = K_FLOOR
) -> DataFrame:
    """Every aggregate function of the lake contract over peer rows, under the floor.

    Moments are taken over whole numbers (`count_value`), so that they do not depend on the order of rows; exact
    quantiles use the binned helper rather than one collected group.  `mode` breaks ties by the smallest value:
    the counts per value come from a pre-aggregation, and so does the product over all rows.  `first` and `last` are those of the
    `order` columns (which should be unique), not of the order in which tasks deliver.
    """
    peers = lake.filter(_is_peer())
    v, c = F.col(value), F.col(count_value).cast("bigint")
    n, s, q = F.count(c).cast("double"), F.sum(c).cast("double"), F.sum(c * c).cast("double")
    var_pop = (q - s * s / n) / n
    var_samp = F.try_divide(q - s * s / n, n - 1)
    plain = peers.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_values"),
        F.sum(c).alias("total"),
        (s / n).alias("mean"),
        F.min(v).alias("lowest"),
        F.max(v).alias("highest"),
        var_pop.alias("var_pop"), var_samp.alias("var_samp"),
        F.sqrt(var_pop).alias("stddev_pop"), F.sqrt(var_samp).alias("stddev_samp"),
        F.min_by(F.col(arg), F.struct(v, F.col(arg))).alias("arg_lowest"),
        F.max_by(F.col(arg), F.struct(v, F.col(arg))).alias("arg_highest"),
        F.bool_and(flag).alias("all_flag"), F.bool_or(flag).alias("any_flag"),
        F.min_by(v, F.struct(*order)).alias("first"), F.max_by(v, F.struct(*order)).alias("last"),
        F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(HLL_LG))).alias("approx_distinct"),
        F.count_if(_is_peer()).alias("_k"),
    )
    per_value = peers.groupBy(*dims, c.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    modes = per_value.groupBy(*dims).agg(
        F.max_by("_c", F.struct("_n", -F.col("_c"))).alias("mode"),
        *log_product("_n", "_c"),
        F.count(F.lit(1)).alias("n_distinct"),
    )
    quants = exact_quantiles(peers, dims, value, {"median": 0.5, "q90": 0.9}, {"median_disc": 0.5})
    return k_floor(plain, k).join(modes, list(dims)).join(quants, list(dims))
