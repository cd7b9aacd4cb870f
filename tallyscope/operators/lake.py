"""The peer lake: enriched, tokenised lines labelled relative to a viewer.

Lines are tokenised and written once, each with its merchant's token and segment.  What differs between viewers is only the
label, which follows from the viewer's own token and segment: a condition on two dictionary-coded columns of the line, so a
viewer's lake is read without a join, and one of its own segment with a filter in the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.calendar import hour_bucket
from tallyscope.functions.hashing import hash48, hash60, token
from tallyscope.functions.joins import bounded
from tallyscope.functions.money import to_cents
from tallyscope.sources.sinks import append_published, publish_partitions, read_published, write_layout

DEFAULT_SALT = "panel"
RELATIONSHIPS = ("self", "peer", "merchant")

# Columns of the published pair, and identity columns that must never appear in it.
LAKE_COLUMNS = [
    "lake_txn_id", "lake_line_id", "lake_store_id", "peer_relationship", "txn_date", "hour_bucket", "department",
    "category", "subcategory", "unit_price", "qty", "discount", "line_total", "payment_type", "card_network",
    "entry_mode", "wallet_type",
]
PUBLISHED = [c for c in LAKE_COLUMNS if c != "peer_relationship"] + ["merchant_token", "peer_segment"]  # as written, before a viewer's label
ORDER_FACTS = ["hour_bucket", "payment_type", "txn_date"]  # those that follow from `txn_ts` and `tender` of the order
LINE_FACTS = {*PUBLISHED, "network", "wallet_at_tap", "wallet_provider"} - {*ORDER_FACTS}  # what the others are or are made of
LINE_ORDER = ["peer_segment", "txn_date"]  # inside a month's files: row groups of other segments and dates are skipped
STORE_COLUMNS = ["lake_store_id", "peer_relationship", "peer_segment", "neighborhood"]
IDENTITY_COLUMNS = frozenset({
    "banner_code", "merchant_id", "merchant", "name", "store_id", "txn_id", "line_id", "sku", "product_name",
    "customer_token", "card_id", "canonical_id", "promo_id", "peer_id",
})


def enriched_lines(
    items: DataFrame, products: DataFrame, stores: DataFrame, transactions: DataFrame | None = None
) -> DataFrame:
    """items x products(sku) x transactions(txn_id) x stores(store_id), inner.

    Stores come first, because their filters (own, self and peer) decide which facts matter: they cut the side that
    carries `store_id` before the one join between two fact tables.  Transactions may be left out when no column of
    theirs is needed.
    """

    def lookup(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
        return facts.join(bounded(_without(dim, facts, key)), key)

    if "store_id" in items.columns:
        lines = lookup(lookup(items, stores, "store_id"), products, "sku")
        return lines if transactions is None else lines.join(_without(transactions, lines, "txn_id"), "txn_id")
    if transactions is None:
        raise ValueError("items without store_id need transactions")
    placed = lookup(transactions, stores, "store_id")
    lines = lookup(items, products, "sku")
    return lines.join(_without(placed, lines, "txn_id"), "txn_id")


def _without(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Drop the columns the other side already has, all but the join key."""
    return df.drop(*[c for c in df.columns if c in taken.columns and c != key])


def lake_projection(lines: DataFrame) -> DataFrame:
    """Observable lake columns: date, coarse time, taxonomy and payment facts."""
    return lines.withColumns({**_order_facts(), **_card_facts(lines)})


def _order_facts() -> dict[str, Column]:
    ts = F.col("txn_ts")
    return {"txn_date": ts.cast("date"), "hour_bucket": hour_bucket(ts), "payment_type": F.col("tender")}


def _card_facts(lines: DataFrame) -> dict[str, Column]:
    provider = F.col("wallet_provider") if "wallet_provider" in lines.columns else F.lit(None).cast("string")
    tapped = F.col("wallet_at_tap") if "wallet_at_tap" in lines.columns else F.lit(False)
    return {"card_network": F.col("network"), "wallet_type": F.when(tapped, F.coalesce(provider, F.lit("none"))).otherwise("none")}


def tokenize_ids(lines: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Salted tokens for transaction and store; the line token extends the transaction token."""
    return lines.withColumns({
        "lake_txn_id": token(F.col("txn_id"), salt),
        "lake_store_id": token(F.col("store_id"), salt),
    }).withColumn("lake_line_id", F.concat_ws("-", "lake_txn_id", F.col("line_id").cast("string")))


def panel_viewers(merchants: DataFrame) -> DataFrame:
    return merchants.select(F.col("merchant_id").alias("viewer"), F.col("segment").alias("viewer_segment"))


def label_stores(stores: DataFrame, merchants: DataFrame, viewer: str) -> DataFrame:
    """Stores with `peer_relationship` to one viewer; fails when the viewer is not in the panel."""
    home = merchants.filter(F.col("merchant_id") == viewer).agg(F.max("segment")).scalar()
    known = F.coalesce(home, F.raise_error(F.lit(f"unknown viewer {viewer}")).cast("string"))
    return stores.withColumn(
        "peer_relationship",
        F.when(F.col("banner_code") == viewer, "self").when(F.col("segment") == known, "peer").otherwise("merchant"),
    )


def label_peers(labelled: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Labelled stores with `peer_label`: the viewer's peers numbered by their tokens, NULL for other stores."""
    names = labelled.filter(F.col("peer_relationship") == "peer").select("banner_code").distinct()
    # One row per merchant of one segment.
    number = F.row_number().over(Window.orderBy(token(F.col("banner_code"), salt)))
    numbered = names.select("banner_code", F.concat(F.lit("peer_"), number.cast("string")).alias("peer_label"))
    return labelled.join(numbered, "banner_code", "left")


def published_stores(labelled: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """One row per store, without identity."""
    return labelled.select(
        token(F.col("store_id"), salt).alias("lake_store_id"),
        "peer_relationship",
        F.col("segment").alias("peer_segment"),
        "neighborhood",
    ).dropDuplicates(["lake_store_id"])


def publish(lines: DataFrame) -> DataFrame:
    """Only the published lake columns that the frame holds."""
    return lines.select(*[c for c in LAKE_COLUMNS if c in lines.columns])


def tokenized_stores(stores: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """One row per store: its token, its merchant's token, segment and neighborhood."""
    return stores.select(
        token(F.col("store_id"), salt).alias("lake_store_id"), token(F.col("banner_code"), salt).alias("merchant_token"),
        F.col("segment").alias("peer_segment"), "neighborhood",
    ).dropDuplicates(["lake_store_id"])


def build_lake(
    root: str, items: DataFrame, products: DataFrame, transactions: DataFrame, stores: DataFrame,
    merchants: DataFrame, salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Write the lake of all viewers under `root`: lines, stores, viewers and routing metadata.

    Lines are enriched, tokenised and written once, whatever the number of viewers, each with its merchant's token and
    segment; `viewers` holds those of each viewer, from which its labels follow when the lake is read.  Each directory of lines
    is one month, sorted by segment and date inside a file; months are published by a manifest (`sinks.publish_partitions`).
    Lines are dealt to their months with the ids they come with; tokens, which are longer, follow where the files are written.
    """
    spark = items.sparkSession
    dated = _dated_lines(items, products, transactions, stores, salt)
    publish_partitions(dated, f"{root}/lines", "txn_month", LINE_ORDER, replace=True, finish=lambda lines: _with_tokens(lines, salt))
    write_layout(tokenized_stores(stores, salt), f"{root}/stores")
    viewers = panel_viewers(merchants).withColumn("merchant_token", token(F.col("viewer"), salt))
    write_layout(viewers, f"{root}/viewers")
    # Every viewer sees all lines and stores under its own labels.
    lines_in, stores_in = (df.agg(F.count(F.lit(1)).alias("n")) for df in (lake_lines(spark, root), spark.read.parquet(f"{root}/stores")))
    meta = lake_metadata(peer_routing_metadata(merchants), lines_in, stores_in)
    meta.write.mode("overwrite").json(f"{root}/metadata")
    return meta


def published_lines(items: DataFrame, products: DataFrame, transactions: DataFrame, stores: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Lines as they are written: the lake's columns, the merchant's token and segment, and the month they are filed under."""
    return _with_tokens(_dated_lines(items, products, transactions, stores, salt), salt)


def _dated_lines(items: DataFrame, products: DataFrame, transactions: DataFrame, stores: DataFrame, salt: str) -> DataFrame:
    """Published lines that still have their own ids instead of tokens.

    Lines that name their store go to their order as they are; what stores and products tell of them is longer and joins then.
    """
    placed = _tokenized_merchants(stores, salt)
    if "store_id" in items.columns:
        # A column that several frames have is taken from the items, the stores, the products, then the orders.
        orders = transactions
        for other in (items, placed, products):
            orders = _without(orders, other, "txn_id")
        lines = enriched_lines(_meet_orders(items, orders), products, placed)
    else:
        lines = enriched_lines(items, products, placed, transactions)
    lines = lake_projection(lines)
    keep = [c for c in PUBLISHED if c in lines.columns]
    return lines.select("txn_id", "store_id", "line_id", *keep, _month().alias("txn_month"))


def _with_tokens(dated: DataFrame, salt: str) -> DataFrame:
    lines = tokenize_ids(dated, salt)
    return lines.select(*[c for c in PUBLISHED if c in lines.columns], "txn_month")


def _tokenized_merchants(stores: DataFrame, salt: str) -> DataFrame:
    """Stores are tokenised before the lines meet them: one hash per store and not per line."""
    return stores.withColumns({"merchant_token": token(F.col("banner_code"), salt), "peer_segment": F.col("segment")})


def _meet_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Both are facts: the merge join is named, so that orders are broadcast at no size and the plan does not change with it."""
    return lines.join(orders.hint("merge"), "txn_id")


def _month() -> Column:
    return F.date_format("txn_date", "yyyy-MM")


def lake_lines(spark: SparkSession, root: str) -> DataFrame:
    """The published lines of all merchants, as the newest manifest has them; not for viewers."""
    lines = read_published(spark, f"{root}/lines", "txn_month")
    if lines is None:
        raise FileNotFoundError(f"{root} has no published lines")
    return lines


def add_late_lines(root: str, items: DataFrame, products: DataFrame, transactions: DataFrame, stores: DataFrame, salt: str = DEFAULT_SALT) -> list[str]:
    """Publishes lines that came late; only their months are written anew.  Returns the months."""
    return append_published(published_lines(items, products, transactions, stores, salt), f"{root}/lines", "txn_month", LINE_ORDER)


def viewer_lake(spark: SparkSession, root: str, viewer: str, relationships: Sequence[str] = RELATIONSHIPS) -> tuple[DataFrame, DataFrame]:
    """(lines, stores) of the published lake under `root`, labelled for one viewer; identity tokens stay behind.

    Without "merchant" in `relationships` only the viewer's segment is read: a pushed filter, by which row groups are skipped.
    """
    me = spark.read.parquet(f"{root}/viewers").filter(F.col("viewer") == viewer).first()
    if me is None:
        label, wanted = F.lit("merchant"), F.lit("merchant" in relationships)
    else:
        inside, own = F.col("peer_segment") == me["viewer_segment"], F.col("merchant_token") == me["merchant_token"]
        label = F.when(inside & own, "self").when(inside, "peer").otherwise("merchant")
        wanted = F.lit(True) if "merchant" in relationships else inside
    picked = wanted if len(set(relationships)) == len(RELATIONSHIPS) else wanted & label.isin(*relationships)
    stores = spark.read.parquet(f"{root}/stores").filter(picked).select(
        "lake_store_id", label.alias("peer_relationship"), "peer_segment", "neighborhood")
    lines = lake_lines(spark, root).filter(picked).withColumn("peer_relationship", label)
    return lines.select(*[c for c in LAKE_COLUMNS if c in lines.columns]), stores


def line_digest(lines: DataFrame, name: str) -> DataFrame:
    """Per month and merchant token: the number of lines and the sum of a hash over their published columns, free of order.

    Columns of the line and facts of its order are hashed apart, then together: the first hash can be taken before they meet.
    """
    return _digest(lines.withColumn("_line", _line_hash(lines.columns)), name)


def _line_hash(columns: Sequence[str]) -> Column:
    return hash60(_json(sorted(set(columns) - {"txn_month", "merchant_token", *ORDER_FACTS})))


def _digest(lines: DataFrame, name: str) -> DataFrame:
    row = F.concat_ws(":", F.col("_line").cast("string"), _json([c for c in ORDER_FACTS if c in lines.columns]))
    return lines.groupBy("txn_month", "merchant_token").agg(
        F.count(F.lit(1)).alias(f"{name}_lines"), F.sum(hash48(row).cast("decimal(20,0)")).cast("string").alias(f"{name}_hash"))


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def own_digest(items: DataFrame, products: DataFrame, transactions: DataFrame, stores: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """`line_digest` of `published_lines`.  Where an order adds no more than time and tender, lines go to it as hashes."""
    placed = _tokenized_merchants(stores, salt)
    lines = enriched_lines(items, products, placed) if "store_id" in items.columns else items
    added = {*_without(transactions, lines, "txn_id").columns}
    if "store_id" not in items.columns or not {"txn_ts", "tender"} <= added or added & LINE_FACTS:
        return line_digest(published_lines(items, products, transactions, stores, salt), "own")
    tokenised = tokenize_ids(lines.withColumns(_card_facts(lines)), salt)
    hashed = tokenised.select("txn_id", "merchant_token", _line_hash([c for c in PUBLISHED if c in tokenised.columns]).alias("_line"))
    timed = _meet_orders(hashed, transactions.select("txn_id", "txn_ts", "tender"))
    return _digest(timed.withColumns(_order_facts()).withColumn("txn_month", _month()), "own")


def published_reconciliation(
    spark: SparkSession, root: str, items: DataFrame, products: DataFrame, transactions: DataFrame, stores: DataFrame, salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Per month and merchant token: whether the written lines are those that the merchants' own data give, line by line."""
    lake = line_digest(lake_lines(spark, root), "lake")
    own = own_digest(items, products, transactions, stores, salt)
    both = lake.join(own, ["txn_month", "merchant_token"], "full")
    return both.withColumn("match", F.coalesce((F.col("lake_lines") == F.col("own_lines")) & (F.col("lake_hash") == F.col("own_hash")), F.lit(False)))


def viewer_totals(per_store: DataFrame, stores: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums of whole-number measures per viewer, relationship and `by`, for all viewers at once.

    Self is the merchant's own sum, peer its segment's less its own, merchant the rest of the panel's.  Viewers meet
    sums by their segment; no store or line is repeated per viewer.
    """
    keys, sums = list(by), [F.sum(m).alias(m) for m in measures]
    placed = per_store.join(stores.select("store_id", F.col("banner_code").alias("viewer"), "segment"), "store_id")
    own = placed.groupBy("viewer", "segment", *keys).agg(*sums)
    seg = own.groupBy("segment", *keys).agg(*sums)
    # Per key the panel's sum less each segment's; segments that lack the key get the whole sum.
    every = seg.agg(F.collect_set("segment")).scalar()
    held = F.map_from_entries(F.collect_list(F.struct("segment", F.struct(*measures))))
    panel = seg.groupBy(*keys).agg(*sums, held.alias("_held")) if keys else seg.agg(*sums, held.alias("_held"))
    rest = panel.withColumn("segment", F.explode(every)).select(
        "segment", *keys, *[(F.col(m) - F.coalesce(F.col("_held")[F.col("segment")][m], F.lit(0))).alias(m) for m in measures])
    viewers = own.select("viewer", "segment").distinct()
    mine = own.select("viewer", *keys, *[F.col(m).alias(f"_{m}") for m in measures])
    peers = viewers.join(seg, "segment").join(mine, ["viewer", *keys], "left").select(
        "viewer", *keys, *[(F.col(m) - F.coalesce(f"_{m}", F.lit(0))).alias(m) for m in measures])
    parts = [(own, "self"), (peers, "peer"), (viewers.join(rest, "segment"), "merchant")]
    out = None
    for frame, name in parts:
        part = frame.select("viewer", F.lit(name).alias("peer_relationship"), *keys, *measures)
        out = part if out is None else out.unionByName(part)
    return out


def lake_metadata(routing: DataFrame, n_lines: DataFrame, n_stores: DataFrame) -> DataFrame:
    """Per viewer: segment, number of peers, and how many lines and stores its lake holds: all of the panel's."""
    return routing.withColumns({"n_lines": n_lines.scalar(), "n_stores": n_stores.scalar()})


def peer_routing_metadata(merchants: DataFrame) -> DataFrame:
    """viewer -> segment and number of OTHER merchants in it."""
    sizes = merchants.groupBy("segment").agg((F.count_distinct("merchant_id") - 1).alias("segment_peer_count"))
    return merchants.join(sizes, "segment").select(F.col("merchant_id").alias("viewer"), "segment", "segment_peer_count")


def identity_leak_check(published: DataFrame) -> DataFrame:
    """One row per rule with its number of violations; all zero for a clean frame."""
    cols = published.columns
    leaked = [c for c in cols if c in IDENTITY_COLUMNS]
    merchant_labels = [c for c in cols if c.startswith("merchant_")]
    bucket = F.col("hour_bucket") if "hour_bucket" in cols else F.lit(0)
    rel = F.col("peer_relationship")
    counted = published.agg(
        F.count_if(rel.isNull() | ~rel.isin(*RELATIONSHIPS)).alias("r"),
        F.count_if(~bucket.between(0, 9)).alias("b"),
    )
    def rule(name: str, violations: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), violations.cast("bigint").alias("violations"))

    rules = F.array(
        rule("identity_columns", F.lit(len(leaked))),
        rule("merchant_labels", F.lit(len(merchant_labels))),
        rule("relationship_vocabulary", F.col("r")),
        rule("hour_bucket_range", F.col("b")),
    )
    return counted.select(F.inline(rules))


def peer_reconciliation(
    published: DataFrame, lake_stores: DataFrame, lines: DataFrame, stores: DataFrame, merchants: DataFrame, salt: str = DEFAULT_SALT,
    tolerance: float = 1e-6,
) -> DataFrame:
    """For every viewer: units and mean price over the peers of the published lake equal its peers' own data.

    The lake side sums tokenised lines (lake_store_id, qty, unit_price) by the merchant tokens of `lake_stores`; the
    other side sums the merchants' own lines by their codes.  Both give segment less own.
    """
    def totals(frame: DataFrame, store: str) -> DataFrame:
        return frame.groupBy(store).agg(F.sum("qty").alias("u"), F.sum(to_cents("unit_price")).alias("p"), F.count("unit_price").alias("n"))

    def pooled(per_store: DataFrame, dims: DataFrame, store: str, who: str, segment: str) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("u", "p", "n")]
        own = per_store.join(dims.select(store, F.col(who).alias("who"), F.col(segment).alias("segment")), store)
        own = own.groupBy("who", "segment").agg(*sums)
        seg = own.groupBy("segment").agg(*[F.sum(c).alias(f"s{c}") for c in ("u", "p", "n")])
        return own.join(seg, "segment").filter("sn > n").select(
            "who", (F.col("su") - F.col("u")).alias("units"),
            ((F.col("sp") - F.col("p")).cast("double") / 100 / (F.col("sn") - F.col("n"))).alias("mean"),
        )

    lake = pooled(totals(published, "lake_store_id"), lake_stores, "lake_store_id", "merchant_token", "peer_segment")
    own = pooled(totals(lines, "store_id"), stores, "store_id", "banner_code", "segment")
    viewers = merchants.select(F.col("merchant_id").alias("viewer"), token(F.col("merchant_id"), salt).alias("_token"))
    both = viewers.join(lake.withColumnsRenamed({"who": "_token", "units": "lake_units", "mean": "lake_avg"}), "_token", "left").join(
        own.withColumnsRenamed({"who": "viewer", "units": "pooled_units", "mean": "pooled_avg"}), "viewer", "left")
    both = both.filter("lake_units IS NOT NULL OR pooled_units IS NOT NULL").drop("_token")
    same = (F.col("lake_units") == F.col("pooled_units")) & (F.abs(F.col("lake_avg") - F.col("pooled_avg")) <= tolerance)
    return both.withColumn("match", F.coalesce(same, F.lit(False)))
