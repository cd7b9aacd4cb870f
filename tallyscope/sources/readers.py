"""Guarded and typed readers for Parquet, CSV and JSON."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a terminal observes.  Tables and columns outside this list are not readable here.
OBSERVABLE: dict[str, frozenset[str]] = {
    "transactions": frozenset(
        "txn_id customer_token store_id txn_ts tender network entry_mode wallet_provider wallet_at_tap "
        "connectivity_type subtotal discount_total n_lines segment banner_code".split()
    ),
    "transaction_items": frozenset(
        "txn_id line_id sku qty unit_price discount promo_id line_total".split()
    ),
    "promotions": frozenset(
        "promo_id sku merchant_id promo_type start_date end_date depth_pct".split()
    ),
    "products": frozenset(
        "sku merchant_id banner_code segment product_name description brand size private_label "
        "merchant_department merchant_category merchant_subcategory functional_department "
        "functional_category functional_subcategory shelf_price".split()
    ),
    "merchants": frozenset("merchant_id name segment positioning_tier store_count".split()),
    "stores": frozenset(
        "store_id merchant_id banner_code latitude longitude neighborhood metro_region open_date".split()
    ),
}
# Tables holding planted state.
WITHHELD_TABLES = frozenset({"customers", "zones"})

PRODUCT_SCHEMA = (
    "segment string, banner_code string, merchant_id string, sku string, product_name string, description string, "
    "brand string, private_label boolean, size string, merchant_department string, merchant_category string, "
    "merchant_subcategory string, functional_department string, functional_category string, "
    "functional_subcategory string, shelf_price double"
)
CANONICAL_SCHEMA = "banner_code string, sku string, canonical_id string"


class ForbiddenColumnError(ValueError):
    """A table or column outside the allow-list was asked for."""


class SourcePathError(ValueError):
    """A plan reads from a folder it must not see."""


def check_columns(
    table: str,
    columns: Iterable[str] | None = None,
    allow: Mapping[str, Iterable[str]] = OBSERVABLE,
    withheld: Iterable[str] = WITHHELD_TABLES,
) -> list[str]:
    """Columns to read, after the allow-list check.  Runs on names only, before any file is opened."""
    if table in set(withheld):
        raise ForbiddenColumnError(f"table {table!r} is withheld")
    if table not in allow:
        raise ForbiddenColumnError(f"table {table!r} is not observable; choose one of {sorted(allow)}")
    allowed = set(allow[table])
    if columns is None:
        return sorted(allowed)
    wanted = list(columns)
    refused = [c for c in wanted if c not in allowed]
    if refused:
        raise ForbiddenColumnError(f"columns {refused} of {table!r} are not observable")
    return wanted


def allowlisted_read(
    spark: SparkSession,
    root: str,
    table: str,
    columns: Iterable[str] | None = None,
    allow: Mapping[str, Iterable[str]] = OBSERVABLE,
    withheld: Iterable[str] = WITHHELD_TABLES,
) -> DataFrame:
    """Lazy Parquet scan of the allowed columns; the projection reaches the scan's ReadSchema."""
    return read_parquet(spark, f"{root}/{table}.parquet").select(*check_columns(table, columns, allow, withheld))


def read_parquet(spark: SparkSession, path_or_glob: str) -> DataFrame:
    return spark.read.parquet(path_or_glob)


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog with declared types (`size` stays text).  Row order is left to the consumer."""
    return spark.read.schema(PRODUCT_SCHEMA).option("header", True).csv(path)


def read_canonical_map_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANONICAL_SCHEMA).option("header", True).csv(path)


def read_base_catalog(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """One JSON array file per category -> canonical rows numbered in file order, `CATEGORY-0001` onward.

    The array is parsed as one value per file, so that positions in the array survive the scan.
    """
    item = "array<struct<name:string,subcategory:string,base_price:double>>"
    parts = [
        spark.read.text(path, wholetext=True).select(
            F.lit(category).alias("category"), F.posexplode(F.from_json("value", item)).alias("pos", "item")
        )
        for category, path in files.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        F.format_string("%s-%04d", F.col("category"), F.col("pos") + 1).alias("canonical_sku"),
        F.col("item.name").alias("name"),
        "category",
        F.col("item.subcategory").alias("subcategory"),
        F.col("item.base_price").alias("base_price"),
    )


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "merchant_id string, keep_fraction double, tight_multiplier double, loose_multiplier double, "
        "tight_categories array<string>, loose_categories array<string>, included_canonical_skus array<string>"
    )
    return spark.read.schema(schema).json(path, multiLine=True)


def apply_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The merchant's subset of the base catalog, priced by category tier."""
    listed = overlay.select("*", F.explode("included_canonical_skus").alias("canonical_sku"))
    factor = (
        F.when(F.array_contains("tight_categories", F.col("category")), F.col("tight_multiplier"))
        .when(F.array_contains("loose_categories", F.col("category")), F.col("loose_multiplier"))
        .otherwise(1.0)
    )
    return base.join(listed, "canonical_sku").select(
        "merchant_id", "canonical_sku", "name", "category", "subcategory",
        F.round(F.col("base_price") * factor, 2).alias("price"),
    )


def check_source_paths(df: DataFrame, forbidden_root: str) -> DataFrame:
    """Refuse a plan whose input files lie under `forbidden_root` (reads file listings only)."""
    root = forbidden_root.rstrip("/") + "/"
    bad = [p for p in df.inputFiles() if root in p.split(":", 1)[-1].replace("//", "/")]
    if bad:
        raise SourcePathError(f"{len(bad)} input files lie under {root}")
    return df


def register_views(frames: Mapping[str, DataFrame]) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def register_lake_views(spark: SparkSession, root: str, viewer: str) -> bool:
    """Views over the published lake under one viewer's labels; False without a lake, or for a viewer not in it.

    `lake_segment_transactions` has the lines of the viewer and its peers only.
    """
    from tallyscope.operators.lake import viewer_lake

    try:
        if spark.read.parquet(f"{root}/viewers").filter(F.col("viewer") == viewer).isEmpty():
            return False
        lines, stores = viewer_lake(spark, root, viewer)
        own, _ = viewer_lake(spark, root, viewer, ["self", "peer"])
    except (AnalysisException, FileNotFoundError):
        return False
    register_views({"lake_transactions": lines, "lake_segment_transactions": own, "lake_stores": stores})
    return True


# Old name -> name the card queries use.
TRANSACTION_ALIASES = {"banner_code": "merchant_id", "subtotal": "txn_total", "customer_token": "customer_id"}


def aliased(df: DataFrame, names: Mapping[str, str] = TRANSACTION_ALIASES) -> DataFrame:
    """A view of the frame in another column vocabulary."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


# Key and join columns by table.
TABLE_KEYS = {
    "merchants": ("merchant_id", ""),
    "stores": ("store_id", "merchant_id"),
    "products": ("sku", ""),
    "transactions": ("txn_id", "store_id"),
    "transaction_items": ("txn_id,line_id", "txn_id,sku"),
    "promotions": ("promo_id,sku", "sku"),
    "lake_transactions": ("lake_line_id", "lake_store_id"),
    "lake_stores": ("lake_store_id", ""),
}


def schema_catalogue(frames: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, str]] = TABLE_KEYS) -> DataFrame:
    """Table, column, type, key roles, and how many values each column holds (one pass per table)."""
    parts = []
    for table, df in frames.items():
        pk, fk = (set(x.split(",")) for x in keys.get(table, ("", "")))
        rows = F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                    F.lit(f.name in pk).alias("primary_key"),
                    F.lit(f.name in fk).alias("join_key"),
                    F.col(f"_n{i}").alias("n_values"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
        counted = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_n{i}") for i, f in enumerate(df.schema.fields)])
        parts.append(counted.select(F.lit(table).alias("table"), F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for table, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(table).alias("table"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out
