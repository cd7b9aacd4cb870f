"""Parquet sinks with a reproducible content order, and order-free content hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.hashing import hash48

# Writer settings of the published layout.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "3",
    "parquet.enable.dictionary": "true",
    "parquet.block.row.count.limit": "64000",
}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that is unset, on a local master, a temporary folder is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyscope-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_layout(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """The frame as it is partitioned and sorted, with the writer settings of the published layout."""
    df.write.mode("overwrite").options(**WRITE_OPTIONS).partitionBy(*partition_cols).parquet(path)


def _alphabetical(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_sorted(df: DataFrame, path: str, sort_keys: Sequence[str] = (), files: int | None = None) -> None:
    """Columns in alphabetical order, rows in key order over the whole dataset.

    The files are range partitions of the keys, so the data is globally ordered and no task sees all of it.
    """
    out = _alphabetical(df)
    if sort_keys:
        out = out.repartitionByRange(files, *sort_keys) if files else out.repartitionByRange(*sort_keys)
        out = out.sortWithinPartitions(*sort_keys)
    out.write.mode("overwrite").options(**WRITE_OPTIONS).parquet(path)


def write_partitioned(
    df: DataFrame, root: str, partition_cols: Sequence[str], sort_keys: Sequence[str] = (), salt: int | None = None
) -> None:
    """Hive layout `col=value/`, sorted inside each file; a hot partition value is spread over several tasks.

    By default rows are range-partitioned on partition columns and sort keys, so the files of a partition follow one
    another in key order; choosing the ranges costs a sampling pass over `df`.  With `salt`, rows of one partition
    value go to `salt` tasks by a hash of the sort keys, without that pass: for keys whose order means nothing.
    """
    if not partition_cols:
        raise ValueError("at least one partition column is required")
    order = [*partition_cols, *sort_keys]
    out = _alphabetical(df)
    if salt is None:
        out = out.repartitionByRange(*order)
    else:
        out = out.repartition(*partition_cols, F.pmod(F.xxhash64(*sort_keys), F.lit(salt)))
    (
        out.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .options(**WRITE_OPTIONS)
        .partitionBy(*partition_cols)
        .parquet(root)
    )


MANIFEST = "number bigint, parts bigint, partition string, version string"


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """(number, version of each partition) of the newest whole manifest under `root`; (0, {}) before the first one.

    A manifest tells how many rows it has, so one that a failed or running write left unfinished is not followed.
    """
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException:
        return 0, {}
    whole = rows.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts")).filter("n = parts")
    newest = whole.agg(F.max("number").alias("number")).first()["number"]
    if newest is None:
        return 0, {}
    return newest, {r["partition"]: r["version"] for r in rows.filter(F.col("number") == newest).collect()}


def read_published(spark: SparkSession, root: str, column: str, only: Iterable[str] | None = None) -> DataFrame | None:
    """The published partitions, or those named in `only`, as the newest manifest has them; None if there are none."""
    held = manifest(spark, root)[1]
    wanted = held if only is None else set(only) & set(held)
    paths = [f"{root}/data/version={held[p]}/{column}={p}" for p in sorted(wanted)]
    return spark.read.option("basePath", f"{root}/data").parquet(*paths).drop("version") if paths else None


def publish_partitions(
    df: DataFrame, root: str, column: str, sort_keys: Sequence[str] = (), replace: bool = False,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> list[str]:
    """Publishes the partitions of `column` that `df` has, all or nothing, and returns them.

    They are written to a folder of their own; then one small manifest names, for every partition, the folder to read.
    Readers follow the newest manifest: they see the state before or the one after, and files in use are never replaced.  A
    write that fails leaves the old manifest in force; of two that run at once the later one raises.  Other partitions stay as
    they are unless `replace`.  Files are balanced by bytes (AQE), so a large partition is written by several tasks.  `finish`
    makes the written rows, one of each, after these are dealt and sorted: columns that follow from others need not be shuffled.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    number, held = manifest(spark, root)
    dealt = df.hint("rebalance", column).sortWithinPartitions(column, *sort_keys)
    write_layout(dealt if finish is None else finish(dealt), f"{root}/data/version={version}", [column])
    written = spark.read.schema(f"{column} string").option("basePath", f"{root}/data/version={version}").parquet(f"{root}/data/version={version}")
    touched = sorted(r[0] for r in written.select(column).distinct().collect())
    if wrong := [p for p in touched if not re.fullmatch(r"[A-Za-z0-9_.-]+", p or "")]:
        raise ValueError(f"{wrong[:3]} can not name a folder")
    state = {**({} if replace else held), **dict.fromkeys(touched, version)}
    rows = [(number + 1, len(state), p, v) for p, v in sorted(state.items())]
    if rows:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/{number + 1:012d}")
    return touched


def append_published(df: DataFrame, root: str, column: str, sort_keys: Sequence[str] = ()) -> list[str]:
    """Adds late rows: only the partitions they belong to are read and written anew."""
    touched = [r[0] for r in df.select(F.col(column).cast("string")).distinct().collect()]
    old = read_published(df.sparkSession, root, column, touched)
    return publish_partitions(df if old is None else old.unionByName(df), root, column, sort_keys)


def write_contract(
    tables: Mapping[str, DataFrame],
    root: str,
    sort_keys: Mapping[str, Sequence[str]],
    eval_tables: Iterable[str] = ("anomalies_groundtruth",),
) -> None:
    """Observable tables under `raw/`, the answer key physically apart under `eval/`."""
    apart = set(eval_tables)
    for name, df in tables.items():
        area = "eval" if name in apart else "raw"
        write_sorted(df, f"{root}/{area}/{name}.parquet", sort_keys.get(name, ()))


def content_hash(df: DataFrame, label: str) -> DataFrame:
    """Row count and sum of per-row hashes: equal for equal multisets of rows, whatever their order or layout.

    Sums of 48-bit hashes use DECIMAL(38,0) and cannot overflow.
    """
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(hash48(row).cast("decimal(20,0)")).cast("string").alias("hash_sum"),
    ).select(F.lit(label).alias("table"), "n_rows", "hash_sum")
