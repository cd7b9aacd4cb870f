"""Broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of files (as Catalyst sees them after column pruning) up to which a dimension is sent to every executor.
BROADCAST_LIMIT = 64 * 1024 * 1024
# Bytes that it may take in memory: the driver holds the rows it gets, the hash table, the smaller one that this grew from, and the blocks.
MEMORY_LIMIT = 256 * 1024 * 1024
# Files this much smaller than the limit are not opened: a key per row takes too much of them for more rows than fit.
UNOPENED = BROADCAST_LIMIT // 64
# Bytes of a row in a hash table: slot and null bits, each field, and what a string takes besides.
ROW_BYTES, FIELD_BYTES, STRING_BYTES = 40, 8, 16


def _leaves(df: DataFrame) -> list:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


def source_bytes(df: DataFrame) -> int:
    """Sum of Catalyst's size estimates of the plan's leaves: known from file listings, no job is run.

    The estimate of a join is the product of its sides, which says nothing about a lookup join; the leaves bound
    the data of any chain of projections, filters and N:1 lookups.
    """
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in _leaves(df))


def source_rows(df: DataFrame, enough: int | None = None) -> int:
    """Rows of the plan's Parquet leaves, from the footers of their files: no job is run.  Stops when it has more than `enough`."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    uri, path, parquet, rows = jvm.java.net.URI, jvm.org.apache.hadoop.fs.Path, jvm.org.apache.parquet.hadoop, 0
    opened, reader = parquet.util.HadoopInputFile.fromPath, parquet.ParquetFileReader.open
    for leaf in _leaves(df):
        relation = leaf.relation() if leaf.getClass().getSimpleName() == "LogicalRelation" else None
        if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
            continue
        for name in relation.location().inputFiles():
            footer = reader(opened(path(uri(name)), conf))
            rows += footer.getRecordCount()
            footer.close()
            if enough is not None and rows > enough:
                return rows
    return rows


def _fits_memory(dim: DataFrame, limit: int) -> bool:
    """Whether the rows of the sources, each as wide as a row of `dim`, stay within `limit` bytes of a hash table.

    Parquet tells little of that: repeated values take a few bits of a file, but their whole length in memory.
    """
    strings = sum(f.dataType.typeName() in ("string", "binary") for f in dim.schema)
    fit = limit // (ROW_BYTES + FIELD_BYTES * len(dim.columns) + STRING_BYTES * strings)
    return source_rows(dim, fit) <= fit


# Bytes of source files for each partition of a join of two facts, and the size Catalyst gives to what it knows nothing of.
PART_BYTES, UNKNOWN = 4 * 1024 * 1024, 1 << 60


def parted_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two facts, shuffled by `key` into partitions for about PART_BYTES of their files, one per core at least.

    Sorts and the roll-ups that follow within a partition take many times the bytes read: the number of partitions follows the
    input, so that what one task holds does not, whatever number or size of partitions the session is set to.  Where no files
    tell the size, the session decides.
    """
    size = source_bytes(a) + source_bytes(b)
    if size >= UNKNOWN:
        return a.join(b, key)
    n = max(-(-size // PART_BYTES), a.sparkSession.sparkContext.defaultParallelism)
    return a.repartition(n, key).join(b.repartition(n, key), key)


def bounded(dim: DataFrame, limit: int = BROADCAST_LIMIT, memory: int = MEMORY_LIMIT) -> DataFrame:
    """`dim` with a broadcast hint if its sources are within `limit` and its rows within `memory`; beyond, the join is shuffled.

    Files beyond `limit` leave it to Catalyst, which goes by bytes of files too: where only the rows are too many for `memory`, the
    merge join is named.  For dimension frames only: projections, filters and N:1 lookups over files, which never outgrow their leaves.
    """
    size = source_bytes(dim)
    if size > limit:
        return dim
    return F.broadcast(dim) if size <= UNOPENED or _fits_memory(dim, memory) else dim.hint("merge")
