"""SimHash near-dedup with pivot distance tables.

1. Fingerprints: one narrow pass; the bits of all shingle hashes of a text are counted in numpy.
2. Equal fingerprints become one node, named by the fingerprint and combined before the shuffle: copies, a third of all
   rows or not, are never paired with each other.  The least doc_id of a component is taken at the end.
3. Candidates: two fingerprints that differ in at most 3 bits agree in at least 3 of 6 blocks, so they meet under one of
   the 20 keys made of 3 blocks.  Each node carries its pivot table row, its Hamming distances to PIVOTS reference
   fingerprints; by the triangle inequality a pair whose coordinates differ by more than 3 anywhere is discarded, and the
   survivors are verified by their own distance.  Both are conditions of the join itself, so that only links come out,
   each once: under the first key that its two ends share.  The join is a plain equi-join whose hot keys AQE splits.
4. Components: large-star and small-star rounds over the links, each half written to the shared folder, until all are stars.
   A half is a short plan of its own: nested, each would be planned, compiled and kept by the driver several times over.

No link between different fingerprints is lost and no bucket is capped.

Cases: null and blank texts have fingerprint zero and are linked like any other; a null doc_id is a row of its own whose
component is the least doc_id reachable from its fingerprint, null if there is none, and through which others are linked as through any; rows that repeat are kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import small_batches, stage

SHINGLE = 3
SEED = 42  # fixed value of the contract: XXH64 with seed 42
MAX_BITS = 3
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
PIVOTS = 16
CHUNK = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: str | None) -> int:
    """The SimHash of one text, unsigned."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six spaces only
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(SHINGLE, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series(np.array([fingerprint(x) for x in t], np.uint64).view(np.int64))


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, from a fixed rule: the signed XXH64 of their numbers."""
    return [xxhash.xxh64_intdigest(f"pivot {i}") - (1 << 63) for i in range(n)]


def _ones(value: int) -> int:
    """A 64-bit mask as Spark's signed long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def block_masks() -> list[int]:
    masks, at = [], 0
    for bits in BLOCK_BITS:
        masks.append(_ones(((1 << bits) - 1) << at))
        at += bits
    return masks


def _packed(fp: Column, references: list[int]) -> Column:
    """The distances to eight references, a byte each, as one long: a row of the pivot table takes two."""
    whole = F.lit(0).cast("bigint")
    for i, p in enumerate(references):
        whole = whole.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i))
    return whole


def _distance(packed: str, i: int) -> Column:
    return F.shiftright(packed, 8 * i).bitwiseAND(F.lit(255)).cast("int")


def tables() -> list[tuple[int, int, int]]:
    """Of each of the 20 tables: the mask of its three blocks, the blocks as bits, and those up to its last one."""
    masks, out = block_masks(), []
    for triple in combinations(range(len(masks)), 3):
        mask = 0
        for b in triple:
            mask |= masks[b] & ((1 << 64) - 1)
        out.append((_ones(mask), sum(1 << b for b in triple), (1 << (triple[-1] + 1)) - 1))
    return out


def keyed(nodes: DataFrame) -> DataFrame:
    """20 rows per node: table number, key (the bits of its three blocks), node, pivot distances."""
    fp, p = F.col("fp"), pivots()
    rows = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), fp.bitwiseAND(F.lit(mask)).alias("key")) for t, (mask, _, _) in enumerate(tables())])
    d = nodes.select("node", "fp", *[_packed(fp, p[i : i + 8]).alias(f"p{i // 8}") for i in range(0, PIVOTS, 8)])
    return d.withColumn("k", F.explode(rows)).select("*", "k.*").drop("k")


def links(nodes: DataFrame) -> DataFrame:
    """(lo, hi): pairs of nodes whose fingerprints differ in 1 to MAX_BITS bits, each once.  nodes: (node, fp), of one fingerprint each."""
    d = keyed(nodes)
    a, b = d.alias("a"), d.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # Blocks in which the two agree, up to the last block of this key: exactly the key's own for the first shared key.
    zero = None
    for i, m in enumerate(block_masks()):
        bit = F.when(diff.bitwiseAND(F.lit(m)) == 0, 1 << i).otherwise(0)
        zero = bit if zero is None else zero + bit
    agree, upto = (F.get(F.array(*[F.lit(x[i]) for x in tables()]), F.col("a.t").cast("int")) for i in (1, 2))
    far = F.greatest(*[F.abs(_distance(f"a.p{i // 8}", i % 8) - _distance(f"b.p{i // 8}", i % 8)) for i in range(PIVOTS)])
    near = (far <= MAX_BITS) & (F.bit_count(diff) <= MAX_BITS) & (zero.bitwiseAND(upto) == agree)
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node"))
    return a.join(b, same & near).select(F.col("a.node").alias("lo"), F.col("b.node").alias("hi"))


def large_star(e: DataFrame) -> DataFrame:
    """Links of every node's larger neighbours to the least of all its neighbours and itself."""
    ends = F.inline(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v"))))
    least = e.select(ends).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return e.join(least, e["lo"] == least["u"]).select(F.col("m").alias("lo"), "hi").distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Links of every node and its smaller neighbours to the least of these."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
    moved = e.join(least, e["hi"] == least["u"]).select(F.inline(F.array(
        F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")))))
    return moved.filter("lo != hi").distinct()


def all_stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or linked to one centre only: what the rounds leave as it is."""
    ends = F.inline(F.array(F.struct(F.col("lo").alias("u"), F.lit(0).alias("leaf")), F.struct(F.col("hi").alias("u"), F.lit(1).alias("leaf"))))
    both = e.select(ends).groupBy("u").agg(F.sum("leaf").alias("of"), F.min("leaf").alias("least"))
    return both.filter("of > 1 OR of = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.  edges: (lo, hi), lo < hi."""
    now = stage(edges, "links")
    for _ in range(max_rounds):
        if all_stars(now):
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        now = stage(small_star(stage(large_star(now), "large-star")), "small-star")
    raise RuntimeError("components did not settle")


def fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(…columns of nodes, component) of distinct fingerprints (fp, …): the least node reachable over links."""
    nodes = nodes.withColumn("node", F.col("fp"))
    return nodes.join(components(links(nodes.select("node", "fp"))), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def near_groups(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id (least doc_id reachable) and the columns named in `carry`."""
    small_batches(docs.sparkSession)
    fps = stage(docs.select("doc_id", *carry, fingerprints(F.coalesce("text", F.lit(""))).alias("fp")), "fingerprints")
    placed = fingerprint_groups(stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes"))
    # The nodes of a large component are combined before they meet: one row per task.
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(ids, "component").select("fp", "component_id")
    out = fps.join(of_fp, "fp", "left")
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", *carry)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
