"""Near duplicates of a corpus: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Groups of SimHash fingerprints, by the method of op4 (three words, at most 3 of 64 bits, pivot tables), give the first links: each
text meets the least one of its group and stays with it if the overlap holds.  A 64-bit SimHash has no radius that keeps all pairs
at 0.8, so what it leaves apart is looked for further.  There the fingerprint is the parity sketch of the shingle set: each shingle flips one of SKETCH_BITS bits, so the Hamming
distance of two sketches is never more than the number of shingles that only one text has, and at 0.8 that number
is at most a ninth of the two sizes together.  Hence a radius for each pair that loses nothing:

1. One narrow pass gives every text its node (hash of its words), SimHash, number of distinct shingles, sketch, pivot table row (the
   sketch's distances to PIVOTS reference sketches) and BANDS keys of ROWS minima each.  A pair at 0.8 shares a key with
   probability 1 - (1 - 0.8^ROWS)^BANDS > 0.9999.
2. Round one compares each node with the least node of its SimHash group and of its buckets: a large group of copies is one star.
   Further rounds do so with ABREAST other leaders each in buckets that still hold several components, as long as that merges any: a dense group comes
   together without its pairs being met.
3. The last round meets nodes of one bucket that are not in one component yet, each pair under the first bucket it
   shares.  Pairs whose pivot coordinates differ by more than
   their radius anywhere are discarded (triangle inequality), then those whose sketches do; both are conditions of the join, as
   are the sizes, so that only pairs close to the threshold come out of it.  No bucket is capped.
4. Every survivor is verified by the overlap of the shingle sets, which are made for nodes in shared buckets only.

Cases: null and blank texts are equal to each other; texts under five words are one shingle; case (A-Z) and spacing do
not count; rows without doc_id take part and sort behind the others; of tied rows (one doc_id in a group) the one of the
least text hash stays, once per repeat; columns of any other name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import small_batches, stage
from tallyscope.llm.simhash import SEED, components, fingerprint, fingerprint_groups

SHINGLE = 5
BANDS, ROWS = 25, 5
SKETCH_BITS, PIVOTS = 2048, 16
LEADERS, ABREAST = 2, 3  # rounds of stars at most, and leaders of a bucket in each; what they leave apart is met in pairs
CHUNK = 1 << 12  # shingles hashed by all functions at a time
_LONGS = SKETCH_BITS // 64
# Reference sketches from a fixed rule: none, and those of the shingles that a hash of their bit's place selects.
_REFERENCES = np.array([[0] * _LONGS] + [[xxhash.xxh64_intdigest(f"reference {i} {j}") for j in range(_LONGS)] for i in range(1, PIVOTS)], np.uint64)
_FACTORS = np.array([xxhash.xxh64_intdigest(f"minimum {i}") | 1 for i in range(BANDS * ROWS)], np.uint64)[:, None]


def shingle_set(text: str | None) -> tuple[int, np.ndarray]:
    """(node, distinct shingle hashes) of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six spaces only
    joined, n = b" ".join(tokens), max(1, len(tokens) - SHINGLE + 1)
    ends, at = [], 0
    for t in tokens:
        ends.append(at + len(t))
        at += len(t) + 1
    starts = [0, *[e + 1 for e in ends]][:n]
    ends = ends[min(SHINGLE, len(tokens)) - 1 :] or [0]
    digest = xxhash.xxh64_intdigest
    return digest(joined), np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def sketch_of(text: str | None) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(node, shingles, parity sketch, pivot distances, band keys), unsigned."""
    node, h = shingle_set(text)
    flips, least = np.zeros(SKETCH_BITS, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK]
        flips += np.bincount((part >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
        np.minimum(least, (part * _FACTORS).min(axis=1), out=least)
    sketch = np.packbits((flips & 1).astype(bool), bitorder="little").view("<u8")
    far = np.bitwise_count(sketch ^ _REFERENCES).sum(axis=1)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i) for i in range(BANDS)]
    return node, len(h), sketch, far, np.array(keys, np.uint64)


LONGS = T.ArrayType(T.LongType())
SKETCH = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", LONGS),
    T.StructField("far", T.ArrayType(T.ShortType())), T.StructField("bands", LONGS), T.StructField("fp", T.LongType())])
SET = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", LONGS)])


@F.pandas_udf(SKETCH)
def sketches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        rows = [sketch_of(x) for x in t]
        yield pd.DataFrame({
            "node": np.array([r[0] for r in rows], np.uint64).view(np.int64), "n": np.array([r[1] for r in rows], np.int32), "sketch": [r[2].view(np.int64) for r in rows],
            "far": [r[3].astype(np.int16) for r in rows], "bands": [r[4].view(np.int64) for r in rows],
            "fp": np.array([fingerprint(x) for x in t], np.uint64).view(np.int64)})


@F.pandas_udf(SET)
def sets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        rows = [shingle_set(x) for x in t]
        yield pd.DataFrame({"node": np.array([r[0] for r in rows], np.uint64).view(np.int64), "shingles": [r[1].view(np.int64) for r in rows]})


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (lo, hi) whose sets have 0.8 of their union in common."""
    a = found.select(F.col("node").alias("lo"), F.col("shingles").alias("s"))
    b = found.select(F.col("node").alias("hi"), F.col("shingles").alias("u"))
    common = F.size(F.array_intersect("s", "u"))
    return pairs.join(a, "lo").join(b, "hi").filter(9 * common >= 4 * (F.size("s") + F.size("u"))).select("lo", "hi")


def within_reach(a: str, b: str) -> Column:
    """Whether two nodes can reach 0.8: by their sizes, pivot tables and sketches, none of which loses such a pair."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    radius = F.floor((small + large) / 9)  # the shingles that only one of them may have
    coordinates = [F.abs(F.get(f"{a}.far", F.lit(i)).cast("int") - F.get(f"{b}.far", F.lit(i)).cast("int")) for i in range(PIVOTS)]
    apart = sum(F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(_LONGS))
    return (5 * small >= 4 * large) & (F.greatest(*coordinates) <= radius) & (apart <= radius)


def merged(own: DataFrame, links: DataFrame) -> DataFrame:
    """`own` (node, component) after further links between nodes; only components meet, not their nodes."""
    of = own.withColumnsRenamed({"node": "_n", "component": "_c"})
    ends = links.join(of, F.col("lo") == F.col("_n"), "left").select(F.coalesce("_c", "lo").alias("a"), "hi")
    ends = ends.join(of, F.col("hi") == F.col("_n"), "left").select("a", F.coalesce("_c", "hi").alias("b")).filter("a != b")
    into = stage(components(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()), "merges")
    into = into.withColumnsRenamed({"node": "_n", "component": "_c"})
    alone = into.join(own, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_n").alias("component"))
    every = own.unionByName(alone).join(into, F.col("component") == F.col("_n"), "left")
    return stage(every.select("node", F.coalesce("_c", "component").alias("component")), "components")


def near_rows(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, _h (hash of the text as it stands) and component (one per group of near duplicates)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    rows = stage(texts.select("doc_id", "_h", sketches(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "_h", "s.*"), "sketches")
    nodes = rows.dropDuplicates(["node"])
    keyed = stage(nodes.select("node", F.posexplode("bands").alias("at", "key")), "band-keys")
    leads = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).filter("lead != _last").drop("_last")
    members = stage(keyed.join(leads, "key"), "buckets")

    # The SimHash groups: each node with the least one of its group.
    placed = stage(fingerprint_groups(nodes.groupBy("fp").agg(F.min("node").alias("first"))), "simhash-groups")
    heads = placed.groupBy("component").agg(F.min("first").alias("lo"))
    alike = nodes.select("fp", F.col("node").alias("hi")).join(placed, "fp").join(heads, "component").filter("lo != hi").select("lo", "hi")
    alike = stage(alike, "alike")

    both = members.select("node").union(alike.select(F.explode(F.array("lo", "hi"))))
    wanted = rows.join(both.distinct(), "node", "left_semi").dropDuplicates(["node"]).select("doc_id", "_h")
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"))
    those = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["_h"] == wanted["_k"]), "left_semi")
    found = those.select(sets(F.coalesce("text", F.lit(""))).alias("s")).select("s.*").dropDuplicates(["node"])
    found = stage(found, "shingle-sets")

    stars = members.filter("node != lead").select(F.col("lead").alias("lo"), F.col("node").alias("hi")).union(alike).distinct()
    own = stage(components(verified(stars, found)), "components")

    def still_open(m: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with their component."""
        m = m.drop("component").join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
        keys = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
        return m.join(keys, "key", "left_semi")

    m = stage(still_open(members.drop("lead")), "open-members")
    seen = nodes.select("node", "n", "sketch", "far", "bands").join(m.select("node").distinct(), "node", "left_semi")
    m = stage(m.join(seen, "node"), "open-buckets")
    for turn in range(LEADERS):
        chosen = [F.min_by(F.struct("node", "n", "sketch", "far", "component"), F.xxhash64("node", F.lit(ABREAST * turn + i))) for i in range(ABREAST)]
        lead = m.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("_b")).select("key", F.explode("_b").alias("b"))
        met = m.alias("a").join(lead, "key").filter((F.col("a.component") != F.col("b.component")) & within_reach("a", "b"))
        met = met.select(F.least("a.node", "b.node").alias("lo"), F.greatest("a.node", "b.node").alias("hi")).distinct()
        more = stage(verified(met, found), "star-links")
        if more.isEmpty():
            break
        own = merged(own, more)
        m = stage(still_open(m), "open-buckets")
    a, b = m.alias("a"), m.alias("b")
    earlier = [(F.col("a.at") > i) & (F.get("a.bands", F.lit(i)) == F.get("b.bands", F.lit(i))) for i in range(BANDS - 1)]
    first = ~reduce(operator.or_, earlier)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & within_reach("a", "b") & first)
    last = stage(verified(met.select(F.col("a.node").alias("lo"), F.col("b.node").alias("hi")), found), "last-links")
    if not last.isEmpty():
        own = merged(own, last)
    return rows.join(own, "node", "left").select("doc_id", "_h", F.coalesce("component", "node").alias("component"))


def left_over(docs: DataFrame) -> DataFrame:
    """(_id, _h) of the rows to leave out: all of a component but the one of the least doc_id."""
    rows = stage(near_rows(docs), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")
    kept = rows.groupBy("component").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("_h") == F.col("keep._h"))
    gone = rows.join(kept, "component").filter(~same)
    return gone.select(F.col("doc_id").alias("_id"), "_h").distinct()
