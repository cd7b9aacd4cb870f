"""Exact dedup by content-defined chunk recipes, DataFrame functions only.

1. Every text (A-Z lower-cased, null as empty) is cut where its own content says so: a chunk has at least CHUNK_MIN
   characters, ends after the next line or sentence end, or after CHUNK_MAX characters.  An edit moves the cuts near it
   only, so documents that share passages share chunks.
2. A chunk's identifier is its 64-bit hash.  One aggregation per identifier over all chunks, combined on the map side,
   compares the chunk texts themselves (least and greatest text): an identifier is verified if they are equal.  Each
   distinct chunk of a task is moved once; whole documents are never moved.
3. A document's recipe is the ordered list of its identifiers.  Documents are equal when their recipes are equal; a
   recipe holding an identifier that failed verification is compared together with the SHA-256 of its whole text.

Recipes and hashes are written to the shared folder once; grouping and the join back work on these small rows.  A group
that holds a third of all rows is combined before the shuffle, and the join back is a plain equi-join that AQE splits.

Cases: null and empty texts are equal to each other.  Rows that repeat doc_id and text are members of their group, and
one of them stays.  A null doc_id sorts before all others.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import ascii_lower, stage

CHUNK_MIN, CHUNK_MAX = 512, 4096
CUT = rf"(?s).{{{CHUNK_MIN}}}[^\n.!?]{{0,{CHUNK_MAX - CHUNK_MIN - 1}}}.?|.+"


def chunks_of(norm):
    """Chunks whose concatenation is the text."""
    return F.regexp_extract_all(norm, F.lit(CUT), F.lit(0))


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, recipe, text_sha256) per row of `docs`."""
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    return norm.select(
        "doc_id",
        F.transform(chunks_of(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def unverified_ids(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk text (64-bit collisions; normally none)."""
    norm = docs.select(ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    chunk = norm.select(F.explode(chunks_of(F.col("norm"))).alias("chunk"))
    least = chunk.groupBy(F.xxhash64("chunk").alias("chunk_id")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return least.filter("lo != hi").select("chunk_id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id (largest doc_id of its group), group_size, kept, text_sha256."""
    recipes = stage(chunk_recipes(docs).withColumn("row", F.monotonically_increasing_id()), "recipes")
    bad = stage(unverified_ids(docs), "unverified")
    uses = recipes.select("row", F.explode("recipe").alias("chunk_id")).join(bad, "chunk_id", "left_semi")
    touched = uses.select("row").distinct().withColumn("wide", F.lit(True))
    keyed = recipes.join(touched, "row", "left").select(
        "doc_id", "row", "text_sha256", "recipe", F.when(F.col("wide"), F.col("text_sha256")).otherwise("").alias("tie"),
    )
    groups = keyed.groupBy("recipe", "tie").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    # Array keys are compared whole; the recipe's hash in front keeps sorting and hashing cheap.
    hashed = F.xxhash64("recipe", "tie")
    out = keyed.withColumn("rid", hashed).join(groups.withColumn("rid", hashed), ["rid", "recipe", "tie"])
    return out.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("top.row") == F.col("row")).alias("kept"), "text_sha256",
    )
