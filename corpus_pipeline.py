"""The training-data pipeline: five stages over `documents`, each written as Parquet before the next reads it.

Near duplicates are those of `near_overlap` (five words, 0.8), not of the op4 query.  Documents that the mix takes more than
once come out as repeated rows.  There is no check SQL: the classifier, the fingerprints and the sampled
segmentations are beyond it; the tests compare a whole run with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import exact_dedup, mixing, near_overlap, quality_classifier, sentencepiece_codec
from tallyscope.llm.common import ascii_lower, stage, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.5 or more, by a model of their own labelled training rows."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_classifier.score_column(model, F.col("text")) >= 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    groups = exact_dedup.exact_groups(docs).groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    groups = stage(groups.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "_kept", "_n"), "exact")
    sha = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)

    def by(keys: DataFrame):
        return docs["doc_id"].eqNullSafe(keys["_id"]) & (sha == keys["_sha"])

    gone, repeated = groups.filter("NOT _kept"), groups.filter("_kept AND _n > 1")
    if repeated.isEmpty():
        return docs.join(gone, by(gone), "left_anti")
    # Rows of one doc_id whose texts are equal as the groups take them: one of them stays.
    other = groups.filter("NOT _kept OR _n > 1")
    once = docs.join(repeated, by(repeated), "left_semi").withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha")
    return docs.join(other, by(other), "left_anti").unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.8 of the five-word shingles in common) the row of the least doc_id."""
    gone = near_overlap.left_over(docs)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_h"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, as often as it takes them."""
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents but the text, its sampled piece ids, and whether they decode to it."""
    both = docs.select(
        *[c for c in docs.columns if c not in ("text", "piece_ids", "n_pieces", "lossless")],
        sentencepiece_codec.encoded_and_checked(F.col("text"), F.col("doc_id")).alias("piece_ids"),
    )
    lossless = F.col("piece_ids.lossless")
    return both.withColumn("lossless", lossless).withColumn("piece_ids", F.col("piece_ids.piece_ids")).withColumn("n_pieces", F.size("piece_ids"))


STAGES = [
    ("quality classifier", classify), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mix), ("SentencePiece", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
