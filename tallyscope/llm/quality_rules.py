"""Quality rules as a short-circuit cascade, DataFrame functions only.

The base figures of a text are counted for every document.  The further rules form a cascade: on a bounded sample each
rule's cost (seconds of a job that evaluates only this rule, less those of an empty job) and selectivity (share it
rejects) are measured, and the rules are put in the order of rejection per cost.  The cascade is one CASE expression:
a document that a rule rejects is not seen by the rules behind it.  The order changes the time, never the verdict.

Cases: null and blank texts have no words and fail the base; one row comes out per row of the input, repeats included;
an empty table gives no rows and keeps the rules in their listed order; other columns are ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import SPACE_CLASS, SPACES, WORD_CLASS, stage, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
SAMPLE_ROWS = 2000  # rows, about, on which costs and selectivities are measured


def _removed(text: Column, chars: str) -> Column:
    """How many characters of `chars` the text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base figures.  Each step below is read more than once by the next, so Spark keeps them apart."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text")))
    d = d.withColumn(
        "n_words", F.size("w").cast("long")
    ).withColumn(
        "win",
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("w")
    # Windows with their places, in the order of their hashes; texts without an equal pair need none of it.
    d = d.withColumn(
        "by_hash",
        F.when(
            F.size(F.array_distinct("win")) < F.size("win"),
            F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("win")
    twice = F.filter(
        "by_hash",
        lambda p, k: (F.get("by_hash", k - 1)["h"].eqNullSafe(p["h"]) & (k > 0)) | F.get("by_hash", k + 1)["h"].eqNullSafe(p["h"]),
    )
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda p: p["i"]))).drop("by_hash")
    # Three words from each repeated start, less what the next start covers anyway.
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""))
    return d.select(
        "doc_id", "text", "n_words",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rejecting conditions over base_figures().  They compare integers, so that every engine agrees."""
    text, n = F.col("text"), F.col("n_words")
    upper = _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return {
        "symbols": F.col("n_symbols") > n,
        "dup_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "digits": 10 * _removed(text, "0123456789") > 3 * F.col("word_chars"),
        "capitals": 10 * upper > 6 * F.col("word_chars"),
        "no_letters": 2 * F.regexp_count(text, F.lit(rf"(?:^|{SPACE_CLASS})(?:(?!\p{{L}}){WORD_CLASS})++(?={SPACE_CLASS}|$)")) > n,
    }


def measured_order(docs: DataFrame, tests: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejection per second on a sample of about `sample_rows` rows."""
    n = docs.count()
    if n == 0:
        return list(tests)
    sample = stage(base_figures(docs.select("doc_id", "text").sample(min(1.0, sample_rows / n), seed=7)), "rule-sample")
    flags = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(c, 1)).alias(k) for k, c in tests.items()]).first()

    def seconds(cond: Column) -> float:
        took = []
        for _ in range(2):
            t0 = time.perf_counter()
            sample.filter(cond).agg(F.count(F.lit(1))).first()
            took.append(time.perf_counter() - t0)
        return min(took)

    idle = seconds(F.col("n_words") < -1)
    rank = {k: (flags[k] / max(1, flags["n"])) / max(1e-3, seconds(c) - idle) for k, c in tests.items()}
    return sorted(tests, key=lambda k: -rank[k])


def judge(docs: DataFrame, tests: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Base figures, base_failed, kept, and the rule that rejected the document (null if none, `base` for the base)."""
    tests = rules() if tests is None else tests
    figures = base_figures(docs)
    order = measured_order(docs, tests) if order is None else order
    verdict = F.when(base_failed(), F.lit("base"))
    for k in order:
        verdict = verdict.when(tests[k], F.lit(k))
    out = figures.withColumn("base_failed", base_failed()).withColumn("failed_rule", verdict)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("failed_rule").isNull().alias("kept"), "failed_rule",
    )
