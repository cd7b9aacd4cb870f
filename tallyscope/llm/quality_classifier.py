"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Fitting reads a bounded, documented sample of the labelled training rows: per class the DICT_ROWS rows of lowest hash
train a dictionary (from PIECE characters of each, at a hashed place), CALIBRATION_ROWS other rows calibrate.  A text is
compressed whole with both dictionaries; the difference of the two sizes, normalised by the length and by the larger
size, with the compression ratio and the length that it depends on, goes into a logistic fit.  Rows are weighted so that
the classes count as often as among all training labels.

The fit's input goes through the driver and is bounded by the parameters; scoring is one narrow pass over all texts.

Cases: null texts count as empty and get a score too; labels without a document, null labels and rows of the held-out
fold are not learned from; of a doc_id with several labels or texts the lowest counts; without rows of both classes every score is 0.5;
an empty table gives no rows; columns other than doc_id and text are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICT_ROWS, PIECE, DICT_BYTES = 1000, 8192, 112640
CALIBRATION_ROWS = 3000
LEVEL = 3
FOLDS, HELD_OUT = 3, 1


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes]  # of bad and of good text
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self):
        size = sizer(self.dictionaries)
        return lambda texts: self.scores(np.array([size(t) for t in texts], dtype=float).reshape(-1, 3))

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        x = (features(sizes) - self.mean) / self.scale
        z = np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


def sizer(dictionaries: tuple[bytes, bytes]):
    """text -> (bytes with the bad dictionary, bytes with the good one, plain bytes)."""
    packers = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw) if raw else None
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def size(text: str | None) -> tuple[int, int, int]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return len(packers[0].compress(raw)), len(packers[1].compress(raw)), len(raw)

    return size


def features(sizes: np.ndarray) -> np.ndarray:
    bad, good, plain = sizes.T
    diff, by_larger = (bad - good) / np.maximum(plain, 1), (bad - good) / np.maximum(np.maximum(bad, good), 1)
    ratio = good / np.maximum(plain, 1)
    return np.column_stack([diff, by_larger, ratio, np.log1p(plain), diff**2, by_larger**2, ratio**2])


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; of too few pieces to train on, their plain content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICT_BYTES]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column of x is the constant."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * len(y) ** 0.5 * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - penalty * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the training fold; None if a class has no rows."""
    usable = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        for role, keep, n in (("dict", 0, DICT_ROWS), ("fit", 1, CALIBRATION_ROWS)):
            part = usable.filter((F.col("quality") == q) & (F.pmod("h", F.lit(2)) == keep)).orderBy("h", "doc_id").limit(n)
            part = part.select("doc_id", "quality", F.lit(role).alias("role"))
            picked = part if picked is None else picked.unionByName(part)
    # At most 2 * (DICT_ROWS + CALIBRATION_ROWS) rows: small enough to send to every task whatever the corpus.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1)
    pieces = rows.filter("role = 'dict'").select("doc_id", "quality", F.substring("text", start.cast("int"), F.lit(PIECE)).alias("piece"))
    pieces = pieces.groupBy("doc_id", "quality").agg(F.min("piece").alias("piece"))
    pieces = [(r["quality"], r["piece"].encode("utf-8", "surrogatepass")) for r in pieces.orderBy("doc_id").collect()]
    pair = tuple(dictionary([p for k, p in pieces if k == q]) if any(k == q for k, _ in pieces) else b"" for q in (0, 1))

    @F.pandas_udf("bad long, good long, plain long")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        size = sizer(pair)
        for t in texts:
            yield pd.DataFrame([size(x) for x in t], columns=["bad", "good", "plain"])

    fit = rows.filter("role = 'fit'").select("doc_id", "quality", measured("text").alias("m"))
    fit = fit.groupBy("doc_id", "quality").agg(F.min("m").alias("m")).orderBy("doc_id").collect()
    y = np.array([r["quality"] for r in fit], dtype=float)
    if len(set(y)) < 2:
        return None
    x = features(np.array([tuple(r["m"]) for r in fit], dtype=float))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    seen = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    total = counts[0] + counts[1]
    w = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0]) * len(y) / total
    return Model(pair, mean, scale, logistic(x, y, w))


def score_column(model: Model | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model.scorer()
        for t in texts:
            yield pd.Series(run(t), dtype=float)

    return scored(text)


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
