"""Packing of tokenised documents into sequences: dominance reduction, then best fit of the remainder.

1. One narrow pass tokenises every document and cuts it into pieces of at most CAPACITY tokens; a piece carries its task and
   its number among the task's pieces of the same length, so that pieces are ranked per length without a window.
2. The instance is the number of pieces per length: at most CAPACITY numbers, however many documents there are.
   `reduce_instance` fixes sets that provably dominate every alternative for their longest piece, a whole length at a time;
   `best_fit` packs the remainder by falling length into the fullest bin that takes it.  Both give patterns with multiplicities, whose
   number is bounded by the lengths and not by the pieces.
3. Each piece finds its place in the patterns by its rank within its length.

Dominance (Martello and Toth): a set of pieces with j dominates another one if the others of the second can be dealt into
blocks none of which is longer than a piece of the first.  Some best packing then has the first set as a sequence, so it is fixed:
  j with r, if no choice of other pieces that fits beside j is longer than r (r alone fills the gap best, exactly or not; r may be missing);
  j with a and b, if at most two others fit beside j and all of those that do are dominated by {a, b}.

Cases: a null text is an empty one, which has the end id only; a null doc_id stays null; repeated rows are packed each; a long
text is cut into full pieces behind a shorter first one; ties between lengths do not matter, those between equal pieces are
broken by their place in the table; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import small_batches, stage

CAPACITY, END = 1024, 2  # fixed values of the contract
Pattern = tuple[tuple[int, int], ...]  # (length, copies), falling


# --- the instance: pieces per length


def reachable(counts: dict[int, int], cap: int) -> int:
    """Bit s is set if some choice of pieces has s tokens together, for s up to cap."""
    bits, mask = 1, (1 << (cap + 1)) - 1
    for length, count in counts.items():
        count = min(count, cap // length)
        step = 1
        while count > 0:  # the count in powers of two
            step = min(step, count)
            bits |= (bits << (length * step)) & mask
            count -= step
            step *= 2
    return bits


def _pair_beside(counts: dict[int, int], gap: int) -> tuple[int, ...] | None:
    """(a, b) that dominate all choices of at most two others beside a piece that leaves `gap`, or None."""
    sizes = sorted(s for s, c in counts.items() if c and s <= gap)
    a = sizes[-1]
    rest = [s for s in sizes if s <= gap - a and counts[s] > (s == a)]
    if not rest:
        return None
    b = rest[-1]
    for y in sizes:  # a pair x >= y that neither fits into (a, b) piece by piece nor as one block into a
        if y > b:
            for x in sizes:
                if x >= y and a < x + y <= gap and (x != y or counts[x] > 1):
                    return None
    return a, b


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """(patterns that are fixed, with multiplicities; what is left of the instance)."""
    left, fixed, again = {s: c for s, c in counts.items() if c}, [], True

    def fix(pieces: tuple[int, ...]) -> None:
        # Taking pieces away leaves fewer alternatives, so the set stays dominant while all of its pieces are left.
        need = {s: pieces.count(s) for s in pieces}
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))

    while again:
        again = False
        for j in sorted(left, reverse=True):
            while j in left:
                gap = capacity - j
                others = {s: c - (s == j) for s, c in left.items() if s <= gap and c > (s == j)}
                if gap in others:
                    choice: tuple[int, ...] | None = (gap,)
                else:
                    most = reachable(others, gap).bit_length() - 1
                    choice = () if not most else (most,) if most in others else None
                    small = sorted(s for s, c in others.items() for _ in range(min(c, 3)))[:3]
                    if choice is None and (len(small) < 3 or sum(small) > gap):
                        choice = _pair_beside(others, gap)
                if choice is None:
                    break
                fix((j, *choice))
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Best fit by falling length, equal bins at a time: the fullest bins that a piece fits take it."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}  # room -> patterns and how many bins have them

    for s in sorted(counts, reverse=True):
        m = counts[s]
        while m:
            room = min((r for r in bins if r >= s), default=None)
            if room is None:  # new bins, each as full of s as it gets
                each = capacity // s
                groups, room = [((), m // each), ((), int(m % each > 0))], capacity
            else:
                groups = bins.pop(room)
            for pattern, n in groups:
                each = room // s
                full = min(n, m // each)
                some = int(full < n and 0 < m - full * each)
                for k, times in ((each, full), (m - full * each, some), (0, n - full - some)):
                    if times:
                        bins.setdefault(room - k * s, []).append((pattern + ((s, k),) if k else pattern, times))
                        m -= k * times
    return [p for groups in bins.values() for p in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns (length, copies) and how many sequences have each."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Runs of pieces by (length, first rank): columns length, first, sequence, copies, offset.

    Pieces of one length fill the runs in the order of their ranks: `copies` of them in each of the run's sequences.
    """
    rows, sequence, rank = [], 0, {}
    for pattern, times in patterns:
        at = 0
        for length, copies in pattern:
            first = rank.get(length, 0)
            rows.append((length, first, sequence, copies, at))
            rank[length] = first + copies * times
            at += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- over the rows


def tokenizer_files() -> str:
    """Folder of the public vocabulary files: the setting TOKENIZERS_DIR, else where this machine keeps them."""
    if os.environ.get("TOKENIZERS_DIR"):
        return os.environ["TOKENIZERS_DIR"]
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=2)
def encoder(folder: str) -> Callable[[str], list[int]]:
    """Text -> ids of byte_bpe_50k, strings of special tokens taken as ordinary text.

    The ranks file holds the vocabulary and merges of byte_bpe_50k.json and is encoded five times as fast; the tests compare
    the ids with those of the json file.
    """
    import public_tokenizers
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cuts(n: int, capacity: int) -> Iterable[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones behind a first one that may be shorter."""
    at = n % capacity
    if at:
        yield 0, at
    for start in range(at, n, capacity):
        yield start, capacity


PIECE = "doc_id {}, piece int, start long, length int, ids binary, ids_crc32 long, task int, number long"


def pieces_of_task(folder: str, capacity: int, end: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(folder), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    rows.append((i, piece, start, length, raw, zlib.crc32(raw), int(seen[length])))
                    seen[length] += 1
            at, piece, start, length, raw, crc, number = zip(*rows) if rows else ([],) * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())).cast(id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                 pa.array(raw, pa.binary()), pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(number, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "number"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer_dir: str | None = None) -> DataFrame:
    """Every document as its pieces: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian), ids_crc32, task, number."""
    small_batches(docs.sparkSession, "1m")
    kind = docs.schema["doc_id"].dataType
    narrow = docs.select("doc_id", "text")
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    if not isinstance(kind, (T.LongType, T.IntegerType)):
        kind, narrow = T.StringType(), narrow.withColumn("doc_id", F.col("doc_id").cast("string"))
    run = pieces_of_task(tokenizer_dir or tokenizer_files(), capacity, end, arrow)
    return stage(narrow.mapInArrow(run, PIECE.format(kind.simpleString())), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (rows of `pieces`) with sequence_id and offset: gapless from 0 in every sequence."""
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = stage(by_task, "pieces-by-task")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slots(plan(counts, capacity))
    lengths, firsts = runs[:, 0], runs[:, 1]
    begins = {int(s): int(i) for s, i in zip(*np.unique(lengths, return_index=True))}
    ends = {int(s): int(i) for s, i in zip(lengths, range(1, len(lengths) + 1))}

    @F.pandas_udf("sequence_id long, offset int")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:  # the run of each piece, by its length and rank
        size, r, at = length.to_numpy(np.int64), rank.to_numpy(np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(size):
            here, lo = size == s, begins[int(s)]
            at[here] = lo + np.searchsorted(firsts[lo : ends[int(s)]], r[here], "right") - 1
        into, copies = r - firsts[at], runs[at, 3]
        return pd.DataFrame({"sequence_id": runs[at, 2] + into // copies, "offset": (runs[at, 4] + into % copies * size).astype(np.int32)})

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("n").over(earlier) - F.col("n")
    bases = by_task.select("length", "task", before.alias("base"))
    placed = cut.join(bases, ["length", "task"]).withColumn("seat", seat(F.col("length"), F.col("base") + F.col("number")))
    return placed.select(*[c for c in cut.columns if c not in ("task", "number")], "seat.sequence_id", "seat.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (unsigned 32-bit, little-endian), the doc_ids in order.  A sequence has at most CAPACITY pieces."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(rows.alias("rows"))
    return whole.select(
        "sequence_id", F.aggregate("rows", F.lit(0), lambda n, r: n + r["length"]).alias("n_tokens"),
        F.aggregate("rows", F.lit(b""), lambda s, r: F.concat(s, r["ids"])).alias("ids"), F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer_dir: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    return place(pieces(docs, capacity, end, tokenizer_dir), capacity)
