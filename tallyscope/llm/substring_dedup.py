"""Substring dedup of 13-word windows behind a count-min prefilter.

1. Sketch.  Every task hashes its windows, each once per document, and marks DEPTH cells per window in slices of a
   bitmap; blobs of touched cells are merged slice by slice, in a stream.  A cell counts how many blobs touched it and
   whether one blob touched it twice, so the merged counts never underestimate: a window that two documents share has
   all its cells at two or more.  Sketches grow with the input up to MAX_CELL_BITS; beyond that more unique windows pass
   the filter, and the result stays the same.
2. Windows estimated repeated, and only they, are grouped by 96 bits of hash (64 of the window's polynomial hash, 32 of
   an independent one), which finds the least doc_id in which each starts.  Every task combines before the shuffle: of
   its documents with a window only the least stays open, the others are decided; so a window that a third of all
   documents hold is one row per task in its group.
3. The starts found, per document, meet the texts again on doc_id; a text's covered words are removed in numpy.  A bitmap
   of hashed doc_ids, of fixed size, keeps most other texts from moving.

What goes through the driver and is broadcast are the merged bitmaps: DEPTH * 2**MAX_CELL_BITS bits at most, 128 MB.

Cases: null texts have no words; texts below 13 words are left alone; a row without doc_id neither loses words nor makes
others lose any; rows that repeat a doc_id are one document with several texts: they do not lose words to each other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import small_batches, stage

WINDOW = 13
DEPTH = 2
MIN_CELL_BITS, MAX_CELL_BITS, SLICE_BITS = 20, 29, 20
FLUSH = 4_000_000  # windows that a task gathers before it gives out a blob
COMBINE = 1_000_000  # candidate windows that a task gathers before it combines them
BASE = 0x9E3779B97F4A7C15
SALTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Powers:
    """BASE**i and BASE**-i modulo 2**64, as far as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            step = np.full(n, BASE, np.uint64)
            back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(text: str | None, powers: Powers):
    """(words joined by a space, starts, ends, hashes) of all windows; None below WINDOW words.

    The hash of a window is the polynomial hash of its bytes, from prefix sums over the joined text.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if len(tokens) < WINDOW:
        return None
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(tokens) - WINDOW + 1]
    ends = ends[WINDOW - 1 :]
    up, down = powers.upto(len(joined) + 1)
    prefix = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=prefix[1:])
    return joined, starts, ends, mix((prefix[ends] - prefix[starts]) * down[starts])


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h ^ np.uint64(SALTS[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def _gather(bits: int):
    """Batches of (doc_id, text) to blobs: row, slice, touched cells, cells touched twice."""

    def run(batches):
        powers, pack = Powers(), zstandard.ZstdCompressor(level=1)
        held, n = [], 0
        width = min(bits, SLICE_BITS)

        def coded(cell):
            """Gaps of the sorted cells, byte by byte: the low bytes are nearly random, the others nearly all zero."""
            gaps = np.diff(cell & np.uint32((1 << width) - 1), prepend=np.uint32(0))
            return pack.compress(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())

        def blobs():
            h = np.concatenate(held)
            edges = np.arange((1 << (bits - width)) + 1, dtype=np.uint64) << np.uint64(width)
            for row in range(DEPTH):
                c = np.sort(cells(h, row, bits))
                first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                times, c = np.diff(np.r_[first, len(c)]), c[first]
                again = c[times > 1]
                at = np.searchsorted(c, edges)
                at2 = np.searchsorted(again, edges)
                for s in range(1 << (bits - width)):
                    if at[s] < at[s + 1]:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row], pa.int32()), pa.array([s], pa.int32()), pa.array([coded(c[at[s] : at[s + 1]])], pa.binary()),
                            pa.array([coded(again[at2[s] : at2[s + 1]]) if at2[s] < at2[s + 1] else None], pa.binary()),
                        ], names=["row", "slice", "once", "twice"])

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                w = windows(text, powers) if doc is not None else None
                if w is not None:
                    held.append(np.unique(w[3]))
                    n += len(held[-1])
                    if n >= FLUSH:
                        yield from blobs()
                        held, n = [], 0
        if n:
            yield from blobs()

    return run


def _merge(width: int):
    """Blobs in the order of row and slice to one row each: the cells counted at least twice."""

    def run(batches):
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        at, seen, twice = None, None, None

        def done():
            blob = pack.compress(np.packbits(twice).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([blob], pa.binary())], names=["row", "slice", "twice"])

        def cells_of(blob):
            raw = np.frombuffer(unpack.decompress(blob), np.uint8)
            return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)

        for b in batches:
            for row, part, once, again in zip(*(b[c].to_pylist() for c in ("row", "slice", "once", "twice"))):
                if (row, part) != at:
                    if at is not None:
                        yield done()
                    at = (row, part)
                    seen, twice = np.zeros(1 << width, bool), np.zeros(1 << width, bool)
                c = cells_of(once)
                twice[c] |= seen[c]
                seen[c] = True
                if again is not None:
                    twice[cells_of(again)] = True
        if at is not None:
            yield done()

    return run


def sketch(docs: DataFrame) -> tuple[int, list[tuple[int, int, bytes]]]:
    """(cell bits, merged slices).  The cells are about four per word of the corpus, within the two bounds."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MAX_CELL_BITS, max(MIN_CELL_BITS, int(4 * chars // 6).bit_length()))
    width = min(bits, SLICE_BITS)
    blobs = docs.select("doc_id", "text").mapInArrow(_gather(bits), "row int, slice int, once binary, twice binary")
    merged = blobs.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInArrow(
        _merge(width), "row int, slice int, twice binary")
    return bits, [tuple(r) for r in merged.collect()]


class Filter:
    """The merged sketch in a worker."""

    def __init__(self, bits: int, slices):
        self.bits, unpack = bits, zstandard.ZstdDecompressor()
        n = (1 << min(bits, SLICE_BITS)) // 8
        self.twice = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
        for row, part, twice in slices:
            self.twice[row][part * n : (part + 1) * n] = np.frombuffer(unpack.decompress(twice), np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places of the windows estimated repeated."""
        at = np.arange(len(h))
        for row in range(DEPTH):
            c = cells(h[at], row, self.bits)
            at = at[(self.twice[row][c >> np.uint32(3)] >> (np.uint32(7) - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1]
        return at


_FILTERS: dict = {}  # the filter of the sketch last used in this worker


def _starts(bits: int, shared):
    """Batches of (doc_id, part, text) to candidate windows, combined per task.

    Of the documents of a task that hold a window only the least stays open and gives a row (k, c, place); the windows of
    the others surely start in a smaller document, and their places come in one row per document, `done`.
    """

    def run(batches):
        if shared.id not in _FILTERS:
            _FILTERS.clear()
            _FILTERS[shared.id] = Filter(bits, shared.value)
        keep, powers, digest = _FILTERS[shared.id], Powers(), xxhash.xxh3_64_intdigest
        held, n = [], 0

        def combined():
            doc, k, c, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, c, k))
            doc, k, c, at = doc[order], k[order], c[order], at[order]
            head = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            least = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
            free = doc == least
            m = int(free.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[free]), pa.array(k[free]), pa.array(c[free]), pa.array(at[free]), pa.nulls(m, pa.list_(pa.int64())),
            ], names=["doc_id", "k", "c", "at", "done"])
            doc, at = doc[~free], at[~free]
            if len(doc):
                order = np.lexsort((at, doc))
                doc, at = doc[order], at[order]
                first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] >> 32 != at[:-1] >> 32)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array(at))
                ids = doc[first]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(mix(ids.view(np.uint64)).view(np.int64)), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64()), lists,
                ], names=["doc_id", "k", "c", "at", "done"])

        for b in batches:
            for doc, part, text in zip(b["doc_id"].to_pylist(), b["part"].to_pylist(), b["text"].to_pylist()):
                w = windows(text, powers) if doc is not None else None
                if w is None:
                    continue
                joined, starts, ends, h = w
                at = keep(h)
                if len(at):
                    c = np.array([digest(joined[s:e]) & 0xFFFFFFFF for s, e in zip(starts[at].tolist(), ends[at].tolist())], np.uint64)
                    held.append((
                        np.full(len(at), doc, np.int64), h[at].view(np.int64), c.astype(np.uint32).view(np.int32), (np.int64(part) << np.int64(32)) | at,
                    ))
                    n += len(at)
                    if n >= COMBINE:
                        yield from combined()
                        held, n = [], 0
        if n:
            yield from combined()

    return run


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, at): per document the starts of windows that also start in a document with a smaller doc_id."""
    bits, slices = sketch(docs)
    shared = docs.sparkSession.sparkContext.broadcast(slices)
    found = docs.select("doc_id", "part", "text").mapInArrow(_starts(bits, _Named(shared)), "doc_id long, k long, c int, at long, done array<long>")
    first = F.min("doc_id").over(Window.partitionBy("k", "c"))
    found = found.withColumn("first", first).filter("done IS NOT NULL OR doc_id > first")
    places = found.select("doc_id", F.coalesce("done", F.array("at")).alias("at"))
    places = places.withColumn("part", F.shiftright(F.get("at", F.lit(0)), 32))
    per = places.groupBy("doc_id", "part").agg(F.flatten(F.collect_list("at")).alias("at"))
    return per.withColumn("at", F.transform("at", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))


class _Named:
    """A broadcast with an id that tells workers whether they hold its filter already."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, xxhash.xxh64_hexdigest(repr([(s[0], s[1], len(s[2])) for s in broadcast.value]) + str(id(broadcast)))

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


@F.pandas_udf(KEPT)
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, starts in parts:
        rows = []
        for text, at in zip(texts, starts):
            tokens = (text or "").encode("utf-8", "surrogatepass").split()
            if at is None or len(at) == 0:
                rows.append((len(tokens), 0, b" ".join(tokens).decode("utf-8", "surrogatepass")))
                continue
            at = np.asarray(at, np.int64)
            edge = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = b" ".join([t for t, g in zip(tokens, gone.tolist()) if not g])
            rows.append((len(tokens), int(gone.sum()), left.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    # Only where a doc_id comes more than once do places need the text's hash beside them.
    twice = not d.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
    part = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)) if twice else F.lit(0).cast("long")
    d = d.withColumn("part", part)
    starts = stage(repeated_starts(d), "repeats")
    some = d.join(F.broadcast(_slots(starts)), F.expr(f"{_SLOT} div 64") == F.col("w"), "left").withColumn(
        "some", F.expr(f"coalesce(shiftrightunsigned(b, cast({_SLOT} % 64 as int)) & 1, 0) = 1"))
    # Only texts that may have lost words move to meet their starts.
    moved = some.filter("some").select("doc_id", "part", "text").join(starts, ["doc_id", "part"], "left")
    out = moved.unionByName(some.filter("NOT some").select("doc_id", "part", "text", F.lit(None).cast("array<bigint>").alias("at")))
    out = out.select("doc_id", _without("text", "at").alias("r"))
    return out.select("doc_id", "r.n_words", "r.n_removed", "r.kept")


SLOT_BITS = 24
_SLOT = f"pmod(xxhash64(doc_id), {1 << SLOT_BITS})"


def _slots(starts: DataFrame) -> DataFrame:
    """A bitmap of the hashed doc_ids, 64 to a row: 2**(SLOT_BITS - 6) rows at most, 4 MB, however many documents there are."""
    return starts.groupBy(F.expr(f"{_SLOT} div 64").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({_SLOT} % 64 as int)))").alias("b"))
