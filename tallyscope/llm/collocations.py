"""Phrase collocation mining over a prefix-free parse.

1. Every text becomes a sequence of words and piece ends.  A chunk starts wherever the hash of OVERLAP elements says so and
   runs on to the end of the next such place, so chunks overlap by OVERLAP elements and no chunk is the start of another one;
   equal passages give equal chunks wherever they stand.  The dictionary has the distinct chunks of a language with their
   frequencies in the parse.
2. A phrase of up to OVERLAP + 1 words is counted where it starts: in the last OVERLAP elements of a chunk it belongs to the
   next one.  Each distinct chunk is read once, its phrases weighted by its frequency.
3. Level by level: a phrase can reach the floor only if its two parts of one word less do.  Hashed counts give the frequent
   phrases of a level, and a bitmap of them lets the next level leave out what cannot be frequent.  Hash collisions only
   let more through: the last pass counts what is left by its words, exactly.
4. Scores, cuts and containment are joins of candidates with counts.

A bitmap has at most MAX_BITS; where a level has more frequent phrases than BITS_EACH allows, it is passed in ranges of
hashes, a bitmap each, so that what passes falsely stays the same share at any size.

Cases: a null text is empty; a null language is `und`, one with a language of that name; texts without words give nothing;
repeated rows count each; a text of any length is parsed whole; ties are broken by score, frequency and phrase; an empty
table gives no rows; doc_id (null or not) and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import small_batches, stage

# Fixed values of the contract.
LONGEST, FLOOR, FIRST, SCALE, INSIDE_PERCENT, NO_LANGUAGE = 5, 100, 2000, 1000, 100, "und"
END = b"\n "  # a piece end as an element: words have no white space of this kind; every element ends with one space
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")

OVERLAP = LONGEST - 1
EVERY = 32  # elements between two chunk starts, on average
BITS_EACH, MAX_BITS = 16, 1 << 28
_ODD = np.array([xxhash.xxh64_intdigest(f"element {i}") | 1 for i in range(OVERLAP + 1)], np.uint64)
_MIX = np.uint64(xxhash.xxh64_intdigest("mix") | 1)
_BYTES = np.array([xxhash.xxh64_intdigest(f"byte {i}") for i in range(256)], np.uint64)
_BASE = xxhash.xxh64_intdigest("base") | 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2^64."""
    both = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[:1] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


class Elements:
    """The elements of a buffer in which each ends with a space: where they lie, hashes, and exact numbers of equal ones."""

    def __init__(self, data: bytes):
        flat = np.frombuffer(data, np.uint8)
        self.data = data
        self.offsets = np.r_[0, np.flatnonzero(flat == 32) + 1].astype(np.int32)
        self.word = flat[self.offsets[:-1]] != END[0]
        # Polynomials of the bytes, from sums along the buffer: the place of a word cancels out.
        up, down = powers(1 << max(0, len(flat) - 1).bit_length())
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTES[flat] * up[: len(flat)])]
        self.h = mixed((sums[self.offsets[1:]] - sums[self.offsets[:-1]]) * down[self.offsets[:-1]])

    def __len__(self) -> int:
        return len(self.h)

    @cached_property
    def code(self) -> np.ndarray:
        words = pa.BinaryArray.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.data)])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def normalised(text: str | None) -> bytes:
    """The lower-cased words of a text, an END for every end of a piece and OVERLAP more; nothing if it is blank."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_ENDS)  # bytes: A-Z only
    raw = b" ".join(filter(None, raw.replace(b"\n", b" \n ").split(b" ")))
    return raw + b" " + END * OVERLAP if raw else b""


def chunks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The parse of normalised texts: their chunks, and the place of each one's text in the list."""
    kept = [i for i, t in enumerate(texts) if t]
    if not kept:
        return [], np.zeros(0, np.int64)
    data = b"".join(texts[i] for i in kept)
    e = Elements(data)
    n, ends = len(e), np.searchsorted(e.offsets, np.cumsum([len(texts[i]) for i in kept]))
    begins = np.r_[0, ends[:-1]]
    start = np.zeros(n, bool)
    window = sum(e.h[i : n - OVERLAP + i] * _ODD[i] for i in range(OVERLAP))
    start[: len(window)] = (window >> np.uint64(33)) % np.uint64(EVERY) == 0
    for i in range(1, OVERLAP + 1):
        start[ends - i] = False  # the ends behind a text start nothing
    start[begins] = True
    first = np.flatnonzero(start)
    owner = np.searchsorted(begins, first, "right") - 1
    # A chunk runs on over the place that starts the next one of its text.
    last = np.minimum(np.r_[first[1:] + OVERLAP, n], ends[owner])
    a, b = e.offsets[first].tolist(), e.offsets[last].tolist()
    return [data[x:y] for x, y in zip(a, b)], np.array(kept)[owner]


def parse(docs: DataFrame) -> DataFrame:
    """(lang, chunk, n): the dictionary of each language and how often the parse has each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, owner = chunks([normalised(t) for t in b.column(1).to_pylist()])
            rows = pa.table({"lang": b.column(0).take(pa.array(owner)), "chunk": pa.array(found, pa.binary())})
            counted = rows.group_by(["lang", "chunk"]).aggregate([([], "count_all")]).rename_columns(["lang", "chunk", "n"])
            yield from counted.cast(pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("n", pa.int64())])).to_batches()

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return rows.mapInArrow(run, "lang string, chunk binary, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


@dataclass
class Bitmap:
    """Hashes of one of `ranges` ranges, as bits."""

    bits: np.ndarray
    at: int = 0
    ranges: int = 1

    def here(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key belongs to this range."""
        return (keys >> np.uint64(40)) % np.uint64(self.ranges) == self.at

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def ranges_of(count: int) -> int:
    """How many bitmaps so many keys take."""
    return -(-count * BITS_EACH // MAX_BITS)


def bitmaps(keys: DataFrame, count: int) -> Iterator[Bitmap]:
    """The column `key` of `keys` as bitmaps, one range after the other."""
    ranges = ranges_of(count)
    size = min(MAX_BITS, 1 << max(15, (count * BITS_EACH // ranges).bit_length()))
    for r in range(ranges):
        mine = keys.filter(F.pmod(F.shiftrightunsigned("key", 40), F.lit(ranges)) == r)
        place = F.col("key").bitwiseAND(F.lit(size - 1)) + 1  # Spark counts bits from 1
        parts = mine.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        bits = np.zeros(size // 8, np.uint8)
        for p in parts.collect():  # MAX_BITS / 8 bytes at most
            start = (p["bucket"] - 1) * 4096
            bits[start : start + 4096] = np.frombuffer(p["bits"], np.uint8)
        yield Bitmap(bits, r, ranges)


class Batch:
    """The elements of a batch of chunks, one after the other, with the hashes of the phrases that start at each."""

    def __init__(self, b: pa.RecordBatch):
        langs = b.column(0).dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        self.n = b.column(2).to_numpy()
        self.e = Elements(b"".join(b.column(1).to_pylist()))
        last = np.searchsorted(self.e.offsets, np.cumsum(pc.binary_length(b.column(1)).to_numpy()))
        self.chunk = np.repeat(np.arange(len(last)), np.diff(np.r_[0, last]))
        self.weight, self.start = self.n[self.chunk], np.ones(len(self.e), bool)
        for i in range(1, OVERLAP + 1):
            self.start[last - i] = False
        seeds = np.fromiter((xxhash.xxh64_intdigest(x) for x in self.langs), np.uint64, len(self.langs))
        self.one = mixed((self.e.h ^ seeds[self.lang[self.chunk]]) * _ODD[0])

    def levels(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hash of the k words from each place, whether they are words all of one piece)."""
        key, ok = self.one, self.e.word
        yield 1, key, ok
        for k in range(2, longest + 1):
            tail = self.one[k - 1 :]
            key = mixed(key[: len(tail)] * _ODD[k - 1] + tail)
            ok = ok[: len(tail)] & self.e.word[k - 1 :]
            yield k, key, ok


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights[order], first)


def phrases_at(x: Batch, where: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct phrase of k words, the weights of its places), told apart by language and words."""
    if not len(where):
        return where, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    where, keys = where[order], keys[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    lead = where[first][np.cumsum(first) - 1]
    same = x.lang[x.chunk[where]] == x.lang[x.chunk[lead]]
    for j in range(k):
        same &= x.e.code[where + j] == x.e.code[lead + j]
    if not same.all():  # phrases with one hash: compared by their words
        columns = np.stack([x.lang[x.chunk[where]], *(x.e.code[where + j] for j in range(k))], axis=1)
        _, at, group = np.unique(columns, axis=0, return_index=True, return_inverse=True)
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, group.ravel(), x.weight[where])
        return where[at], sums
    return where[first], np.add.reduceat(x.weight[where], np.flatnonzero(first))


def count_level(dictionary: DataFrame, k: int, shorter: Bitmap | None) -> DataFrame:
    """(lang, key, n): weighted hashed counts per task of the phrases of k words whose parts may be frequent.

    At level 1 also all words of a language, under a null key.
    """
    known = dictionary.sparkSession.sparkContext.broadcast(shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = known.value
        for b in batches:
            x, before = Batch(b), None
            for level, key, ok in x.levels(k):
                if level < k:
                    before = key
            at = ok & x.start[: len(ok)]
            if less is not None:
                n = len(at)
                at[at] = less.here(before[:n][at]) & less.has(before[:n][at])
                nxt = before[1 : n + 1][at]
                at[at] = less.has(nxt) | ~less.here(nxt)
            keys, n = grouped(key[at], x.weight[: len(at)][at])
            langs, totals = [None] * len(keys), []
            if k == 1:
                words = np.bincount(x.chunk[at], minlength=len(x.n)) * x.n
                totals = [int(words[x.lang == i].sum()) for i in range(len(x.langs))]
                langs += x.langs
            none = pa.nulls(len(totals), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.concat_arrays([pa.array(keys.view(np.int64)), none]), pa.array(np.r_[n, np.array(totals, np.int64)].astype(np.int64))],
                names=["lang", "key", "n"])

    return dictionary.mapInArrow(run, "lang string, key long, n long")


def phrases_of(dictionary: DataFrame, ranges: list[Bitmap]) -> DataFrame:
    """(lang, words, phrase, n) per task: the phrases of 1, 2, ... words that are in the bitmaps, by their words."""
    known = dictionary.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = known.value
        for b in batches:
            x = Batch(b)
            for k, key, ok in x.levels(len(maps)):
                m = maps[k - 1]
                if m is None:
                    continue
                at = ok & x.start[: len(ok)]
                at[at] = m.here(key[at]) & m.has(key[at])
                where, n = phrases_at(x, np.flatnonzero(at), key[at], k)
                first, last = x.e.offsets[where].tolist(), (x.e.offsets[where + k] - 1).tolist()
                langs = pa.array(x.langs, pa.string()).take(pa.array(x.lang[x.chunk[where]]))
                yield pa.RecordBatch.from_arrays(
                    [langs, pa.array([k] * len(where), pa.int32()), pa.array([x.e.data[i:j] for i, j in zip(first, last)], pa.binary()), pa.array(n.astype(np.int64))],
                    names=["lang", "words", "phrase", "n"])

    return dictionary.mapInArrow(run, "lang string, words int, phrase binary, n long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases of up to `longest` words found `floor` times or more, (lang, n))."""
    # The arrays of a batch take some fifty times its bytes, and every core of an executor has one.
    small_batches(docs.sparkSession, "1m")
    dictionary = stage(parse(docs), "parse")
    totals, levels = None, []
    for k in range(1, longest + 1):
        parts = [count_level(dictionary, k, m) for m in (bitmaps(*levels[-1]) if levels else [None])]
        counted = parts[0]
        for p in parts[1:]:
            counted = counted.unionByName(p)
        if k == 1:
            counted = stage(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
            totals = counted.filter("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
            counted = counted.filter("key IS NOT NULL")
        keys = stage(counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor).select("key"), "frequent")
        count = keys.count()
        if not count:
            break
        levels.append((keys, count))
    # Levels of one range share a pass; those of more ranges have one for each.
    one = [next(bitmaps(*x)) if ranges_of(x[1]) == 1 else None for x in levels]
    passes = [one] if any(one) else []
    passes += [[None] * i + [m] for i, x in enumerate(levels) if not one[i] for m in bitmaps(*x)]
    found = None
    for maps in passes:
        part = phrases_of(dictionary, maps)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = dictionary.select("lang", F.lit(0).alias("words"), F.col("chunk").alias("phrase"), "n").limit(0)
    exact = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= floor)
    return stage(exact.withColumn("phrase", F.col("phrase").cast("string")), "phrases"), totals


def _part(words: Column, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, floor: int = FLOOR, first: int = FIRST, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, longest, floor)
    of = phrases.select("lang", F.col("phrase").alias("part"), "f")
    candidates = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))

    # every cut of every candidate with the counts of its two parts
    cut = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cut = cut.join(of.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(of.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cut = cut.join(F.broadcast(totals) if _few(totals) else totals, "lang")
    wide = "CAST({} AS DECIMAL(19,0))".format
    score = F.expr(f"CAST({SCALE} * {wide('a')} AS DECIMAL(38,0)) * {wide('n')} div ({wide('l')} * {wide('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))

    # the most frequent longer candidate around each candidate
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: _part(F.col("w"), s, m))))
    around = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(100 AS DECIMAL(19,0)) * longer < CAST({inside_percent} AS DECIMAL(19,0)) * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def _few(totals: DataFrame, most: int = 10000) -> bool:
    return totals.limit(most + 1).count() <= most
