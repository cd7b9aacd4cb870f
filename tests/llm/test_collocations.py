from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyscope.llm import collocations
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS

ENDS = ".,;:!?\n\x0b\x0c\r"


def pieces(text):
    out = [[]]
    word = ""
    for ch in (text or "") + ".":
        ch = chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
        if ch in ENDS or ch in " \t":
            if word:
                out[-1].append(word)
                word = ""
            if ch in ENDS:
                out.append([])
        else:
            word += ch
    return [p for p in out if p]


def plain(rows, floor=100, first=2000, longest=5):
    """rows: (lang, text) -> sorted result rows, by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, longest + 1):
                for i in range(len(p) - k + 1):
                    f[lang, tuple(p[i : i + k])] += 1
    many = {(g, w): a for (g, w), a in f.items() if len(w) > 1 and a >= floor}
    longer = Counter()
    for (g, w), a in many.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[g, w[i : i + m]] = max(longer[g, w[i : i + m]], a)
    out = []
    for (g, w), a in many.items():
        if longer[g, w] and 100 * longer[g, w] >= 100 * a:
            continue
        score, k = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
        out.append((g, -score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]], n[g]))
    got, seen = [], Counter()
    for g, score, a, phrase, l, r, total in sorted(out):
        seen[g] += 1
        if seen[g] <= first:
            got.append((g, seen[g], phrase.decode(), -a, l, r, total, -score))
    return got


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(rng, n=300):
    """Texts over a few words with passages in common, all kinds of ends, and every awkward case."""
    vocabulary = [f"w{i}" for i in range(30)] + ["Stra\u00dfe", "\u00c9t\u00e9", "A", "B"]
    passages = [" ".join(rng.choice(vocabulary, 40)) for _ in range(4)]
    rows = []
    for _ in range(n):
        parts = [str(x) for x in rng.choice(vocabulary, int(rng.integers(0, 80)))]
        text = " ".join(x + str(rng.choice(["", "", "", ",", ". ", "\n", "\t"])) for x in parts)
        rows.append((str(rng.choice(["en", "fr"])), text + " " + passages[int(rng.integers(0, 4))]))
    rows += [("en", None), (None, "a b a b a b"), ("und", "a b. a b"), ("en", ""), ("en", " ,.; "), ("en", "x " * 5000), ("fr", "p q " * 3000), (None, "z" * 20000)]
    return rows + [("en", "Exact copy of a text, copied.")] * 150


def test_op13_against_brute_force(spark):
    rows = corpus(np.random.default_rng(1))
    df = spark.createDataFrame([(i % 7, *r, 1, 2, "c") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n long, words int, chunk string").repartition(5)
    for floor in (100, 20):
        want = plain(rows, floor)
        assert len(want) > 10 and collected(collocations.collocations(df, floor=floor)) == sorted(want)
    few = plain(rows, 20, first=7)
    assert collected(collocations.collocations(df, floor=20, first=7)) == sorted(few)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.filter("text IS NULL")).count() == 0


def test_op13_on_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("lang", "text").collect()]
    assert collected(PLANS["op13_collocations"](spark, sf_dir)) == sorted(plain(rows))


def test_ranges_of_hashes_give_the_same(spark, monkeypatch):
    rows = corpus(np.random.default_rng(2), 120)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = sorted(plain(rows, 10))
    monkeypatch.setattr(collocations, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(collocations, "BITS_EACH", 1 << 10)
    assert collocations.ranges_of(256) == 8
    assert collected(collocations.collocations(df, floor=10)) == want


def test_every_phrase_is_counted_once():
    """The weighted chunks give the counts of the texts, whatever the phrase's place."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 3000, n)) for n in (0, 1, 3, 4, 5, 60, 3000)]
    got, owner = collocations.chunks([collocations.normalised(t) for t in texts])
    for i, t in enumerate(texts):
        mine, seen = [c for c, o in zip(got, owner) if o == i], Counter()
        for c in mine:
            e = c[:-1].split(b" ")
            seen.update(tuple(e[j : j + 5]) for j in range(len(e) - 4))
        words = t.encode().split()
        padded = [*words, *[b"\n"] * 4]
        assert seen == Counter(tuple(padded[j : j + 5]) for j in range(len(words)))
        assert len(words) < 3000 or len(mine) > 40


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 9000, 1000))
    a, b = (set(collocations.chunks([collocations.normalised(t)])[0]) for t in (f"one {passage}", f"quite another start {passage} tail"))
    assert len(a & b) > 15 and len(a - b) <= 1 + collocations.OVERLAP  # the start, and places that see the end


def test_phrases_with_one_hash_are_told_apart():
    rows = [(c, b"a b c \n \n \n \n ", n) for c, n in (("en", 3), ("fr", 4))]
    x = collocations.Batch(pa.RecordBatch.from_pylist([{"lang": g, "chunk": c, "n": n} for g, c, n in rows]))
    where = np.array([0, 1, 7, 8])
    at, n = collocations.phrases_at(x, where, np.zeros(4, np.uint64), 2)
    assert dict(zip(at.tolist(), n.tolist())) == {0: 3, 1: 3, 7: 4, 8: 4}


@pytest.mark.parametrize("count", [1, 5000])
def test_bitmaps_hold_their_keys(spark, count):
    keys = np.random.default_rng(count).integers(-(2**63), 2**63 - 1, count)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    (m,) = collocations.bitmaps(df, count)
    assert m.has(keys.view(np.uint64)).all()
    other = np.random.default_rng(9).integers(0, 2**63, 20000).astype(np.uint64)
    assert m.has(other).mean() < 0.2


def test_batches_are_small(spark):
    """The arrays of a batch take many times its bytes, in every Python worker of an executor."""
    docs = spark.createDataFrame([(i, "a b c d " * 9, "en") for i in range(20)], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
