import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyscope.llm import packing
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS


def fewest(pieces, capacity):
    """The least number of bins, by trying every bin for every piece."""
    pieces = sorted(pieces, reverse=True)
    best = [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= pieces[i]}:
            at = rooms.index(r)
            go(i + 1, [*rooms[:at], r - pieces[i], *rooms[at + 1 :]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best[0]


def content(patterns):
    out = Counter()
    for pattern, times in patterns:
        for length, copies in pattern:
            out[length] += copies * times
    return out


def test_reduction_keeps_the_optimum():
    rng, shrunk = random.Random(5), 0
    for _ in range(400):
        capacity = rng.choice([10, 13, 20, 30])
        pieces = [rng.randint(1 if rng.random() < 0.5 else capacity // 5, capacity) for _ in range(rng.randint(1, 9))]
        counts = Counter(pieces)
        fixed, left = packing.reduce_instance(counts, capacity)
        assert content(fixed) + Counter(left) == counts
        assert all(sum(s * k for s, k in p) <= capacity for p, _ in fixed)
        rest = [s for s, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(pieces, capacity)
        shrunk += len(rest) < len(pieces)
    assert shrunk > 200


def test_triples_are_fixed_where_they_dominate():
    # beside 40 at most two others fit; 33 with 27 dominates, and no two pieces fill the gap better
    fixed, left = packing.reduce_instance({40: 6, 33: 6, 27: 6}, 100)
    assert fixed == [(((40, 1), (33, 1), (27, 1)), 6)] and not left
    # beside 40 a piece of 28 and one of 31 fit as well, which {33, 27} does not dominate
    assert packing._pair_beside({33: 1, 31: 1, 28: 1, 27: 1}, 60) is None
    assert packing._pair_beside({33: 1, 26: 2}, 60) == (33, 26)


def plain_best_fit(pieces, capacity):
    rooms = []
    for s in sorted(pieces, reverse=True):
        at = min((i for i, r in enumerate(rooms) if r >= s), key=lambda i: rooms[i], default=None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    return sorted(rooms)


def test_best_fit_by_lengths_is_best_fit_by_pieces():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([10, 50, 1024])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))
        patterns = packing.best_fit(counts, capacity)
        assert content(patterns) == counts
        rooms = sorted(capacity - sum(s * k for s, k in p) for p, t in patterns for _ in range(t))
        assert rooms == plain_best_fit(counts.elements(), capacity)


def lower_bound(counts, capacity):
    """No packing has fewer: pieces over half a bin each need one, small ones fill their room first."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(c for s, c in counts.items() if s > capacity - k)
        half = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        rest = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2) - sum((capacity - s) * c for s, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-rest // capacity)))
    return best


def test_many_pieces_need_few_patterns():
    rng = np.random.default_rng(1)
    counts = {s: int(c) for s, c in zip(range(1, 1025), rng.integers(0, 10**9, 1024)) if c}
    patterns = packing.plan(counts)
    assert content(patterns) == Counter(counts) and len(patterns) < 8 * 1024
    assert lower_bound(counts, 1024) <= sum(t for _, t in patterns) < 1.002 * lower_bound(counts, 1024)


@pytest.fixture(scope="module")
def json_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check_placed(rows, texts, json_ids, capacity=1024):
    """Every row's pieces rebuilt from the json tokenizer, and the sequences gapless."""
    got, sequence = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for d, text in texts:
        ids = json_ids(text)
        start, piece, n = 0, 0, len(ids) % capacity or capacity
        while start < len(ids):
            want[d, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start, piece, n = start + n, piece + 1, capacity
    assert got == want
    for parts in sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequence)


def test_op12_on_a_whole_table(spark, sf_dir, json_ids):
    texts = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows = PLANS["op12_packing"](spark, sf_dir).collect()
    used = check_placed(rows, texts, json_ids)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_op12_cases(spark, json_ids):
    texts = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x " * 9000), (5, " \n\n  tab\tend  "), (6, "<|endoftext|> l\u00e9 \U0001f600"),
             (7, "word " * 1022), (8, "word " * 1023), (9, "word " * 1024), (10, "q" * 50000)]
    df = spark.createDataFrame([(*t, 1, 2, 3) for t in texts], "doc_id long, text string, length int, ids int, task int").repartition(5)
    rows = packing.pack(df).collect()
    check_placed(rows, texts, json_ids)
    assert packing.pack(df.limit(0)).count() == 0
    named = spark.createDataFrame([("k", "a b"), (None, "c")], "doc_id string, text string")
    check_placed(packing.pack(named).collect(), [("k", "a b"), (None, "c")], json_ids)


def test_sequences_hold_the_tokens(spark, sf_dir, json_ids):
    docs = table(spark, sf_dir, "documents").filter("doc_id % 4 = 0")
    placed = packing.pack(docs, capacity=300)
    whole = packing.sequences(placed).collect()
    back = defaultdict(dict)
    of = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in whole}
    assert all(len(ids) <= 300 and len(ids) == r["n_tokens"] for ids, r in zip(of.values(), whole))
    for r in placed.collect():
        back[r["doc_id"]][r["start"]] = of[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    for r in docs.collect():
        parts = back[r["doc_id"]]
        assert np.concatenate([parts[s] for s in sorted(parts)]).tolist() == json_ids(r["text"])
