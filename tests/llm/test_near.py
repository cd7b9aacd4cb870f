import numpy as np

import corpus_pipeline
from tallyscope.llm import near_overlap, simhash
from tallyscope.llm.common import table
from tests.llm import brute


def shingles(text):
    w = brute.tokens((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(rows):
    """rows: (doc_id, text) -> kept rows, by all pairs; rows without doc_id behind the others."""
    up, s = list(range(len(rows))), [shingles(t) for _, t in rows]

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                up[find(i)] = find(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        k = find(i)
        best[k] = min(best.get(k, (True, 0, "")), (d is None, d or 0, t or ""))
    return sorted((None if none else d, t) for none, d, t in best.values())


def edited(rng, words, k):
    out = list(words)
    for i in rng.choice(len(words), k, replace=False):
        out[i] = f"n{rng.integers(10**9)}"
    return " ".join(out)


def copies(rng):
    """Texts with copies at five-word Jaccard of about 0.65 to 0.99, a chain, and one large group."""
    rows = []
    for n in (30, 100, 300, 1000):
        for share in (0.002, 0.01, 0.02, 0.03, 0.04):
            for _ in range(4):
                w = [f"w{x}" for x in rng.integers(0, 5000, n)]
                rows += [" ".join(w), edited(rng, w, max(1, round(n * share)))]
    w = [f"c{x}" for x in rng.integers(0, 5000, 400)]
    for _ in range(8):
        rows.append(" ".join(w))
        w = edited(rng, w, 5).split()
    w = [f"g{x}" for x in rng.integers(0, 5000, 120)]
    return rows + [edited(rng, w, int(k)) for k in rng.integers(0, 5, 60)]


def test_near_stage_finds_what_all_pairs_find(spark, sf_dir):
    texts = copies(np.random.default_rng(3))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0] + " more"), (5, "A b"), (6, "x y"), (5, texts[2] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near(spark, df, sf_dir).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = groups(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(want) < len(rows) - 60


def test_near_stage_on_a_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in corpus_pipeline.near(spark, docs, sf_dir).select("doc_id", "text").collect()]
    assert sorted(got) == groups(rows) and len(got) < len({t.lower() for _, t in rows})


def test_near_stage_cases(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (None, "one two"), (None, "alone"), (6, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in corpus_pipeline.near(spark, df, sf_dir).collect()}
    assert got == {(1, None), (4, "one two"), (None, "alone"), (6, "one two three")}


def test_bands_and_sketches_lose_no_pair_at_the_threshold():
    """Pairs of 0.8 to 0.82 share a band key; their sketches and pivot coordinates never exceed the radius."""
    rng, n, lost = np.random.default_rng(4), 0, 0
    while n < 400:
        w = [f"w{x}" for x in rng.integers(0, 9000, int(rng.integers(20, 400)))]
        t = " ".join(w)
        u = edited(rng, w, max(1, round(len(w) * rng.uniform(0.015, 0.035))))
        a, b = shingles(t), shingles(u)
        x, y = near_overlap.sketch_of(t), near_overlap.sketch_of(u)
        apart = int(np.bitwise_count(x[2] ^ y[2]).sum())
        assert apart <= len(a ^ b) and int(np.abs(x[3].astype(int) - y[3].astype(int)).max()) <= apart
        if not 0.8 <= len(a & b) / len(a | b) <= 0.82:
            continue
        n += 1
        assert len(a ^ b) <= (x[1] + y[1]) // 9
        lost += not set(x[4].tolist()) & set(y[4].tolist())
    assert lost <= 1


def test_texts_edited_apart_come_out_of_no_join(spark, monkeypatch):
    """A group that shares buckets, all of it under 0.8: its pairs are discarded inside the join."""
    rng, met = np.random.default_rng(5), []
    w = [f"g{x}" for x in rng.integers(0, 5000, 150)]
    rows = [(i, edited(rng, w, 12)) for i in range(150)]
    plain = near_overlap.verified

    def counted(pairs, found):
        met.append(pairs.count())
        return plain(pairs, found)

    monkeypatch.setattr(near_overlap, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_overlap.left_over(df).count() == 0
    stars, *further = met
    assert sum(further) < 20 and stars < 25 * 150


def test_a_dense_group_is_not_met_in_pairs(spark, monkeypatch):
    """Texts around the threshold to one another: stars of other leaders bring most of them together before pairs are met."""
    rng, met = np.random.default_rng(6), []
    w = [f"g{x}" for x in rng.integers(0, 5000, 160)]
    rows = [(i, edited(rng, w, int(k))) for i, k in enumerate(rng.integers(1, 5, 240))]
    plain = near_overlap.verified

    def counted(pairs, found):
        met.append(pairs.count())
        return plain(pairs, found)

    monkeypatch.setattr(near_overlap, "verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = near_overlap.left_over(df).count()
    assert gone == len(rows) - len(groups(rows)) and gone > 100
    assert len(met) > 2 and met[-1] < 480 and max(met) < 25 * 240, met


def test_near_stage_goes_through_simhash_groups(spark, sf_dir, monkeypatch):
    """Fingerprints meet through the pivot tables of op4, and what its groups hold apart from 0.8 stays apart."""
    rng, linked = np.random.default_rng(8), []
    w = [f"s{x}" for x in rng.integers(0, 5000, 900)]
    rows = [(i, edited(rng, w, k)) for i, k in enumerate((0, 1, 1, 2, 3, 400, 400))]
    plain = simhash.links

    def counted(nodes):
        out = plain(nodes)
        linked.append(out.count())
        return out

    monkeypatch.setattr(simhash, "links", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near(spark, df, sf_dir).collect()]
    assert sorted(got) == groups(rows)
    assert len(linked) == 1 and linked[0] > 0
