import hashlib

import numpy as np
import pytest

from tallyscope.llm import exact_dedup, simhash, substring_dedup
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS
from tests.llm import brute

LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(3000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Abc"), (5, "aBC"), (6, "ÄÖ"), (7, "äö"), (8, LONG), (9, LONG.upper()), (10, LONG + " x"),
    (11, LONG), (11, LONG), (None, "abc"), (12, "a b c d e f g h i j k l m n o"), (13, "z a b c d e f g h i j k l m n o q"),
    (14, " a b"), (15, "a b c d e f g h i j k l m n o a b c d e f g h i j k l m n o"), (16, "ab"),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(d, t, "x", "s", "h", 7) for d, t in rows], "doc_id long, text string, recipe string, row string, fp string, node int",
    )


def whole(spark, sf_dir):
    return [(r[0], r[1]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def test_simhash_matches_brute_force_on_a_whole_table(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in PLANS["op4_simhash"](spark, sf_dir).collect()}
    assert got == brute.near_groups(whole(spark, sf_dir))


def test_simhash_cases(spark):
    got = simhash.near_groups(frame(spark, ODD)).collect()
    want = brute.near_groups([r for r in ODD if r[0] is not None])
    assert len(got) == len(ODD)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] == 4
    assert simhash.near_groups(frame(spark, [])).count() == 0


def test_rows_without_id_link_others(spark, monkeypatch):
    """Fingerprints 0 and 63 are 6 bits apart and joined only through 7, which a row without doc_id has."""
    monkeypatch.setattr(simhash, "fingerprints", lambda text: text.cast("long"))
    rows = [(4, "0"), (None, "7"), (3, "63"), (None, str(1 << 40)), (9, str(1 << 20)), (9, str(1 << 20)), (8, str((1 << 20) + 1023 * 1024))]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted(
        [(4, 0, 3), (0, 7, 3), (3, 63, 3), (0, 1 << 40, 3), (9, 1 << 20, 3), (9, 1 << 20, 3), (8, (1 << 20) + 1023 * 1024, 8)])


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    fps = set(map(int, base))
    for b in base.tolist():
        for k in (1, 2, 3, 3, 4, 5):
            x = b
            for bit in rng.choice(64, k, replace=False).tolist():
                x ^= 1 << bit if bit < 63 else -(1 << 63)
            fps.add(x)
    rows = list(enumerate(sorted(fps)))
    got = sorted(tuple(r) for r in simhash.links(spark.createDataFrame(rows, "node long, fp long")).collect())
    m = (1 << 64) - 1
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & m).bit_count() <= 3)
    assert got == want and len(want) > 200


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, i) for i in range(1001, 1400)]
    lone = [(5000, 5001)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(chain + star + lone, "lo long, hi long")).collect()}
    assert len(got) == 301 + 400 + 2
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400)) and got[5001] == 5000


def test_substring_dedup_matches_brute_force_on_a_whole_table(spark, sf_dir):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in PLANS["op8_substring_dedup"](spark, sf_dir).collect()}
    assert got == brute.substring_dedup(whole(spark, sf_dir))
    assert any(n for _, n, _ in got.values())


def test_substring_cases(spark):
    got = substring_dedup.remove_repeats(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = brute.substring_dedup([r for r in ODD if r[0] is not None])
    for r in got:
        if r["doc_id"] is not None:
            kept = hashlib.sha256(r["kept"].encode()).hexdigest()
            assert (r["n_words"], r["n_removed"], kept) == want[r["doc_id"]]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("combine, parts", [(1, 6), (50, 2), (10**6, 1)])
def test_combining_in_tasks_changes_nothing(spark, sf_dir, monkeypatch, combine, parts):
    monkeypatch.setattr(substring_dedup, "COMBINE", combine)
    docs = table(spark, sf_dir, "documents").repartition(parts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.substring_dedup(whole(spark, sf_dir))


def test_narrow_sketches_give_the_same(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MIN_CELL_BITS", 8)
    monkeypatch.setattr(substring_dedup, "MAX_CELL_BITS", 8)
    got = PLANS["op8_substring_dedup"](spark, sf_dir).collect()
    want = brute.substring_dedup(whole(spark, sf_dir))
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def test_exact_cases(spark):
    got = exact_dedup.exact_groups(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    norm = [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")), d) for d, t in ODD]
    assert len(by) == len({t for t, _ in norm})
    for t in {t for t, _ in norm}:
        rows = by[hashlib.sha256(t.encode()).hexdigest()]
        ids = [d for x, d in norm if x == t]
        assert sum(r["kept"] for r in rows) == 1 and len(rows) == len(ids) == rows[0]["group_size"]
        assert {r["keep_id"] for r in rows} == {max((d for d in ids if d is not None), default=None)}
        assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_chunks_cover_the_text(spark):
    text = LONG + "\n\n" + "x" * 9000 + ". " + LONG
    got = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks_of("t").alias("c")).first()["c"]
    assert "".join(got) == text and len(got) > 5 and max(map(len, got)) <= exact_dedup.CHUNK_MAX


def test_a_shared_identifier_is_resolved(spark, monkeypatch):
    """With every chunk under one identifier, the texts still tell documents apart."""
    docs = frame(spark, [(1, "one"), (2, "two"), (3, "ONE"), (4, None)])
    same = exact_dedup.chunk_recipes(docs)
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "chunk_recipes", lambda d: same.withColumn("recipe", F.transform("recipe", lambda c: F.lit(5).cast("long"))))
    monkeypatch.setattr(exact_dedup, "unverified_ids", lambda d: spark.createDataFrame([(5,)], "chunk_id long"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_rows_that_meet_under_block_keys_are_narrow(spark):
    """A node goes to 20 keys: its 16 pivot distances are two longs of the row, and what follows from the table stays out."""
    fps = [(1 << 63) - 1, -1, 0, 12345, -(1 << 63)]
    d = simhash.keyed(spark.createDataFrame([(f, f) for f in fps], "node long, fp long"))
    assert len(d.columns) <= 6
    for r in d.filter("t = 0").collect():
        got = [int(b) for i in range(2) for b in (r[f"p{i}"] & (1 << 64) - 1).to_bytes(8, "little")]
        assert got == [((r["fp"] ^ p) & (1 << 64) - 1).bit_count() for p in simhash.pivots()]
