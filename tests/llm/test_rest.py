import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyscope.llm import mixing, quality_classifier, quality_rules, sentencepiece_codec, url_filters
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS, SQL
from tests.compare import compare, connect
from tests.llm import brute, test_near


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    diff, _, _ = compare(spark, connect(sf_dir), PLANS[name], SQL[name], sf_dir)
    assert diff is None, diff


# --- url filters


def plain_judge(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "allow"), ("example.net", "/", "block"), ("net", "/en/deep/", "allow"),
    ("com", "", "block"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"), ("", "/", "block"), ("xample.net", "/", "allow"),
]
URLS = [
    None, "", "no scheme", "http://", "https://NET/", "http://example.net/en/1?q=http://com/", "http://w.example.net/en/", "http://example.net", "ftp://a.example.net#f",
    "http://a.example.net/en/deep/1", "x://b.com/xyz", "x://c.b.com/y", "x://com", "x://evilb.com/x", "x://net./", "x://..net/", "x://xample.net/", "x://éxample.net/en/", "x://a\nb.net/q\n?",
]


def test_url_cases(spark):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(URLS * 40)], "page_id long, url string, host string, key string").repartition(7)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filters.judge_urls(pages, rules).collect()
    assert len(got) == len(URLS) * 40
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(URLS[r["page_id"] % len(URLS)], RULES)
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# --- quality rules


def test_rule_order_does_not_change_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = list(quality_rules.rules())
    a, b = (quality_rules.judge(docs, order=o).select("doc_id", "kept").orderBy("doc_id").collect() for o in (names, names[::-1]))
    assert a == b and 0 < sum(r["kept"] for r in a) < len(a)


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "# " * 60) for i in range(300)], "doc_id long, text string")
    tests = {"never": F.col("n_words") < 0, "always": F.col("n_symbols") >= 0}
    assert quality_rules.measured_order(docs, tests)[0] == "always"


def test_quality_cases(spark):
    texts = [None, "", " \n", "a b c a b c", "x " * 60, "one line\none line\n\n \n" + "w1 w2 w3 " * 2, "a b c d " * 3 + "e", "w" * 100000, " ".join(f"w{i}" for i in range(30000))]
    rows = spark.createDataFrame([(i, t, 1, "l") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_words int, lines string")
    for r in quality_rules.judge(rows).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(rows.limit(0)).count() == 0


# --- mixing


def test_mix_cases(spark):
    texts = ["w " * n for n in (1, 5, 40, 300, 7)]
    rows = [(i, f"s{i % 7}", texts[i * i % 5]) for i in range(150)] + [(200, None, "a b"), (201, "s9", None), (202, "s9", " "), (203, "tiny", "x")]
    rows += [(7, "s0", texts[2])] * 3 + [(None, "s1", "a b c")] * 2 + [(400 + i, "s3", "q " * 11) for i in range(300)]
    docs = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, source string, text string, rank double, line string")
    got = [tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(got, key=key), sorted(brute.mix(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4] == w[4]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mixed_rows(docs).count() == sum(w[4] // w[1] for w in want if w[1])


# --- quality classifier


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = PLANS["op6_quality_classifier"](spark, d).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    pos, neg = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auc > 0.9 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    again = PLANS["op6_quality_classifier"](spark, d).select("doc_id", "score").orderBy("doc_id").collect()
    assert docs.count() == len(again) and [r["score"] for r in again if r["doc_id"] in {x["doc_id"] for x in got}] == [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_classifier_cases(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "x" * 200000, 3), (3, "x", 3), (None, "y", 3)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([(1, None), (9, 1), (None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.classify(docs, quality_classifier.learn(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    many = spark.createDataFrame([(i, "bad ### text" if i % 2 == 0 else "good words here", 1) for i in range(40)], "doc_id long, text string, quality int").unionByName(docs)
    out = quality_classifier.classify(many, quality_classifier.learn(many, some)).collect()
    assert len(out) == 45 and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.classify(docs.limit(0), None).count() == 0


# --- SentencePiece


@pytest.fixture(scope="module")
def voc():
    with open(sentencepiece_codec.model_path(), "rb") as f:
        return sentencepiece_codec.Vocabulary(f.read())


ODD = ["", None, " ", "  a  b ", "▁x ▁", "héé\n\n\ttab　漢字😀 ߷", "a" * 500, " " * 300, "the " * 50000, "\x00\x01"]


def test_round_trip_and_reruns(spark, voc):
    rows = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(ODD * 3)], "doc_id long, text string, decoded string")
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(rows.repartition(5)))
    got = out.collect()
    assert len(got) == 3 * len(ODD) and all(r["decoded"] == r["text"] and (r["piece_ids"] is None) == (r["text"] is None) for r in got)
    plain = {(i, t): sentencepiece_codec.encode_batch([t], [str(i)], voc)[0] for i in range(5) for t in ODD}
    assert all(r["text"] is None or list(plain[r["doc_id"], r["text"]]) == r["piece_ids"] for r in got)
    assert sentencepiece_codec.encode(rows.limit(0)).count() == 0


def test_segmentations_are_drawn_by_their_weights(voc):
    piece = {b.decode(): i for i, b in enumerate(voc.bytes_of) if i >= 259}

    def paths(x):
        if not x:
            yield (), 0.0
        for n in range(1, len(x) + 1):
            if x[:n] in piece:
                for p, w in paths(x[n:]):
                    yield (piece[x[:n]], *p), w + voc.log_weight[piece[x[:n]]]

    soft = sentencepiece_codec.Vocabulary.__new__(sentencepiece_codec.Vocabulary)
    soft.__dict__.update(voc.__dict__)
    soft.log_weight = voc.log_weight * 0.2
    weight = {p: math.exp(0.2 * w) for p, w in paths(" them")}
    n = 40000
    seen = Counter(tuple(e.tolist()) for e in sentencepiece_codec.encode_batch([" them"] * n, range(n), soft))
    assert set(seen) <= set(weight)
    for p, w in weight.items():
        share = w / sum(weight.values())
        assert abs(seen[p] / n - share) < 5 * math.sqrt(share / n) + 1e-4


def test_op3_is_lossless_on_a_whole_table(spark, sf_dir):
    got = PLANS["op3_sentencepiece"](spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count() and all(r["lossless"] for r in got)


# --- pipeline


def test_pipeline_against_brute_force(spark, sf_dir, voc):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    kept = [d for d, s in zip(rows, model.scorer()([r["text"] for r in rows.values()])) if s >= 0.5]
    norm = {d: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[d]["text"]) for d in kept}
    last = {}
    for d in sorted(kept):
        last[norm[d]] = d
    left = [d for d, _ in test_near.groups([(d, rows[d]["text"]) for d in last.values()])]
    mixed = brute.mix([(d, rows[d]["source"], rows[d]["text"]) for d in left])
    want = Counter({d: taken // size for d, size, _, _, taken in mixed if taken})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == want and all(r["lossless"] for r in got)
    for r in got:
        assert r["piece_ids"] == sentencepiece_codec.encode_batch([rows[r["doc_id"]]["text"]], [str(r["doc_id"])], voc)[0].tolist()


def test_stages_on_odd_tables(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 1, 2), (1, None, None, None, None, 1, 2), (2, "", "en", "s", 0, 1, 2), (None, "a b", "en", "s", 3, 1, 2), (3, "a B", "en", "s", 3, 1, 2)],
        "doc_id long, text string, lang string, source string, n_chars long, row int, fp int",
    )
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf_dir).count() == 0
        out = step(spark, odd, sf_dir)
        assert name == "SentencePiece" or out.columns == odd.columns
        out.collect()
    assert corpus_pipeline.exact(spark, odd, sf_dir).count() == 2
