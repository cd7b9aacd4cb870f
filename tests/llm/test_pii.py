import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyscope.llm import pii
from tallyscope.llm.common import table
from tallyscope.llm.queries import PLANS

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def fits(kind, m):
    digits = "".join(c for c in m if c in "0123456789")
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), at, f"{k}:{m.start()}:{m.end()}") for at, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(k, m[0])]
    joined = ",".join(s for _, _, s in sorted(found))
    return [sum(at == k for _, k, _ in found) for at in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined


def check(rows, texts):
    assert len(rows) == len(texts)
    n = 0
    for r in rows:
        counts, sha, joined = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == sha
        assert ",".join(s for s in r["spans"].split(",") if s and not s.startswith("term:")) == joined
        n += sum(counts)
    return n


ODD = {
    1: None, 2: "", 3: "a@b.c_d@e.f a@b.c.@x.y é@ü.de .x@y.z.w. a@@b.c q@r.", 4: "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3",
    5: "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 41111111111111111 5" * 3, 6: "+1 (555) 010-9999 +49..30 1234567890 +1-2 +123456789012345678",
    7: "😀 x@y.zz 😀\n+1 (555) 010-9999 and 10.0.0.1", 8: "9" * 30000 + " a" * 20000 + "b" * 50000, 9: "1.1.1.1 " * 3000, 10: "a.b" * 5000 + "@" + "c.d" * 5000,
}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], "doc_id long, text string, row int, kind string, hits int")


def test_base_spans_match_plain_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    assert check(PLANS["op5_pii"](spark, sf_dir).collect(), texts) > 10


def test_cases(spark):
    assert check(pii.report(frame(spark, ODD.items())).collect(), ODD) > 3000
    assert pii.report(frame(spark, [])).count() == 0
    assert pii.report(frame(spark, [(None, "a@b.cc"), (None, "a@b.cc")])).count() == 2


TOLD = [(i, f"badge holder mail x{i}@site.org today\nplain line {i}") for i in range(8)] + [(100 + i, f"today the mail {i}\nholder of a line") for i in range(8)]


def test_telling_terms_are_marked_in_lines_with_entities_only(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, TOLD)).collect()}
    # `badge` stands only where an address does: 8 of 8 lines; `mail`, `today` and `holder` stand in 8 of 16.
    assert got[3] == "term:0:5,email:18:29"
    assert all(not got[100 + i] for i in range(8))


def plain_terms(texts):
    """Term spans by plain loops over lines: every term is scored, however few lines it has."""
    lines, both, kinds, n = Counter(), Counter(), Counter(), 0
    held = []
    for d, text in texts:
        spans = [tuple(s.split(":")) for s in brute(text)[2].split(",") if s]
        at = 0
        for line in text.split("\n"):
            inside = [(k, int(a), int(b)) for k, a, b in spans if at <= int(a) <= at + len(line) and int(a) < at + len(line) + 1]
            words = [(m.start() + at, m.end() + at, m.group().lower()) for m in re.finditer(r"[^\W\d_]{2,}", line)]
            n += 1
            lines.update({w for _, _, w in words})
            free = [w for w in words if not any(int(a) < w[1] and w[0] < int(b) for _, a, b in inside)]
            for k in {k for k, _, _ in inside}:
                kinds[k] += 1
                both.update({(k, w[2]) for w in free})
                held.append((d, k, free))
            at += len(line) + 1
    out = set()
    for d, k, free in held:
        p = kinds[k] / n
        for a, b, w in free:
            given = (both[k, w] - 1 + pii.PRIOR * p) / (lines[w] - 1 + pii.PRIOR)
            if p < 1 and math.log2(given / p) / -math.log2(p) >= pii.GENERALISE:
                out.add((d, a, b))
    return out


def test_term_spans_match_plain_loops(spark):
    rng = random.Random(7)
    names = [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    texts = []
    for d in range(60):
        out = []
        for _ in range(rng.randrange(1, 7)):
            words = [rng.choice(["the", "of", "mail", "call", "note"]) for _ in range(rng.randrange(1, 6))]
            if rng.random() < 0.4:
                i = rng.randrange(20)
                words += [names[i], ["a@b.cc", "+1 555 0100 999", "10.0.0.1"][i % 3]]
            elif rng.random() < 0.1:
                words.append(rng.choice(names))
            out.append(" ".join(words))
        texts.append((d, "\n".join(out)))
    got = {(r["doc_id"], int(s.split(":")[1]), int(s.split(":")[2])) for r in pii.report(frame(spark, texts)).collect() for s in r["spans"].split(",") if s.startswith("term:")}
    want = plain_terms(texts)
    assert got == want and len(want) > 30


def test_a_name_of_two_lines_is_not_left_out(spark):
    rows = [(i, f"the note of line {i}\nand the rest") for i in range(60)] + [(90, "the note of zebulon a@b.cc"), (91, "zebulon: b@b.cc")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, rows)).collect()}
    assert "term:12:19" in got[90].split(",") and "term:0:7" in got[91].split(",") and not any(got[i] for i in range(60))


def test_sanitised_text(spark):
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, [*TOLD, (200, None), (201, "call +1 (555) 010-9999, 10.0.0.1!")])).collect()}
    assert out[3] == " holder mail [EMAIL] today\nplain line 3"
    assert out[100] == TOLD[8][1] and out[200] == "" and out[201] == "call [PHONE], [IP]!"


def test_no_python_in_the_plan(spark, sf_dir):
    rows, spans = pii.find(table(spark, sf_dir, "documents").limit(5))
    plan = spans.join(rows, "row").select(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
