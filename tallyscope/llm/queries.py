"""One query per operator, over whole tables, with its check SQL where SQL can express the result.

op2 to op6, op8, op11 and op12 have no SQL: trees, sampling, XXH64, corpus statistics over word occurrences, trained compressors, eigenvectors, token ids and
all 13-word windows are beyond it or too slow on whole tables.  Their tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.llm import (
    collocations,
    exact_dedup,
    html_text,
    mixing,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    url_filters,
    whitening,
)
from tallyscope.llm.common import table
from tallyscope.llm.registry import PLANS, SQL, query  # noqa: F401

# The rules of the contract.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_url_filters", r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN r
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)""")
def _op1(spark, d):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, d, "pages"), rules)


@query("op7_mixing", rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
by0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
by1 AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM by0),
by2 AS (SELECT source, source_size, weight,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_words,
    (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_weight, row_number() OVER r AS n
  FROM by1 WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST)),
lim AS (SELECT min(n) AS n FROM by2 WHERE 3 * source_size::HUGEINT * left_weight > left_words::HUGEINT * weight),
rate AS (SELECT lim.n, left_words / left_weight AS rate FROM lim LEFT JOIN by2 ON by2.n = lim.n),
goals AS (SELECT source, source_size, CASE WHEN rate.n IS NULL OR by2.n < rate.n THEN (3 * source_size)::DOUBLE ELSE rate.rate * weight END AS target
  FROM by2, rate),
j AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, target - whole * source_size AS rest FROM j),
f AS (SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END AS f,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM k),
q AS (SELECT *, CASE WHEN size > 0 AND f > 0 AND f < 1 THEN (u / (1 - u)) / ((size / (size + 32.0::DOUBLE)) * f / (1 - f)) END AS rank FROM f),
w AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) END AS to_here FROM q)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * (whole + CASE WHEN rank IS NULL OR to_here - size > rest THEN 0
    WHEN to_here <= rest OR to_here - rest <= rest - (to_here - size) THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM w""")
def _op7(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_exact_dedup", """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM n""")
def _op9(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents"))


def _removed(chars: str) -> str:
    return f"(length(t) - length(translate(t, '{chars}', '')))"


@query("op10_quality_rules", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT r, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM x WINDOW s AS (PARTITION BY r ORDER BY i)),
z AS (SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS again FROM y),
v AS (SELECT r, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM z),
rep AS (SELECT r, count(*) FILTER (hit) AS n_repeat_words FROM v GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(translate(t, {WS}, ''))::BIGINT AS word_chars,
    {_removed("#*$%&|<>")}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda q: NOT regexp_matches(q, '\p{{L}}'))) AS no_letters
  FROM d JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * {_removed("0123456789")} > 3 * word_chars OR 10 * {_removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} > 6 * word_chars
    OR 2 * no_letters > n_words) AS kept
FROM f""")
def _op10(spark, d):
    return quality_rules.judge(table(spark, d, "documents")).drop("failed_rule")


@query("op4_simhash")
def _op4(spark, d):
    return simhash.near_groups(table(spark, d, "documents"))


@query("op6_quality_classifier")
def _op6(spark, d):
    docs = table(spark, d, "documents")
    return quality_classifier.classify(docs, quality_classifier.learn(docs, table(spark, d, "labels")))


@query("op8_substring_dedup")
def _op8(spark, d):
    out = substring_dedup.remove_repeats(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_sentencepiece")
def _op3(spark, d):
    """Sampled piece ids of every document, digested, and what they decode to."""
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, d, "documents").select("doc_id", "text")))
    return both.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.hex(F.xxhash64("piece_ids")).alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@query("op5_pii")
def _op5(spark, d):
    return pii.report(table(spark, d, "documents"))


@query("op2_html_text")
def _op2(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@query("op11_whitening")
def _op11(spark, d):
    """Deviations beyond 63 bits are null: the contract's column is a long."""
    return whitening.whiten(table(spark, d, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query("op12_packing")
def _op12(spark, d):
    placed = packing.pack(table(spark, d, "documents"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", F.col("offset").cast("long"))


@query("op13_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, k, phrase, ws, f AS a, unnest(range(1, k)) AS j FROM c),
sc AS (SELECT cut.lang, cut.phrase, a, t.n, j, l.f AS l, r.f AS r,
    (1000::HUGEINT * a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN t ON t.lang = cut.lang JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.ws[1:cut.j], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.ws[cut.j + 1:cut.k], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) q(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept)
SELECT * FROM z WHERE rank <= 2000""")
def _op13(spark, d):
    return collocations.collocations(table(spark, d, "documents"))
