"""Personal data: four base kinds by pattern, and the terms around them that give them away.  DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, each kind on its own.  The patterns are written
with possessive quantifiers and a look-behind at the start of a run, which finds the same matches in linear time.

Terms: a term is a run of letters, A-Z lower-cased.  Over all lines of the corpus, p(c) is the share of lines with an
entity of kind c and p(c|t) that share among the lines with term t.  The disclosure of c by t is the pointwise mutual
information log2(p(c|t) / p(c)) divided by the information of c, -log2 p(c): 0 if the term says nothing, 1 if it gives the kind
away for certain.  p(c|t) comes from the other lines with t, leaving out the line that is judged, and PRIOR lines of the
corpus's share p(c) beside them.  That damps terms of few lines without a floor: two lines are enough to be generalised, and
a word that no other line has tells nothing that the corpus knows.  In lines that hold an entity of kind c, terms that disclose
c by GENERALISE or more are generalised (to [TERM]), by REMOVE or more removed.  Other lines are left alone.

Places of matches are sums of gap and match lengths, taken by a window per document over exploded rows, so that a text
with very many matches stays linear.  One scan of the texts finds the matches and writes them with a row number to the
shared folder; a second counts term lines, combined before the shuffle; only documents with matches are touched again.

Cases: null texts are empty; rows that repeat are worked on one by one; a null doc_id is carried along; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import ascii_lower, stage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
TERMS = r"\p{L}{2,}+"
GENERALISE, REMOVE, PRIOR = 0.75, 0.95, 0.5


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_PARTS)
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    return n.between(10, 15)


def matches(docs: DataFrame) -> DataFrame:
    """docs with `hits`: per match of a kind in its order the gap before it, its length and whether it counts."""
    for k in KINDS:
        docs = docs.withColumn(f"_{k}", F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)))
    empty = F.array().cast("array<struct<kind:int,gap:bigint,len:bigint,ok:boolean>>")

    def hit(at: int, kind: str):
        return lambda m, g: F.struct(
            F.lit(at).alias("kind"), g.alias("gap"), F.length(m).cast("long").alias("len"), F.coalesce(valid(kind, m), F.lit(False)).alias("ok"))

    parts = []
    for at, k in enumerate(KINDS):
        gaps = F.transform(F.split("text", PATTERNS[k], -1), lambda g: F.length(g).cast("long"))
        # The gap behind the last match has no match.
        hits = F.slice(F.zip_with(f"_{k}", gaps, hit(at, k)), F.lit(1), F.size(f"_{k}"))
        parts.append(F.when(F.size(f"_{k}") > 0, hits).otherwise(empty))
    return docs.withColumn("hits", F.concat(*parts)).drop(*[f"_{k}" for k in KINDS])


def base_spans(hits: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the matches that count, code points, end exclusive."""
    rows = hits.select("row", F.posexplode("hits").alias("i", "h")).select("row", "i", "h.*")
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w))
    return rows.filter("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def lines_of(texts: DataFrame) -> DataFrame:
    """(row, line, start, text) of every line."""
    rows = texts.select("row", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    w = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.sum(F.length("t") + 1).over(w) - F.length("t") - 1)


def entity_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, line, kind), distinct: the lines that hold an entity."""
    both = lines.select("row", "start", F.lit(None).cast("int").alias("kind"), "line").unionByName(
        spans.select("row", "start", "kind", F.lit(None).cast("int").alias("line")))
    w = Window.partitionBy("row").orderBy("start", F.col("kind").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line", F.last("line", ignorenulls=True).over(w)).filter("kind IS NOT NULL").select("row", "line", "kind").distinct()


def terms_of(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, line, start, end, term) of the terms of the lines given, without those inside an entity."""
    words = F.regexp_extract_all("t", F.lit(TERMS), F.lit(0))
    rows = lines.withColumn("w", words).withColumn("g", F.split("t", TERMS, -1)).select(
        "row", "line", F.col("start").alias("at"),
        F.posexplode(F.slice(F.zip_with("w", "g", lambda w, g: F.struct(w.alias("w"), F.length(g).alias("gap"))), F.lit(1), F.size("w"))).alias("i", "x"),
    )
    w = Window.partitionBy("row", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.col("at") + F.sum(F.col("x.gap") + F.length("x.w")).over(w))
    rows = rows.select("row", "line", (F.col("end") - F.length("x.w")).alias("start"), "end", ascii_lower(F.col("x.w")).alias("term"))
    both = rows.unionByName(spans.select("row", F.lit(None).cast("int").alias("line"), "start", "end", F.lit(None).cast("string").alias("term")))
    before = Window.partitionBy("row").orderBy("start", F.col("term").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("term").isNull(), F.col("end"))).over(before)
    return both.withColumn("reach", reach).filter("term IS NOT NULL AND coalesce(reach, 0) <= start").drop("reach")


def term_lines(docs: DataFrame) -> DataFrame:
    """(term, lines): in how many lines of the corpus each term stands.  The term null counts all lines."""
    lines = docs.select(F.explode(F.split(ascii_lower(F.coalesce("text", F.lit(""))), "\n")).alias("t"))
    found = F.array_distinct(F.regexp_extract_all("t", F.lit(TERMS), F.lit(0)))
    rows = lines.select(F.explode(F.array_append(found, F.lit(None).cast("string"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("lines"))


def disclosures(seen: DataFrame, in_lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, term, disclosure) of terms that reach GENERALISE.  seen: (row, line, kind, term), distinct."""
    total = counts.filter("term IS NULL").select(F.col("lines").alias("all_lines"))
    kinds = in_lines.groupBy("kind").agg(F.count(F.lit(1)).alias("kind_lines"))
    both = seen.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("both"))
    d = both.join(counts.filter("term IS NOT NULL"), "term").join(F.broadcast(kinds), "kind")  # one row per kind: four
    d = d.withColumn("p", F.col("kind_lines") / total.scalar())
    given = (F.least("both", "lines") - 1 + PRIOR * F.col("p")) / (F.col("lines") - 1 + PRIOR)
    pmi = F.log2(given / F.col("p"))
    d = d.withColumn("disclosure", F.when(F.col("p") < 1, pmi / -F.log2("p")).otherwise(0.0))
    return d.filter(F.col("disclosure") >= GENERALISE).select("kind", "term", "disclosure")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has row and doc_id, spans row, kind (place in KINDS, behind them TERM), start, end, action."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = matches(texts).withColumn("row", F.monotonically_increasing_id())
    hit = F.exists("hits", lambda h: h["ok"])
    found = stage(found.select("row", "doc_id", "hits", F.when(hit, F.col("text")).alias("text")), "matches")
    base = stage(base_spans(found.select("row", "hits")), "base-spans")
    lines = lines_of(found.filter("text IS NOT NULL").select("row", "text"))
    in_lines = stage(entity_lines(lines, base), "entity-lines")
    terms = stage(terms_of(lines.join(in_lines, ["row", "line"], "left_semi"), base), "terms")
    seen = terms.join(in_lines, ["row", "line"]).select("row", "line", "kind", "term").distinct()
    risky = stage(disclosures(seen, in_lines, term_lines(docs)), "risky")
    told = terms.join(in_lines, ["row", "line"]).join(risky, ["kind", "term"])
    told = told.groupBy("row", "start", "end").agg(F.max("disclosure").alias("d"))
    told = told.select(
        "row", F.lit(len(KINDS)).alias("kind"), "start", "end", F.when(F.col("d") >= REMOVE, F.lit("remove")).otherwise("generalise").alias("action"))
    return found.select("row", "doc_id"), base.withColumn("action", F.lit("mask")).unionByName(told)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans."""
    rows, spans = find(docs)
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    text = F.concat_ws(":", F.get(names, F.col("kind")), F.col("start").cast("string"), F.col("end").cast("string"))
    per = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == at, 1)).alias(f"n_{k}") for at, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.struct("start", "kind", text.alias("s")))).alias("all"),
    )
    out = rows.join(per, "row", "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,s:string>>"))
    joined = [F.array_join(F.transform(x, lambda e: e["s"]), ",") for x in (F.filter(every, lambda e: e["kind"] < len(KINDS)), every)]
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined[0], 256).alias("base_sha256"), joined[1].alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the text with entities masked by their kind and telling terms generalised or removed."""
    texts = stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "texts")
    rows, spans = find(texts)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])
    put = F.when(F.col("action") == "remove", F.lit("")).otherwise(F.get(names, F.col("kind")))
    # Of overlapping spans the one that starts first stands for all that it touches.
    reach = F.max("end").over(Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    run = F.sum("new").over(Window.partitionBy("row").orderBy("start", "kind", "end"))
    runs = runs.withColumn("run", run).groupBy("row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind", put.alias("put"))).alias("p"))
    per = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("p.put").alias("put")))).alias("runs"))
    # The row numbers of `find` count the rows of the same written table in the same order.
    keyed = texts.withColumn("row", F.monotonically_increasing_id()).join(per, "row", "left")
    n = F.size("runs")
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(
        F.substring("text", F.coalesce(F.get("runs", i - 1)["end"], F.lit(0)).cast("int") + 1,
                    (F.coalesce(F.get("runs", i)["start"], F.length("text")) - F.coalesce(F.get("runs", i - 1)["end"], F.lit(0))).cast("int")),
        F.coalesce(F.get("runs", i)["put"], F.lit("")),
    ))
    return keyed.select("doc_id", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(cut, "")).alias("text"))
