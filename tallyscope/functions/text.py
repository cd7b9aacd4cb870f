"""Text patterns as JVM regular-expression columns; no Python per row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.joins import bounded

WORD_CHAR = r"\p{L}\p{N}_"


def whole_word(term: str) -> str:
    """Pattern for `term` as a whole word.  It starts with the literal, so a scan compares characters until a hit."""
    t = re.escape(term)
    return f"{t}(?<![{WORD_CHAR}]{t})(?![{WORD_CHAR}])"


def words_of(text: Column) -> Column:
    """The words of a text in order, cut once, whatever they are looked up in."""
    return F.regexp_extract_all(text, F.lit(rf"([{WORD_CHAR}]+)"), F.lit(1))


def mentions(text: Column, terms: Sequence[str]) -> Column:
    """Array of the terms that occur in the text as whole words, in the order given.

    Terms of one word are an intersection with the text's words, one hash set per text; only longer ones are searched for.
    """
    single = [t for t in terms if re.fullmatch(r"\w+", t)]
    found = F.array_intersect(F.array(*[F.lit(t) for t in single]).cast("array<string>"), words_of(text))
    if len(single) == len(terms):
        return F.coalesce(found, F.array().cast("array<string>"))
    longer = [F.when(text.contains(t) & text.rlike(whole_word(t)), F.lit(t)) for t in terms if t not in single]
    either = F.concat(F.coalesce(found, F.array().cast("array<string>")), F.array_compact(F.array(*longer)))
    return F.array_intersect(F.array(*[F.lit(t) for t in terms]), either)


def name_mentions(rows: DataFrame, key: str, text: str, names: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(key, …carry, name, …): a row for every place where a text has a name as a whole word.

    An inverted lookup: a text is cut once before each of its words, and every cut meets, for each number of words that
    names have, the names that consist of just the words it starts with: one equi-join on all words of a name with what stands
    between them.  Names that begin alike do not meet each other's texts; the cost is the text plus the hits, however
    many names there are.  What a name has before its first and behind its last word is verified by position; a name
    without any word never matches.
    """
    word_start = rf"(?<![{WORD_CHAR}])(?=[{WORD_CHAR}])"
    known = names.filter(F.col("name").rlike(f"[{WORD_CHAR}]")).withColumns({
        "_lead": F.regexp_extract("name", f"^([^{WORD_CHAR}]*)", 1), "_trail": F.regexp_extract("name", f"([^{WORD_CHAR}]*)$", 1),
        "_core": F.regexp_replace("name", f"^[^{WORD_CHAR}]+|[^{WORD_CHAR}]+$", "")})
    sizes = known.agg(F.coalesce(F.array_sort(F.collect_set(F.size(words_of(F.col("_core"))))), F.array().cast("array<int>"))).scalar()
    cuts = rows.select(key, *carry, F.split(text, word_start, -1).alias("_s")).withColumn(
        "_w", F.transform("_s", lambda s: F.regexp_extract(s, rf"^([{WORD_CHAR}]+)", 1))
    ).withColumn("_g", F.zip_with("_s", "_w", lambda s, w: F.substr(s, F.length(w) + 1)))

    def around(w: Column, i: Column) -> Column:
        """Of the cut before word `i` one entry per number of words that fits into the rest of the text."""

        def entry(n: Column) -> Column:
            last = i + n - 1
            # The piece before a word is needed for names that start with other characters, and for nothing else.
            return F.struct(
                F.concat(F.array_join(F.slice("_s", i + 1, n - 1), ""), F.get("_w", last)).alias("_core"), F.get("_g", last).alias("_behind"),
                (i + n < F.size("_s")).alias("_more"), F.coalesce(F.get("_g", i - 1), F.lit("")).alias("_before"),
                (F.coalesce(F.get("_w", i - 1), F.lit("")) != "").alias("_word_before"))

        return F.transform(F.filter("_sizes", lambda n: (w != "") & (i + n <= F.size("_s"))), entry)

    at = cuts.withColumn("_sizes", sizes).select(key, *carry, F.inline(F.flatten(F.transform("_w", around))))
    met = at.join(bounded(known), "_core")
    # In front of a leading sign there must be no word character either, nor behind a trailing one.
    front = (F.col("_lead") == "") | (F.col("_before").endswith(F.col("_lead")) & ((F.length("_before") > F.length("_lead")) | ~F.col("_word_before")))
    back = F.col("_behind").startswith(F.col("_trail")) & ((F.col("_trail") == "") | (F.length("_behind") > F.length("_trail")) | ~F.col("_more"))
    return met.filter(front & back).drop("_core", "_behind", "_more", "_before", "_word_before", "_lead", "_trail")


# A number with optional approximation marker, currency sign and unit.
NUMBER = (
    r"(?i)(?<![A-Za-z])(?:≈|~|about\s+|roughly\s+)?\$?(?:-?\d{1,3}(?:,\d{3})+|-?\d+(?:\.\d+)?)"
    r"(?:\s*%|\s*x|\s*×|\s*bps)?"
)
# Words that decide whether a bare number is a metric.
METRIC_WORDS = [
    "index", "indices", "share", "shares", "rate", "rates", "pct", "percent", "percentage", "percentages", "points",
    "basis", "ratio", "ratios", "multiplier", "multipliers", "premium", "discount", "uplift", "lift", "delta",
    "deltas", "change", "growth",
]
STRUCTURAL_FOLLOWERS = [
    "merchant", "merchants", "store", "stores", "zone", "zones", "region", "regions", "week", "weeks", "month",
    "months", "day", "days", "year", "years", "quarter", "quarters", "category", "categories", "subcategory",
    "subcategories", "customer", "customers", "shopper", "shoppers", "transaction", "transactions", "txn", "txns",
    "basket", "baskets", "order", "orders", "brand", "brands", "banner", "banners", "product", "products", "sku",
    "skus", "site", "sites", "location", "locations", "period", "periods", "row", "rows",
]
STRUCTURAL_PREFIXES = [
    "zone", "z", "region", "q", "quarter", "period", "phase", "step", "stage", "tier", "wave",
]

OUTER = 64  # characters kept at either end of a long gap between two numbers; they hold its two outer words


def number_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, skipped, left, right): every numeric token with the text around it that decides its kind.

    `skipped` is the length of the gap before the token.

    Texts are cut once into tokens and the gaps between them.  The two words on either side of a token lie within
    two neighbouring tokens and three gaps.  Of a long gap only its two ends are carried, where each has three words, so that the outer
    two are whole; else all of it.
    """
    cut = df.filter(F.col(text).rlike(r"\d")).select(
        key,
        F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)).alias("_t"),
        F.split(text, NUMBER, -1).alias("_g"),
    )
    three = rf"(?:[{WORD_CHAR}]+[^{WORD_CHAR}]+){{2}}[{WORD_CHAR}]"

    def ends(g: Column) -> Column:
        left, right = F.substring(g, 1, OUTER), F.substring(g, -OUTER, OUTER)
        return F.when((F.length(g) > 2 * OUTER) & left.rlike(three) & right.rlike(three), F.concat(left, F.lit(" "), right)).otherwise(g)

    cut = cut.select(key, "_t", F.transform("_g", F.length).alias("_n"), F.transform("_g", ends).alias("_g"))

    def token(i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get("_t", i)), F.lit(""))

    def gap(i: Column) -> Column:
        return F.coalesce(F.when(i >= 0, F.get("_g", i)), F.lit(""))

    def around(t: Column, i: Column) -> Column:
        left = F.concat(gap(i - 2), token(i - 2), gap(i - 1), token(i - 1), gap(i))
        right = F.concat(gap(i + 1), token(i + 1), gap(i + 2), token(i + 2), gap(i + 3))
        return F.struct(t.alias("token"), F.get("_n", i).alias("skipped"), left.alias("left"), right.alias("right"))

    return cut.select(key, F.posexplode(F.transform("_t", around)).alias("pos", "_x")).select(key, "pos", "_x.*")


def number_kind(token: Column, left: Column, right: Column) -> Column:
    """'metric' (must trace to a value) or 'structural' (a plain count or label)."""
    words = F.lit(rf"([{WORD_CHAR}]+)")
    before = F.transform(F.regexp_extract_all(left, words, F.lit(1)), F.lower)
    before = F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2))
    after = F.slice(F.transform(F.regexp_extract_all(right, words, F.lit(1)), F.lower), 1, 2)
    approx = left.rlike(r"(?i)(?:≈|~|about\s++|roughly\s++)$|[≈~]\s++$")
    sigil = token.rlike(r"(?i)[%$.]|(?:x|×|bps)$")
    metric_words = F.array(*[F.lit(w) for w in METRIC_WORDS])
    return (
        F.when(sigil | approx, "metric")
        .when(F.coalesce(F.get(after, F.lit(0)).isin(STRUCTURAL_FOLLOWERS), F.lit(False)), "structural")
        .when(F.coalesce(F.get(before, F.size(before) - 1).isin(STRUCTURAL_PREFIXES), F.lit(False)), "structural")
        .when(F.arrays_overlap(F.concat(before, after), metric_words), "metric")
        .otherwise("structural")
    )


def number_value(token: Column) -> Column:
    digits = F.regexp_extract(token, r"(-?\d{1,3}(?:,\d{3})+|-?\d+(?:\.\d+)?)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).cast("double")
