"""Verification of stated numbers against result tables, for many answers at once.

Results are tidy rows (frame, row_id, dims, column, value); a claim names a column, a conjunction of dimension
values and, for several rows, an aggregate.  Lookup is a relational division: equal cells are summed into profiles, both
the filter entries of the claims and the dimensions of the profiles become (name, value) rows, and a claim meets the
profiles under the values of its rarest name.  Lists of several names are never multiplied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.money import ratio
from tallyscope.functions.text import mentions, name_mentions, number_kind, number_tokens, number_value

TOLERANCE = 0.01
EXACT = 1e-9
# Frames in the order in which an untagged lookup tries them.
FRAME_ORDER = ("merged", "tenant", "lake")


def cell_profiles(results: DataFrame) -> DataFrame:
    """(frame, column, dims, n, filled, s): result rows of one frame with equal dimensions as one row."""
    entries = F.array_sort(F.filter(F.map_entries("dims"), lambda e: e["value"].isNotNull()))
    return results.select("frame", "column", "value", entries.alias("_e")).groupBy("frame", "column", "_e").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.sum("value").alias("s")
    ).withColumn("dims", F.map_from_entries(F.coalesce("_e", F.array().cast("array<struct<key:string,value:string>>")))).drop("_e")


def filter_entries(lookups: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """(…id_cols, column, name, value): one row per listed value, however many names a filter has."""
    each = lookups.select(*id_cols, "column", F.explode("row_filter").alias("name", "_values"))
    return each.select(*id_cols, "column", "name", F.explode(F.array_compact(F.array_distinct("_values"))).alias("value"))


def leading_names(lookups: DataFrame, profiles: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """(…id_cols, name): of each filter the name whose listed values have the fewest profiles; none if a name has no profile."""
    spread = profiles.select("column", F.explode("dims").alias("name", "value")).groupBy("column", "name", "value").agg(F.count(F.lit(1)).alias("_spread"))
    cost = filter_entries(lookups, id_cols).join(spread, ["column", "name", "value"], "left").groupBy(*id_cols, "name").agg(
        F.coalesce(F.sum("_spread"), F.lit(0)).alias("_cost"))
    least = cost.groupBy(*id_cols).agg(F.min(F.struct("_cost", "name")).alias("_least"))
    return least.filter("_least._cost > 0").select(*id_cols, F.col("_least.name").alias("name"))


def resolve_lookups(lookups: DataFrame, results: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """True value of each lookup (…id_cols, frame, row_filter, column, agg), NULL when it does not resolve.

    `row_filter` is map<string, array<string>>: several values mean any of them; an empty map takes all rows of a frame.
    No row, or several rows without `agg`, leave a frame unresolved, and so does a NULL cell among the rows; without
    `frame` the first frame that resolves wins.  A NULL dimension value or filter value matches nothing.
    """
    profiles = cell_profiles(results)
    asked = lookups.withColumnRenamed("frame", "_want")
    by_name = asked.join(leading_names(lookups, profiles, id_cols), list(id_cols))
    keys = by_name.withColumn("value", F.explode(F.array_compact(F.array_distinct(F.element_at("row_filter", F.col("name"))))))
    posted = profiles.withColumn("_one", F.explode(F.map_entries("dims"))).select(
        "frame", "column", F.col("_one.key").alias("name"), F.col("_one.value").alias("value"), "dims", "n", "filled", "s")
    holds = F.forall(F.map_entries("row_filter"), lambda e: F.coalesce(
        F.array_contains(e["value"], F.try_element_at("dims", e["key"])), F.lit(False)))
    wanted = F.col("_want").isNull() | (F.col("_want") == F.col("frame"))
    shape = [*id_cols, "frame", "agg", "n", "filled", "s"]
    met = keys.join(posted, ["column", "name", "value"]).filter(wanted & holds).select(*shape)
    # Claims without a filter take the sums of whole frames.
    whole = profiles.groupBy("frame", "column").agg(*[F.sum(c).alias(c) for c in ("n", "filled", "s")])
    every = asked.filter(F.size("row_filter") == 0).join(whole, "column").filter(wanted).select(*shape)
    per_frame = met.unionByName(every).groupBy(*id_cols, "frame", "agg").agg(*[F.sum(c).alias(c) for c in ("n", "filled", "s")])
    value = (
        F.when(F.col("filled") < F.col("n"), None)
        .when(F.col("n") == 1, F.col("s")).when(F.col("agg") == "sum", F.col("s"))
        .when(F.col("agg") == "mean", F.col("s") / F.col("n"))
    )
    order = F.array_position(F.array(*[F.lit(f) for f in FRAME_ORDER]), F.col("frame"))
    best = per_frame.withColumn("v", value).filter(F.col("v").isNotNull()).groupBy(*id_cols).agg(
        F.min_by(F.struct("frame", "v"), F.struct(order, "frame")).alias("_hit")
    )
    return lookups.select(*id_cols).join(best, list(id_cols), "left").select(
        *id_cols, F.col("_hit.frame").alias("resolved_frame"), F.col("_hit.v").alias("true_value")
    )


def claim_cell_lookup(claims: DataFrame, results: DataFrame) -> DataFrame:
    return resolve_lookups(claims, results, ["claim_id"]).withColumn(
        "status", F.when(F.col("true_value").isNull(), "unresolved").otherwise("resolved")
    )


def claim_value_ref(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(claim_id, by, value, metric[, agg, frame]): mean (or sum) of a metric where `by` = value."""
    agg = F.coalesce("agg", F.lit("mean")) if "agg" in claims.columns else F.lit("mean")
    frame = F.coalesce("frame", F.lit("lake")) if "frame" in claims.columns else F.lit("lake")
    lookups = claims.select(
        "claim_id", frame.alias("frame"), F.map_from_arrays(F.array("by"), F.array(F.array("value"))).alias("row_filter"),
        F.col("metric").alias("column"), agg.alias("agg"),
    )
    return resolve_lookups(lookups, results, ["claim_id"]).select("claim_id", "true_value")


def claim_derivation(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(claim_id, op, agg, operands array<struct<frame,row_filter,column,agg>>): arithmetic over resolved cells.

    An unresolved operand or a zero denominator leaves the claim unresolved.
    """
    each = claims.select("claim_id", F.posexplode("operands").alias("i", "o")).select("claim_id", "i", "o.*")
    got = resolve_lookups(each, results, ["claim_id", "i"])
    v = F.col("true_value")
    per = got.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("k"), F.sum(v).alias("s"),
        F.max(F.when(F.col("i") == 0, v)).alias("a"), F.max(F.when(F.col("i") == 1, v)).alias("b"),
    )
    a, b, two = F.col("a"), F.col("b"), F.col("n") == 2
    op, whole = F.col("op"), F.col("n") == F.col("k")
    out = (
        F.when(two & (op == "difference"), a - b).when(two & (op == "ratio"), ratio(a, b))
        .when(two & (op == "pct_change"), ratio(a - b, b))
        .when((op == "aggregate") & (F.col("agg") == "sum"), F.col("s"))
        .when((op == "aggregate") & (F.col("agg") == "mean"), F.col("s") / F.col("n"))
    )
    return claims.select("claim_id", "op", "agg").join(per, "claim_id", "left").select(
        "claim_id", "op", F.when(whole, out).alias("true_value")
    )


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def disposition(stated: Column, true: Column, tolerance: float = TOLERANCE) -> Column:
    """passed / normalized / stripped; NaN and unresolved values are stripped, 0 against 0 passes."""
    return (
        F.when(stated.isNull() | true.isNull() | F.isnan(stated) | F.isnan(true), "stripped")
        .when(_close(stated, true, EXACT), "passed").when(_close(stated, true, tolerance), "normalized")
        .otherwise("stripped")
    )


def claim_disposition(claims: DataFrame, stated: str = "value", true: str = "true_value") -> DataFrame:
    status = disposition(F.col(stated), F.col(true))
    reason = (
        F.when(status == "normalized", F.lit("within tolerance")).when(F.col(true).isNull(), F.lit("unresolved"))
        .when(status == "stripped", F.lit("differs from the resolved value"))
    )
    return claims.withColumns({"status": status, "reason": reason})


def claim_recompute_audit(stated: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stated against recomputed values: |difference| within 1e-6 + 1 % of the larger."""
    a, b = F.col("stated"), F.col("recomputed")
    return stated.join(recomputed, list(keys), "left").withColumn(
        "match", F.coalesce(F.abs(a - b) <= F.lit(1e-6) + 0.01 * F.greatest(F.abs(a), F.abs(b)), F.lit(False))
    )


# Words stating a movement.
DIRECTION_UP = [
    "increase", "increased", "increases", "increasing", "rose", "rise", "rises", "rising", "grew", "grow", "grows",
    "growing", "growth", "gained", "gain", "gains", "up", "higher", "climbed", "jumped", "surged", "rallied",
]
DIRECTION_DOWN = [
    "decrease", "decreased", "decreases", "decreasing", "fell", "fall", "falls", "falling", "declined", "decline",
    "declines", "declining", "dropped", "drop", "drops", "dropping", "down", "lower", "lost", "shrank", "shrink",
    "shrinking", "slipped", "sank", "plunged",
]


def direction_contradiction(
    rows: DataFrame, text: str, signed: str, up: Sequence[str] = DIRECTION_UP, down: Sequence[str] = DIRECTION_DOWN
) -> DataFrame:
    """Rows whose text states one direction while the signed value has the other; mixed wording gives no verdict."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    says_up = F.arrays_overlap(words, F.array(*[F.lit(w) for w in up]))
    says_down = F.arrays_overlap(words, F.array(*[F.lit(w) for w in down]))
    v = F.col(signed)
    flagged = rows.withColumns({"says_up": says_up, "says_down": says_down})
    u, d = F.col("says_up"), F.col("says_down")
    return flagged.withColumn("contradiction", (u & ~d & (v < 0)) | (d & ~u & (v > 0)))


def numeric_token_scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Every number of every text, with position, value and metric/structural kind."""
    tok, left, right = F.col("token"), F.col("left"), F.col("right")
    return number_tokens(rows, key, text).select(
        key, "pos", "token", number_value(tok).alias("value"), number_kind(tok, left, right).alias("kind")
    )


def claim_undeclared_numbers(rows: DataFrame, key: str, text: str, declared: DataFrame) -> DataFrame:
    """(key, start, end, token, value) of metric numbers that overlap no declared span of their text.

    declared: (key, start, end), code points, end exclusive: the spans of claims that passed, and of those that failed
    and are handled as claims.  Tokens and spans of a text are put in one order by start, where a token is covered if a
    span before it reaches into it, or one behind it starts within it; they are never paired with each other.
    """
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tokens = number_tokens(rows, key, text).withColumn("end", F.sum(F.col("skipped") + F.length("token")).over(run)).select(
        key, (F.col("end") - F.length("token")).alias("start"), "end", "token",
        number_kind(F.col("token"), F.col("left"), F.col("right")).alias("kind"),
    )
    spans = declared.filter("end > start").select(
        key, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.lit(None).cast("string").alias("token"),
        F.lit("span").alias("kind"),
    )
    order, is_span = Window.partitionBy(key).orderBy("start"), F.col("kind") == "span"
    reach = F.max(F.when(is_span, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(is_span, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    both = tokens.filter("kind = 'metric'").unionByName(spans).withColumns({"_reach": reach, "_ahead": ahead})
    covered = (F.col("_reach") > F.col("start")) | (F.col("_ahead") < F.col("end"))
    return both.filter(~is_span & ~F.coalesce(covered, F.lit(False))).select(
        key, "start", "end", "token", number_value(F.col("token")).alias("value"))


# Scale words, the share by which leading digits may differ, and the factor that makes a wrong scale.
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
SCALED = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(k|m|mn|b|bn|thousand|million|billion)\b"
SAME_DIGITS, WRONG_SCALE = 0.03, 100.0


def _leading(x: Column) -> Column:
    """The significant digits of a number as a value in [1, 10); NULL for zero."""
    size = F.nullif(F.abs(x), F.lit(0.0))
    return size / F.pow(F.lit(10.0), F.floor(F.log10(size)))


def claim_magnitude(claims: DataFrame, span: str = "text_span", true: str = "true_value") -> DataFrame:
    """Adds `wrong_scale`: the span's first scale word is off by a factor of 100 or more from the resolved value.

    Only where the leading digits agree; otherwise the scale word belongs to another number of the span.
    """
    number = F.replace(F.regexp_extract(span, SCALED, 1), F.lit(","), F.lit("")).try_cast("double")
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    shown = number * F.try_element_at(scales, F.lower(F.regexp_extract(span, SCALED, 2)))
    same = F.abs(_leading(number) / _leading(F.col(true)) - 1) <= SAME_DIGITS
    off = F.try_divide(F.abs(shown), F.abs(F.col(true)))
    return claims.withColumn("wrong_scale", F.coalesce(same & ((off >= WRONG_SCALE) | (off <= 1 / WRONG_SCALE)), F.lit(False)))


# Characters before and behind a claim's span in which a movement word speaks of it.
CLAUSE_BEFORE, CLAUSE_BEHIND = 70, 20
SIGNED_OPS = ("difference", "pct_change")


def claim_direction(
    claims: DataFrame, text: str = "text", span: str = "text_span", true: str = "true_value",
    up: Sequence[str] = DIRECTION_UP, down: Sequence[str] = DIRECTION_DOWN,
) -> DataFrame:
    """Adds `status`: `stripped_semantic` where the clause of a signed claim states the other direction, else `passed`.

    Only differences and percentage changes have a sign to contradict; a span that is not in the text gives no verdict.
    """
    at = F.instr(text, F.col(span))
    first = F.greatest(at - CLAUSE_BEFORE, F.lit(1))
    clause = F.substring(text, first, at + F.length(span) + CLAUSE_BEHIND - first)
    found = claims.withColumn("_clause", F.when((at > 0) & F.col("op").isin(*SIGNED_OPS), clause))
    judged = direction_contradiction(found, "_clause", true, up, down)
    status = F.when(F.coalesce("contradiction", F.lit(False)), "stripped_semantic").otherwise("passed")
    return judged.withColumn("status", status).drop("_clause", "says_up", "says_down", "contradiction")


# Wording of planning, plumbing and unfinished answers (case-insensitive).
NARRATION = [
    r"system issue", r"system error", r"tool error", r"query failed", r"retry with corrected parameters?",
    r"corrected parameters?", r"peer benchmark fetch",
    r"\blet me (?:pull|fetch|query|grab|retrieve|try|run|rewrite|reformulate|rework|adjust)\b",
    r"\bcte\b", r"\bsubquery\b", r"\bsql\b[^.]*?\b(?:parsing|syntax|parse|execution)\s+error", r"query surface",
    r"(?:isn'?t|is not|not)\s+supported", r"\bi(?:'ll| will) need to\b", r"\bi would need to\b",
    r"\bi need to (?:pull|fetch|query|grab|retrieve|compare|check)\b",
    r"to (?:provide|give you) a full[^.]*?\bi(?:'ll| will)\b",
    r"to answer this (?:question )?properly,? i (?:need|have) to", r"i(?:'ve| have) fetched but",
    r"unable to retrieve complete peer data", r"\bwould you like me to\b", r"\bdo you want me to\b", r"\bshall i\b",
    r"\?\s*$", r"^\s*(?:let me|let's|i'?ll|i will|now\b|first,? i|okay)\b", r"\bretrying\b", r"^\s*placeholder\b",
    r"no anomalies found yet", r"result was truncated", r"pulling the last", r"let me compute\b",
    r"\bcompute\b[^.]*\bnow\b", r"^\s*checking\b", r"…\s*$", r"\.\.\.\s*$",
]


def narration_flags(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("narration", F.col(text).rlike("(?i)" + "|".join(NARRATION)))


def agreement_overlap(values: DataFrame, cell: Sequence[str], base_run: str) -> DataFrame:
    """Per cell the smallest Jaccard overlap of rounded values between the base run and each other run.

    Set sizes come from joins on (cell, value); no set is collected.
    """
    seen = values.select(*cell, "run", F.round("value", 2).alias("v")).distinct()
    base = seen.filter(F.col("run") == base_run).drop("run")
    size = base.groupBy(*cell).agg(F.count(F.lit(1)).alias("_a"))
    other = seen.filter(F.col("run") != base_run)
    both = other.join(base.withColumn("_hit", F.lit(1)), [*cell, "v"], "left")
    per = both.groupBy(*cell, "run").agg(F.count(F.lit(1)).alias("_b"), F.count("_hit").alias("_i"))
    joined = per.join(size, list(cell))
    union = F.col("_a") + F.col("_b") - F.col("_i")
    return joined.groupBy(*cell).agg(F.min(ratio(F.col("_i"), union)).alias("agreement"))


# Columns that fix the grain of a logged query.
GRAIN_COLUMNS = [
    "product_name", "merchant_subcategory", "functional_subcategory", "subcategory", "merchant_category",
    "functional_category", "category", "department", "neighborhood", "payment_type", "entry_mode", "tender",
]


def query_log_grain(log: DataFrame, text: str, row_count: str | None = None, grains: Sequence[str] = GRAIN_COLUMNS) -> DataFrame:
    """Grain columns each logged query names, and whether it returned nothing."""
    # Lower-cased once per text: a column used by many terms is not inlined again.
    lowered = log.withColumn("_low", F.lower(text))
    out = lowered.withColumn("grain", F.array_join(mentions(F.col("_low"), grains), ",")).drop("_low")
    return out.withColumn("empty_result", F.col(row_count) == 0) if row_count else out


def dow_filter_lint(log: DataFrame, text: str, viewer: str, closed: Mapping[str, int]) -> DataFrame:
    """Queries of a merchant closed on one day (0 = Sunday) that filter day 1 instead."""
    days = F.regexp_extract_all(text, F.lit(r"(?i)dayofweek\s*\([^)]*\)\s*=\s*(\d)"), F.lit(1))
    shut = F.lit(None).cast("int")
    for m, d in closed.items():
        shut = F.when(F.col(viewer) == m, d).otherwise(shut)
    return log.withColumn("suspect", F.coalesce((shut != 1) & F.array_contains(days, "1"), F.lit(False)))


def name_leak_scan(rows: DataFrame, text: str, names: Sequence[str], viewer: Column) -> DataFrame:
    """Names of merchants other than the row's viewer in the text, for a short list of names."""
    return rows.withColumn("leaked", F.array_join(F.array_remove(mentions(F.col(text), names), viewer), ","))


def name_leak_index(rows: DataFrame, key: str, text: str, names: DataFrame, viewer: Column) -> DataFrame:
    """(key, leaked): names of merchants other than the row's viewer in its text, comma-joined.

    names: (name[, ordinal]), of any size; their order is that of `ordinal`, else by name.
    """
    order = F.col("ordinal") if "ordinal" in names.columns else F.lit(0)
    known = names.select("name", order.alias("_ordinal"))
    hits = name_mentions(rows.withColumn("_own", viewer), key, text, known, carry=["_own"]).filter(~F.col("name").eqNullSafe(F.col("_own")))
    per = hits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("_ordinal", "name"))).alias("_n"))
    found = per.select(key, F.array_join(F.col("_n.name"), ",").alias("_leaked"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("_leaked", F.lit("")).alias("leaked"))
