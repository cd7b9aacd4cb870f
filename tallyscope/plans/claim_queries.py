"""Claim verification, text scans and chart shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions.text import METRIC_WORDS, STRUCTURAL_FOLLOWERS, STRUCTURAL_PREFIXES
from tallyscope.operators import claims, shaping
from tallyscope.plans.basket_queries import panel_lines
from tallyscope.plans.registry import query
from tallyscope.plans.sql import LN, SE, ST, IT, PR, avg_money, money
from tallyscope.sources import census


def results(spark, d):
    """Tidy result cells: units by department and category, of one merchant ('tenant') and of its segment ('lake')."""
    lines = panel_lines(spark, d)
    parts = []
    for frame, cond in (("tenant", F.col("banner_code") == "NATION_3"), ("lake", F.col("segment") == "EUROPE")):
        g = lines.filter(cond).groupBy("department", "category").agg(
            F.sum("qty").cast("double").alias("units"), F.count(F.lit(1)).cast("double").alias("lines")
        )
        dims = F.create_map(F.lit("department"), F.col("department"), F.lit("category"), F.col("category"))
        cells = F.array(F.struct(F.lit("units").alias("column"), F.col("units").alias("value")),
                        F.struct(F.lit("lines").alias("column"), F.col("lines").alias("value")))
        parts.append(g.select(F.lit(frame).alias("frame"), F.concat_ws("/", "department", "category").alias("row_id"),
                              dims.alias("dims"), F.inline(cells)))
    return parts[0].unionByName(parts[1])


R = f"""{LN}, g AS (SELECT 'tenant' AS frame, department, category, CAST(sum(qty) AS DOUBLE) AS units, CAST(count(*) AS DOUBLE) AS lines FROM ln WHERE banner_code = 'NATION_3' GROUP BY 2, 3
  UNION ALL SELECT 'lake', department, category, CAST(sum(qty) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM ln WHERE segment = 'EUROPE' GROUP BY 2, 3)"""


def _one(*names):
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.array(n) for n in names]))


def lookups(spark, d):
    """One claim per product: about its department and category, its category, or two departments."""
    p = census.products(spark, d)
    k = F.col("sku") % 4
    both = F.map_from_arrays(
        F.array(F.lit("department"), F.lit("category")),
        F.array(F.array(F.col("department"), F.lit("PROMO")), F.array("category")),
    )
    frame = F.when(F.col("sku") % 3 == 0, "tenant").when(F.col("sku") % 3 == 1, "lake")
    return p.select(
        F.col("sku").alias("claim_id"), frame.alias("frame"),
        F.when(k == 0, _one("department", "category")).when(k == 1, _one("category")).when(k == 2, _one("category"))
        .otherwise(both).alias("row_filter"),
        F.lit("units").alias("column"),
        F.when(k == 1, "sum").when(k == 3, "mean").alias("agg"),
    )


LK = """c AS (SELECT sku, sku % 4 AS k, CASE sku % 3 WHEN 0 THEN 'tenant' WHEN 1 THEN 'lake' END AS want, department AS d, category AS cat FROM pr),
f AS (SELECT sku, k, frame, count(*) AS n, sum(units) AS s FROM c JOIN g ON (want IS NULL OR want = frame) AND category = cat AND (k IN (1, 2) OR department = d OR (k = 3 AND department = 'PROMO')) GROUP BY 1, 2, 3),
v AS (SELECT sku, frame, CASE WHEN n = 1 THEN s WHEN k = 1 THEN s WHEN k = 3 THEN s / n END AS v FROM f),
b AS (SELECT sku, arg_max(frame, frame) AS frame, arg_max(v, frame) AS v FROM v WHERE v IS NOT NULL GROUP BY 1)"""


@query("claim_cell_lookup", f"""WITH {R}, {LK} SELECT pr.sku AS claim_id, b.frame AS resolved_frame, v AS true_value,
  CASE WHEN v IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM pr LEFT JOIN b USING (sku)""")
def _claim_cell_lookup(spark, d):
    return claims.claim_cell_lookup(lookups(spark, d), results(spark, d))


@query("claim_list_lookup", f"""WITH {R}, c AS (SELECT sku, sku % 3 AS k, category AS cat, department AS d FROM pr),
f AS (SELECT sku, k, frame, count(*) AS n, sum(units) AS s FROM c JOIN g ON category <= cat AND department >= d GROUP BY ALL),
b AS (SELECT sku, arg_max(frame, frame) AS frame, arg_max(v, frame) AS v FROM (SELECT sku, frame, CASE WHEN n = 1 OR k = 1 THEN s WHEN k = 2 THEN s / n END AS v FROM f) WHERE v IS NOT NULL GROUP BY 1)
SELECT pr.sku AS claim_id, frame AS resolved_frame, v AS true_value, CASE WHEN v IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM pr LEFT JOIN b USING (sku)""")
def _claim_list_lookup(spark, d):
    """A claim per product over all categories up to its own and all departments from its own on, listed one by one."""
    p = census.products(spark, d)
    kinds = {c: p.agg(F.array_sort(F.collect_set(c))).scalar() for c in ("category", "department")}
    asked = p.select("sku", "category", "department", *[v.alias(f"_{c}") for c, v in kinds.items()])
    lists = F.map_from_arrays(F.array(F.lit("category"), F.lit("department")), F.array(
        F.filter("_category", lambda x: x <= F.col("category")), F.filter("_department", lambda x: x >= F.col("department"))))
    k = F.col("sku") % 3
    asked = asked.select(F.col("sku").alias("claim_id"), F.lit(None).cast("string").alias("frame"), lists.alias("row_filter"),
                         F.lit("units").alias("column"), F.when(k == 1, "sum").when(k == 2, "mean").alias("agg"))
    return claims.claim_cell_lookup(asked, results(spark, d))


@query("claim_value_ref", f"""WITH {R} SELECT pr.sku AS claim_id, (SELECT sum(lines) / count(*) FROM g WHERE frame = 'lake' AND g.department = pr.department) AS true_value FROM pr""")
def _claim_value_ref(spark, d):
    asked = census.products(spark, d).select(
        F.col("sku").alias("claim_id"), F.lit("department").alias("by"), F.col("department").alias("value"),
        F.lit("lines").alias("metric"),
    )
    return claims.claim_value_ref(asked, results(spark, d))


@query("claim_derivation", f"""WITH {R}, o AS (SELECT sku, ['difference', 'ratio', 'pct_change', 'aggregate'][sku % 4 + 1] AS op,
  (SELECT sum(units) FROM g WHERE frame = 'tenant' AND g.category = pr.category) AS a, (SELECT sum(units) FROM g WHERE frame = 'lake' AND g.category = pr.category) AS b FROM pr)
  SELECT sku AS claim_id, op, CASE op WHEN 'difference' THEN a - b WHEN 'ratio' THEN a / b WHEN 'pct_change' THEN (a - b) / b ELSE (a + b) / 2 END AS true_value FROM o""")
def _claim_derivation(spark, d):
    p = census.products(spark, d)
    op = F.element_at(F.array(*[F.lit(x) for x in ("difference", "ratio", "pct_change", "aggregate")]), (F.col("sku") % 4 + 1).cast("int"))

    def operand(frame):
        return F.struct(F.lit(frame).alias("frame"), _one("category").alias("row_filter"), F.lit("units").alias("column"), F.lit("sum").alias("agg"))

    asked = p.select(
        F.col("sku").alias("claim_id"), op.alias("op"), F.lit("mean").alias("agg"),
        F.array(operand("tenant"), operand("lake")).alias("operands"),
    )
    return claims.claim_derivation(asked, results(spark, d))


@query("claim_disposition", """SELECT l_orderkey, l_linenumber, l_partkey, value, true_value, CASE WHEN value = true_value THEN 'passed' WHEN abs(value - true_value) <= 0.01 * greatest(abs(value), abs(true_value)) THEN 'normalized'
  ELSE 'stripped' END AS status, CASE WHEN value = true_value THEN NULL WHEN abs(value - true_value) <= 0.01 * greatest(abs(value), abs(true_value)) THEN 'within tolerance' ELSE 'differs from the resolved value' END AS reason
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS true_value, l_extendedprice * (1 + l_discount / 4) AS value FROM lineitem)""")
def _claim_disposition(spark, d):
    stated = census.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * (1 + F.col("l_discount") / 4)).alias("value"),
        F.col("l_extendedprice").alias("true_value"),
    )
    return claims.claim_disposition(stated)


@query("claim_recompute_audit", f"""WITH {IT}, r AS (SELECT txn_id, {money('line_total')} AS recomputed FROM it GROUP BY 1)
  SELECT o_orderkey AS txn_id, o_totalprice AS stated, recomputed, coalesce(abs(o_totalprice - recomputed) <= 0.000001::DOUBLE + 0.01::DOUBLE * greatest(abs(o_totalprice), abs(recomputed)), false) AS match
  FROM orders LEFT JOIN r ON txn_id = o_orderkey""")
def _claim_recompute_audit(spark, d):
    """Each order's stated total against the sum of its lines."""
    from tallyscope.functions.money import sum_money

    stated = census.table(spark, d, "orders").select(F.col("o_orderkey").alias("txn_id"), F.col("o_totalprice").alias("stated"))
    again = census.items(spark, d).groupBy("txn_id").agg(sum_money("line_total").alias("recomputed"))
    return claims.claim_recompute_audit(stated, again, ["txn_id"])


# The generated texts hold no English business wording: two frequent words stand for each direction.
UP, DOWN = [*claims.DIRECTION_UP, "the", "la"], [*claims.DIRECTION_DOWN, "and", "ch"]


def _words(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("direction_contradiction", f"""WITH w AS (SELECT conv_id, turn, length(text) - 200 AS signed, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations),
  f AS (SELECT conv_id, turn, signed, list_has_any(w, {_words(UP)}) AS says_up, list_has_any(w, {_words(DOWN)}) AS says_down FROM w)
  SELECT *, (says_up AND NOT says_down AND signed < 0) OR (says_down AND NOT says_up AND signed > 0) AS contradiction FROM f""")
def _direction_contradiction(spark, d):
    rows = census.table(spark, d, "conversations").withColumn("signed", (F.length("text") - 200).cast("bigint"))
    return claims.direction_contradiction(rows, "text", "signed", UP, DOWN).select(
        "conv_id", "turn", "signed", "says_up", "says_down", "contradiction"
    )


# The check engine has no look-behind: letters, and letter suffixes, swallow the one character that may not start a number.
CORE = r"(?:≈|~|about\s+|roughly\s+)?\$?(?:-?\d{1,3}(?:,\d{3})+|-?\d+(?:\.\d+)?)"
START = r"[≈~$\d-]"
CUT = rf"(?i)({CORE}\s*(?:x|bps))({START})|({CORE}(?:\s*%|\s*x|\s*×|\s*bps)?)|([A-Za-z]+{START}?)"
AROUND = "PARTITION BY doc_id ORDER BY pos"
WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))"


def _listed(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


TOKENS = rf"""m AS (SELECT doc_id, replace(regexp_replace(text, '{CUT}', chr(1) || '\1\3' || chr(2) || '\2\4', 'g'), chr(1) || chr(2), '') AS m FROM documents),
p AS (SELECT doc_id, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) - 2 AS pos FROM m),
q AS (SELECT doc_id, pos, CASE WHEN pos < 0 THEN '' ELSE split_part(piece, chr(2), 1) END AS token, CASE WHEN pos < 0 THEN piece ELSE split_part(piece, chr(2), 2) END AS gap FROM p),
r AS (SELECT doc_id, pos, token, gap, lag(gap, 3, '') OVER o || lag(token, 2, '') OVER o || lag(gap, 2, '') OVER o || lag(token, 1, '') OVER o || lag(gap, 1, '') OVER o AS l,
  gap || lead(token, 1, '') OVER o || lead(gap, 1, '') OVER o || lead(token, 2, '') OVER o || lead(gap, 2, '') OVER o AS r,
  sum(length(token) + length(gap)) OVER (o ROWS UNBOUNDED PRECEDING) - length(gap) AS e FROM q WINDOW o AS ({AROUND})),
s AS (SELECT *, {WORDS.format('l')}[-2:] AS b, {WORDS.format('r')}[1:2] AS a FROM r WHERE pos >= 0),
tk AS (SELECT doc_id, CAST(pos AS INT) AS pos, token, CAST(e - length(token) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
  CAST(replace(regexp_extract(token, '(-?\d{{1,3}}(?:,\d{{3}})+|-?\d+(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS value,
  CASE WHEN regexp_matches(token, '(?i)[%$.]|(?:x|×|bps)$') OR regexp_matches(l, '(?i)(?:≈|~|about\s+|roughly\s+)$|[≈~]\s+$') THEN 'metric'
    WHEN a[1] IN {_listed(STRUCTURAL_FOLLOWERS)} OR b[-1] IN {_listed(STRUCTURAL_PREFIXES)} THEN 'structural'
    WHEN list_has_any(list_concat(b, a), [{', '.join(f"'{x}'" for x in METRIC_WORDS)}]) THEN 'metric' ELSE 'structural' END AS kind FROM s)"""


@query("numeric_token_scan", f"WITH {TOKENS} SELECT doc_id, pos, token, value, kind FROM tk")
def _numeric_token_scan(spark, d):
    return claims.numeric_token_scan(census.table(spark, d, "documents"), "doc_id", "text")


@query("claim_undeclared_numbers", f"""WITH {TOKENS} SELECT doc_id, s AS start, e AS "end", token, value FROM tk
  WHERE kind = 'metric' AND s % 200 >= 100 AND s // 200 = (e - 1) // 200""")
def _claim_undeclared_numbers(spark, d):
    """Declared spans: the first half of every 200 characters of every text."""
    docs = census.table(spark, d, "documents").filter("text IS NOT NULL AND text != ''")
    starts = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(200)))
    spans = docs.select("doc_id", starts.alias("start")).withColumn("end", F.col("start") + 100)
    return claims.claim_undeclared_numbers(docs, "doc_id", "text", spans)


@query("claim_magnitude", """WITH c AS (SELECT o_orderkey, o_totalprice AS true_value, round(o_totalprice / 1000, 1) AS n, ['K', ' million', 'bn', ' widgets'][o_orderkey % 4 + 1] AS unit,
    CASE WHEN o_custkey % 3 = 0 THEN 7.5::DOUBLE ELSE round(o_totalprice / 1000, 1) END AS shown FROM orders)
SELECT o_orderkey, true_value, unit <> ' widgets' AND unit <> 'K' AND true_value > 0 AND shown > 0
  AND abs((shown / pow(10, floor(log10(shown)))) / (true_value / pow(10, floor(log10(true_value)))) - 1) <= 0.03::DOUBLE
  AND (shown * CASE unit WHEN 'bn' THEN 1e9 ELSE 1e6 END / true_value >= 100) AS wrong_scale FROM c""")
def _claim_magnitude(spark, d):
    """Order totals stated in thousands under four labels, one of them right; a third state another number."""
    o = census.table(spark, d, "orders")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("K", " million", "bn", " widgets")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    shown = F.when(F.col("o_custkey") % 3 == 0, F.lit(7.5)).otherwise(F.round(F.col("o_totalprice") / 1000, 1))
    stated = o.select("o_orderkey", F.col("o_totalprice").alias("true_value"), F.concat(F.lit("a total of $"), shown.cast("decimal(18,1)").cast("string"), unit).alias("text_span"))
    return claims.claim_magnitude(stated).drop("text_span")


@query("claim_direction", """WITH c AS (SELECT conv_id, turn, text, substr(text, length(text) // 3 + 1, 8) AS span, length(text) - 400 AS true_value,
    ['difference', 'pct_change', 'ratio'][conv_id %% 3 + 1] AS op FROM conversations),
w AS (SELECT *, instr(text, span) AS p0 FROM c),
f AS (SELECT *, regexp_extract_all(lower(substr(text, greatest(p0 - 70, 1), p0 + length(span) + 20 - greatest(p0 - 70, 1))), '[a-z]+') AS w FROM w),
g AS (SELECT *, list_has_any(w, %s) AS u, list_has_any(w, %s) AS n FROM f)
SELECT conv_id, turn, op, true_value, CASE WHEN op <> 'ratio' AND ((u AND NOT n AND true_value < 0) OR (n AND NOT u AND true_value > 0))
  THEN 'stripped_semantic' ELSE 'passed' END AS status FROM g""" % (_words(UP), _words(DOWN)))
def _claim_direction(spark, d):
    """One signed claim per turn of a conversation: eight characters behind its first third."""
    c = census.table(spark, d, "conversations")
    ops = F.element_at(F.array(*[F.lit(x) for x in ("difference", "pct_change", "ratio")]), (F.col("conv_id") % 3 + 1).cast("int"))
    stated = c.select("conv_id", "turn", "text", F.expr("substring(text, length(text) div 3 + 1, 8)").alias("text_span"), ops.alias("op"),
                      (F.length("text") - 400).cast("bigint").alias("true_value"))
    return claims.claim_direction(stated, up=UP, down=DOWN).drop("text", "text_span")


PATTERN = "|".join(claims.NARRATION).replace("'", "''")


@query("narration_flags", f"SELECT conv_id, turn, regexp_matches(text, '{PATTERN}', 'i') AS narration FROM conversations")
def _narration_flags(spark, d):
    return claims.narration_flags(census.table(spark, d, "conversations"), "text").select("conv_id", "turn", "narration")


@query("agreement_overlap", """WITH s AS (SELECT DISTINCT l_partkey, l_returnflag AS run, round(l_discount, 2) AS v FROM lineitem), a AS (SELECT * FROM s WHERE run = 'A'),
  p AS (SELECT o.l_partkey, o.run, count(*) AS b, count(a.v) AS i FROM s o LEFT JOIN a ON a.l_partkey = o.l_partkey AND a.v = o.v WHERE o.run <> 'A' GROUP BY 1, 2),
  z AS (SELECT l_partkey, count(*) AS a FROM a GROUP BY 1) SELECT l_partkey, min(CAST(i AS DOUBLE) / (a + b - i)) AS agreement FROM p JOIN z USING (l_partkey) GROUP BY 1""")
def _agreement_overlap(spark, d):
    """Answers about a product in three runs (return flags): how far their rounded values agree."""
    v = census.table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("run"), F.col("l_discount").alias("value"))
    return claims.agreement_overlap(v, ["l_partkey"], "A")


GRAINS = [*claims.GRAIN_COLUMNS, "the", "and", "la"]


def _mention_sql(text, terms, own="''"):
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN '{t}' <> {own} AND regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])') THEN '{t}' END"
        for t in terms
    ) + ")"


@query("query_log_grain", f"SELECT doc_id, {_mention_sql('lower(text)', GRAINS)} AS grain, n_chars % 5 = 0 AS empty_result FROM documents")
def _query_log_grain(spark, d):
    log = census.table(spark, d, "documents").withColumn("n", F.col("n_chars") % 5)
    return claims.query_log_grain(log, "text", "n", GRAINS).select("doc_id", "grain", "empty_result")


@query("dow_filter_lint", f"""WITH {SE} SELECT txn_id, banner_code IN ('click') AND k % 7 = 1 AS suspect FROM se""")
def _dow_filter_lint(spark, d):
    s = census.sessions(spark, d)
    log = s.withColumn("sql", F.concat(F.lit("SELECT count(*) FROM t WHERE DAYOFWEEK (ts) = "), (F.col("k") % 7).cast("string")))
    return claims.dow_filter_lint(log, "sql", "banner_code", {"click": 0, "view": 1}).select("txn_id", "suspect")


NAMES = ["the", "and", "la", "that"]


OWN_NAME = "CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE 'la' END"


@query("name_leak_scan", f"SELECT doc_id, {_mention_sql('text', NAMES, OWN_NAME)} AS leaked FROM documents")
def _name_leak_scan(spark, d):
    """Four frequent words play the panel's names; each text's own name is allowed."""
    viewer = F.when(F.col("doc_id") % 2 == 0, "the").otherwise("la")
    names = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "name string, ordinal int")
    return claims.name_leak_index(census.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", names, viewer)


@query("name_leak_scan_catalogue", f"""WITH {PR}, {IT}, o AS (SELECT DISTINCT txn_id, sku, product_name FROM it JOIN pr USING (sku)),
own AS (SELECT txn_id, min(product_name) AS own FROM o GROUP BY 1)
SELECT txn_id, string_agg(CASE WHEN product_name <> own THEN product_name END, ',' ORDER BY product_name) AS leaked FROM o JOIN own USING (txn_id) GROUP BY 1""".replace(
    "string_agg(CASE", "coalesce(string_agg(CASE").replace("product_name) AS leaked", "product_name), '') AS leaked"))
def _name_leak_scan_catalogue(spark, d):
    """Every product's name looked for in a written list of each order, whose first name is its own."""
    p = census.products(spark, d)
    lines = census.items(spark, d).select("txn_id", "sku").join(p.select("sku", "product_name"), "sku")
    listed = lines.groupBy("txn_id").agg(F.array_sort(F.collect_set("product_name")).alias("n"))
    text = F.concat(F.lit("Ordered ("), F.array_join("n", "; "), F.lit("), to be sent."))
    return claims.name_leak_index(
        listed.select("txn_id", text.alias("text"), F.get("n", F.lit(0)).alias("own")), "txn_id", "text", p.select(F.col("product_name").alias("name")), F.col("own"))


@query("series_by_x", f"""WITH {SE} SELECT CAST(extract(hour FROM txn_ts) AS INT) AS hour, {avg_money('subtotal')} AS subtotal, {avg_money('k')} AS k FROM se GROUP BY 1 ORDER BY 1""")
def _series_by_x(spark, d):
    s = census.sessions(spark, d).withColumn("hour", F.hour("txn_ts"))
    return shaping.series_by_x(s, "hour", ["subtotal", "k"])


@query("heatmap_matrix", f"""WITH {SE} SELECT CAST(extract(hour FROM txn_ts) AS INT) AS hour, {', '.join(f"{avg_money('subtotal', f'banner_code = {chr(39)}{b}{chr(39)}')} AS {b}" for b in ('click', 'error', 'purchase', 'signup', 'view'))} FROM se GROUP BY 1 ORDER BY 1""")
def _heatmap_matrix(spark, d):
    s = census.sessions(spark, d).withColumn("hour", F.hour("txn_ts"))
    return shaping.heatmap_matrix(s, "hour", "banner_code", "subtotal", ["view", "click", "purchase", "signup", "error"])


@query("first_per_label", f"""WITH {PR} SELECT subcategory, sku, shelf_price FROM pr QUALIFY row_number() OVER (PARTITION BY subcategory ORDER BY shelf_price, sku) = 1 ORDER BY 1""")
def _first_per_label(spark, d):
    p = census.products(spark, d).select("subcategory", "sku", "shelf_price")
    return shaping.first_per_label(p, "subcategory", [F.col("shelf_price"), F.col("sku")])


@query("waterfall_contributions", f"""WITH {PR}, {IT} SELECT category, {money('line_total')} AS line_total FROM it JOIN pr USING (sku) GROUP BY 1 ORDER BY 2 DESC, 1""")
def _waterfall_contributions(spark, d):
    lines = census.items(spark, d).join(census.products(spark, d).select("sku", "category"), "sku")
    return shaping.waterfall_contributions(lines, "category", "line_total")


@query("geo_points", f"""WITH {ST}, {IT} SELECT latitude, longitude, {avg_money('line_total')} AS line_total, arg_min(banner_code, (store_id, banner_code)) AS banner_code FROM it JOIN st USING (store_id)
  GROUP BY 1, 2 ORDER BY 1, 2""")
def _geo_points(spark, d):
    lines = census.items(spark, d).join(census.stores(spark, d), "store_id")
    return shaping.geo_points(lines, "latitude", "longitude", "line_total", "banner_code", "store_id")


@query("facet_series", f"""WITH {PR}, {IT}, {ST} SELECT category, neighborhood, {avg_money('unit_price')} AS unit_price FROM it JOIN pr USING (sku) JOIN st USING (store_id) WHERE category IS NOT NULL GROUP BY 1, 2""")
def _facet_series(spark, d):
    return shaping.facet_series(panel_lines(spark, d), "category", "neighborhood", "unit_price")


