"""Mixing sources to target weights by Pareto order sampling, DataFrame functions only.

Size of a document: its words.  Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words;
a source's target stops at MAX_COPIES times its size, and what that frees goes to the others by weight.

Of a source with target/size = r every document gets floor(r) whole copies for certain.  The fraction f that is left is
filled by a Pareto sample: a document of merit m has the inclusion odds m * f / (1 - f), its rank is its random odds
u / (1 - u) divided by them, and documents are taken by rank until the words of the fraction are filled.  The document
that crosses the line is taken if that comes nearer to the target than leaving it.  The default merit prefers longer
documents gently: size / (size + MERIT_WORDS).  u comes from a hash of doc_id and the seed, so reruns agree.

The line is found without sorting a source: words are summed in BINS ranges of a monotone image of the rank, then in
BINS ranges of the range that holds the line; only the rows of that last range, one in BINS squared, are sorted.  All of
this runs on (doc_id, source, size) rows written to the shared folder once; a source with a third of all rows is
combined before each shuffle.  One row per source is read by a single task, nothing else.

Cases: null and blank texts have size 0 and are never taken; the null source is one source; rows that repeat a doc_id
share their rank and are taken in the order of their size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import stage, words

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
MERIT_WORDS = 32
BINS = 4096
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target): one row per source.

    In the order of size per weight the sources that reach MAX_COPIES times their size come first; the share of the
    others follows from what is left.  All comparisons are exact, in decimals.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(w) for w in weights])
    by = by.withColumn("weight", F.get(weight, (place % len(weights)).cast("int")).cast("long"))
    rank = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, behind = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    by = by.select(
        "source", "source_size", "weight",
        (total - MAX_COPIES * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left_words"),
        F.sum("weight").over(behind).alias("left_weight"),
        F.row_number().over(rank).alias("n"),
    )
    wide = "decimal(38,0)"
    full = (
        MAX_COPIES * F.col("source_size").cast("decimal(19,0)") * F.col("left_weight").cast("decimal(18,0)")
    ).cast(wide) <= (F.col("left_words").cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)")).cast(wide)
    by = by.withColumn("full", full)
    # The first source below its stop sets words per weight for itself and all behind it.
    first = F.min(F.when(~F.col("full"), F.struct("n", (F.col("left_words") / F.col("left_weight")).alias("rate")))).over(Window.partitionBy())
    by = by.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("n") < F.col("first.n"))
    return by.select(
        "source", "source_size",
        F.when(capped, (MAX_COPIES * F.col("source_size")).cast("double")).otherwise(F.col("first.rate") * F.col("weight")).alias("target"),
    )


def uniform(key: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of the MD5 of key and seed."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def default_merit() -> Column:
    return F.col("size") / (F.col("size") + F.lit(float(MERIT_WORDS)))


def ranked(sized: DataFrame, goals: DataFrame, merit: Column | None = None, seed: str = SEED) -> DataFrame:
    """sized with its source's goal, `whole` copies, `rest` (words of the fraction) and the Pareto rank."""
    d = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    d = d.withColumn("whole", F.floor(ratio).cast("long"))
    d = d.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    f = F.coalesce(F.try_divide(F.col("rest"), F.col("source_size")), F.lit(0.0))
    u = uniform(F.col("doc_id"), seed)
    odds = (default_merit() if merit is None else merit) * f / (1 - f)
    return d.withColumn("rank", F.when((F.col("size") > 0) & (f > 0) & (f < 1), (u / (1 - u)) / odds))


def cut_lines(r: DataFrame) -> DataFrame:
    """(source, line, line_rows): rows of lower rank are taken, and of those on the line the first `line_rows`."""
    # rank / (1 + rank) is monotone and lies in [0, 1).
    unit = F.least(F.col("rank") / (1 + F.col("rank")), F.lit(1.0 - 2.0**-53))
    scaled = unit * BINS
    r = r.filter("rank IS NOT NULL").select(
        "doc_id", "source", "size", "rest", "rank",
        F.floor(scaled).cast("int").alias("bin"), F.floor((scaled - F.floor(scaled)) * BINS).cast("int").alias("sub"),
    )

    def crossing(rows: DataFrame, key: str, start: Column) -> DataFrame:
        """Per source the range of `key` in which the running words pass `rest`, and the words before it."""
        sums = rows.groupBy("source", "rest", key, start.alias("start")).agg(F.sum("size").alias("in_range"))
        w = Window.partitionBy("source").orderBy(key)
        sums = sums.withColumn("done", F.col("start") + F.coalesce(F.sum("in_range").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = (F.col("done") <= F.col("rest")) & (F.col("done") + F.col("in_range") > F.col("rest"))
        return sums.filter(inside).select(F.col("source").alias("s"), F.col(key).alias("k"), F.col("done"))

    def within(rows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
        return rows.join(lines, rows["source"].eqNullSafe(lines["s"]) & (rows[key] == lines["k"])).drop("s", "k")

    # Each narrowing is written, so that the next plan reads it; nested, they would plan and read the ranks eight times in one job.
    first = stage(within(r, crossing(r, "bin", F.lit(0).cast("long")), "bin"), "line-bins")
    second = crossing(first, "sub", F.col("done")).withColumnRenamed("done", "done2")
    last = within(first, second, "sub")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    last = last.withColumn("to_here", F.col("done2") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = stage(last.withColumn("n", F.row_number().over(order)), "line-rows")
    over = F.col("to_here") > F.col("rest")
    crossed = last.filter(over).groupBy("source").agg(F.min(F.struct("n", "rank", "size", "to_here", "rest")).alias("c"))
    # The crossing document is taken if its overshoot is at most what would be missing without it.
    take = F.col("c.to_here") - F.col("c.rest") <= F.col("c.rest") - (F.col("c.to_here") - F.col("c.size"))
    return crossed.select(
        F.col("source").alias("line_source"), F.col("c.rank").alias("line"),
        (F.col("c.n") - F.when(take, 0).otherwise(1)).alias("line_place"), F.lit(True).alias("has_line"),
    ).join(
        last.select(F.col("source").alias("s2"), F.col("rank").alias("r2"), F.col("n").alias("n2")),
        F.col("line_source").eqNullSafe(F.col("s2")) & (F.col("line") == F.col("r2")),
    ).groupBy("line_source", "line", "line_place").agg((F.max("line_place") - F.min("n2") + 1).alias("line_rows"))


def taken(sized: DataFrame, goals: DataFrame, lines: DataFrame, carry: tuple[str, ...] = (), merit: Column | None = None, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies, taken and the columns named in `carry`."""
    d = ranked(sized, goals, merit, seed)
    d = d.join(lines, d["source"].eqNullSafe(lines["line_source"]), "left")
    # Rows of one doc_id share a rank; those on the line (few: one doc_id) are told apart by their size.
    on_line = F.col("rank").isNotNull() & (F.col("rank") == F.col("line"))
    place = F.row_number().over(Window.partitionBy("source", "rank").orderBy("doc_id", "size"))
    edge = d.filter(on_line).withColumn("more", (place <= F.col("line_rows")).cast("long"))
    below = F.col("rank").isNotNull() & (F.col("line").isNull() | (F.col("rank") < F.col("line")))
    rest = d.filter(~F.coalesce(on_line, F.lit(False))).withColumn("more", F.coalesce(below.cast("long"), F.lit(0).cast("long")))
    out = rest.unionByName(edge)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry,
    )


def plan(docs: DataFrame, merit: Column | None = None, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, goals, lines) of a corpus, written to the shared folder; the last two have a row per source at most."""
    sized = stage(sizes(docs), "sizes")
    goals = stage(targets(sized), "targets")
    return sized, goals, stage(cut_lines(ranked(sized, goals, merit, seed)), "lines")


def mix(docs: DataFrame, merit: Column | None = None, seed: str = SEED) -> DataFrame:
    sized, goals, lines = plan(docs, merit, seed)
    return taken(sized, goals, lines, (), merit, seed)


def mixed_rows(docs: DataFrame, merit: Column | None = None, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.  The texts are not moved: goals and lines come to them."""
    _, goals, lines = plan(docs, merit, seed)
    whole = docs.select(F.struct("*").alias("rec"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    out = taken(whole, goals, lines, ("rec",), merit, seed).filter("copies > 0")
    return out.select("rec", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("rec.*")
