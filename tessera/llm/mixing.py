"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each document gets a rate exp(lambda * size / mean size of its source), at most ``CAP``: the rates nearest
to one, in relative entropy, under which a source's words meet its target. The dual is convex and falls
apart by source, so a safeguarded Newton step on each lambda needs two sums over a source's documents.
These come from a histogram (source, size, documents), which is exact and far smaller than the table.

Rates become copies without drawing lots: along the sizes of a source the running total of expected copies
is rounded, so that a source's error is below one document, and two corrections by the size that fits best
take most of that away. The documents of one (source, size) share their copies evenly, those with the least
hash first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, table, text_of
from tessera.session import cut, stash

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 40
TOLERANCE = 1e-9
SALTS = 256


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size): the number of words of each whole text; more columns are kept."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), *more)


def targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, docs, source_size), a row a source -> the same with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; none gets over ``cap`` times
    its own, and what is over goes to the others by weight. The sources that reach their cap are those with
    the least cap a weight, so one pass in that order finds the level of the rest. The windows see one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    whole = "decimal(38,0)"  # products of sizes and weights over very many sources pass 64 bits
    weighed = per.withColumn("weight", turn.cast("long")).withColumn("most", (cap * F.col("source_size")).cast(whole))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fuller = Window.orderBy(F.col("most").cast("double") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = weighed.select(
        "*",
        (F.sum(F.col("source_size").cast(whole)).over(every) - F.coalesce(F.sum("most").over(fuller), F.lit(0))).cast(whole).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fuller), F.lit(0))).cast("decimal(18,0)").alias("sharing"),
    )
    # full: its cap is within its share of what the fuller sources before it left
    marked = room.withColumn("full", (F.col("most") * F.col("sharing")).cast(whole) <= (F.col("weight") * F.col("rest")).cast(whole))
    open_rest = F.max(F.when(~F.col("full"), F.col("rest"))).over(every)
    open_weight = F.max(F.when(~F.col("full"), F.col("sharing"))).over(every)
    share = (F.col("weight") * open_rest).cast("double") / open_weight.cast("double")
    return marked.select("source", "docs", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _total(term: Column) -> Column:
    """The sum of doubles, each rounded to twelve places, whatever their order."""
    return F.sum(term.cast("decimal(38,12)")).cast("double")


def balance(histogram: DataFrame, goal: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """(source, lam): the dual's solution, by Newton steps kept inside a shrinking bracket.

    lam is null where every document is at the cap, or none has a word. Sums are taken over decimals, so that they don't
    depend on the order in which a shuffle brings the terms, and reruns agree to the last bit.
    """
    scaled = histogram.join(goal, F.col("h_source").eqNullSafe(F.col("source"))).select(
        "source", "size", "n", (F.col("size") * F.col("docs") / F.col("source_size")).alias("x")
    )
    scaled = stash(scaled.where("size > 0"), "mix-scaled")
    start = goal.where(f"source_size > 0 and target < {cap} * source_size").select(
        "source", "target", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(False).alias("done")
    )
    state = cut(start)
    for _ in range(steps):
        todo = state.where("not done")
        at = scaled.withColumnRenamed("source", "s").join(todo, F.col("s").eqNullSafe(F.col("source")))
        raw = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0)))
        rate, words = F.least(raw, F.lit(float(cap))), F.col("n") * F.col("size")
        sums = at.groupBy("source").agg(
            F.first("target").alias("target"), F.first("lam").alias("lam"), F.first("low").alias("low"), F.first("high").alias("high"),
            _total(words * rate).alias("mass"), _total(F.when(raw < cap, words * F.col("x") * raw).otherwise(0.0)).alias("slope"),
        )
        over = F.col("mass") > F.col("target")
        bracket = sums.withColumn("low2", F.when(over, F.col("low")).otherwise(F.col("lam"))).withColumn("high2", F.when(over, F.col("lam")).otherwise(F.col("high")))
        step = F.col("lam") + F.try_divide(F.col("target") - F.col("mass"), F.col("slope"))
        inside = (step > F.col("low2")) & (step < F.col("high2"))
        moved = bracket.select(
            "source", "target",
            F.when(F.abs(F.col("mass") - F.col("target")) <= TOLERANCE * F.col("target"), F.col("lam")).when(inside, step).otherwise((F.col("low2") + F.col("high2")) / 2).alias("lam"),
            F.col("low2").alias("low"), F.col("high2").alias("high"),
            ((F.abs(F.col("mass") - F.col("target")) <= TOLERANCE * F.col("target")) | (F.col("high2") - F.col("low2") < 1e-13)).alias("done"),
        )
        state = cut(moved.unionByName(state.where("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("source", "lam")


def copies_by_size(histogram: DataFrame, goal: DataFrame, duals: DataFrame, cap: int = CAP) -> DataFrame:
    """(h_source, size, n, copies): how many copies the n documents of a size get together."""
    lam = duals.withColumnRenamed("source", "d_source")
    rated = histogram.join(goal, F.col("h_source").eqNullSafe(F.col("source"))).join(lam, F.col("h_source").eqNullSafe(F.col("d_source")), "left")
    x = F.col("size") * F.col("docs") / F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * x, F.lit(50.0))), F.lit(float(cap))))
    along = Window.partitionBy("h_source").orderBy(F.col("size").desc())
    so_far = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    held = rated.withColumn("rate", rate).withColumn("upto", F.floor(so_far + 0.5))
    held = held.withColumn("copies", F.least(F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)), F.col("n") * cap))
    held = held.select("h_source", "size", "n", "target", F.greatest("copies", F.lit(0)).cast("long").alias("copies"))
    for _ in range(2):
        held = _corrected(stash(held, "mix-copies"), cap)
    return stash(held, "mix-copies")


def _corrected(held: DataFrame, cap: int) -> DataFrame:
    """Add or take copies of the one size in each source that brings its words nearest to the target."""
    miss = held.groupBy("h_source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss")).withColumnRenamed("h_source", "m_source")
    offer = held.join(miss, F.col("h_source").eqNullSafe(F.col("m_source"))).where("size > 0")
    more = F.greatest(-F.col("copies"), F.least(F.round(F.col("miss") / F.col("size")), F.col("n") * cap - F.col("copies"))).cast("long")
    offer = offer.withColumn("more", more)
    best = offer.groupBy("h_source").agg(F.min(F.struct(F.abs(F.col("miss") - F.col("more") * F.col("size")).alias("left"), F.col("size").alias("size"), F.col("more").alias("more"))).alias("b"))
    best = best.select(F.col("h_source").alias("b_source"), F.col("b.size").alias("b_size"), F.col("b.more").alias("more"))
    at = F.col("h_source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size"))
    return held.join(best, at, "left").select("h_source", "size", "n", "target", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size) -> the same rows with source_size, target and copies.

    Null sources are a source of their own, the last; sizes of zero keep one copy, which adds no word. Repeated rows
    are documents of their own; of equal ones any gets the odd copy, so reruns agree as a whole. A column ``key`` that
    tells rows apart is kept, if there is one. An empty table gives an empty result.
    """
    key = ["key"] if "key" in sizes.columns else []
    slim = stash(sizes.select("doc_id", "source", "size", *key), "mix-sizes")
    histogram = stash(slim.groupBy(F.col("source").alias("h_source"), "size").agg(F.count("*").alias("n")), "mix-histogram")
    per = histogram.groupBy(F.col("h_source").alias("source")).agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = stash(targets(per, weights, cap), "mix-goal")
    given = copies_by_size(histogram, goal, balance(histogram, goal, cap), cap)
    plan = given.join(goal.drop("target"), F.col("h_source").eqNullSafe(F.col("source"))).select(
        "h_source", F.col("size").alias("h_size"), "source_size", "target",
        F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("odd"),
    )
    joined = slim.join(plan, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("size") == F.col("h_size"))).drop("h_source", "h_size")
    even = joined.where("odd = 0").withColumn("copies", F.col("each"))
    # a rank among equals in two steps: inside a salt by a window, over the salts by their counts
    salted = joined.where("odd > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    group = ["source", "size", "salt"]
    counts = salted.groupBy(*group).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("source").alias("o_source"), F.col("size").alias("o_size"), F.col("salt").alias("o_salt"), before.alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", *key)))
    at = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("size") == F.col("o_size")) & (F.col("salt") == F.col("o_salt"))
    uneven = ranked.join(offsets, at).withColumn("copies", F.col("each") + F.when(F.col("before") + F.col("rank") <= F.col("odd"), 1).otherwise(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", *key]
    return even.select(*columns).unionByName(uneven.select(*columns))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents, each as often as the mix takes it; rows without copies go, and the columns stay as they are.

    Null and empty texts have no words and one copy; a null source is a source of its own; repeated rows and rows with
    null or repeated ids each have their own copies; an empty table gives an empty result.
    """
    # the documents' columns travel in one struct, so that no name can clash; a stored key tells the rows apart, as
    # ids may be null or repeated
    packed = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    held = stash(packed, "mix-rows")
    sizes = sized(held.select("key", "row.doc_id", "row.source", "row.text"), "key")
    taken = mix(sizes, weights, cap).where("copies > 0").select(F.col("key").alias("_key"), "copies")
    rows = held.join(taken, F.col("key") == F.col("_key"))
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_k")
    return rows.select("row", again).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix. Null and empty texts have size zero and take nothing; null sources are a source,
    the last; of equal rows any takes the odd copy; an empty table gives no rows."""
    found = mix(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
