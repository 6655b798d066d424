"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Every document has a 60-bit hash. A source whose target is ``q`` times its size takes every document floor(q) times and, once
more, the documents below a hash threshold. The threshold comes from nested histograms: words are summed by source and the
leading BITS bits of the hash, the bucket in which the sum passes the budget is found, and only this bucket is cut again, LEVELS times.
No document is sorted, and the documents below a threshold of a smaller budget are a subset of those below a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, stored

BITS = 12
LEVELS = 5  # 5 * 12 bits: the whole hash
WEIGHTS = (5, 2, 1)
LIMIT = 3  # a target is at most so many times its source's size


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 digest of id and text, as a number."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Add ``target`` to (source, source_size): shares of the total by weight, none above ``limit`` times its size.

    The weights repeat over the sources in code point order, null last. What exceeds a bound is shared among the others by
    weight until none is above: there is one level with target = min(limit * size, level * weight), found from running sums
    over the sources in order of limit * size / weight. The windows hold one row per source.
    """
    named = sources.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    bound = named.withColumn("_w", weight).withColumn("_bound", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("_bound") / F.col("_w"), "_at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = bound.select(
        "*", F.coalesce(F.sum("_bound").over(before), F.lit(0.0)).alias("_full"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_used"),
        F.sum("source_size").over(every).cast("double").alias("_total"), F.sum("_w").over(every).alias("_all"),
    )
    # the first source, in this order, that stays below its bound at the level the earlier ones leave
    level = (F.col("_total") - F.col("_full")) / (F.col("_all") - F.col("_used"))
    open_ = ranked.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_bound"))
    chosen = F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), F.col("_used"))).over(every)
    target = F.least(F.col("_bound"), F.coalesce(chosen, F.lit(0.0)) * F.col("_w"))
    return open_.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents with a hash below ``below`` have a sum of sizes nearest to the source's ``budget``.

    ``rows``: source, size, hash. Of two equally near thresholds the smaller one holds. Equal hashes stay together.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("sum"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(state, rows["source"].eqNullSafe(state["source"])).drop(state["source"])
        inside = inside.where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        histogram = inside.groupBy("source", "budget", "sum", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = histogram.withColumn("_upto", F.col("sum") + F.sum("n").over(upto))
        # the boundary bucket: the first that reaches the budget, or else the last one
        reached = F.when(F.col("_upto") >= F.col("budget"), F.struct(F.col("bucket"), (F.col("_upto") - F.col("n")).alias("sum"), F.col("n").alias("n")))
        last = F.struct(F.col("bucket"), (F.col("_upto") - F.col("n")).alias("sum"), F.col("n").alias("n"))
        found = run.groupBy("source", "budget").agg(F.coalesce(F.min(reached), F.max(last)).alias("b"))
        state = stored(found.select("source", "budget", F.col("b.bucket").alias("prefix"), F.col("b.sum").alias("sum"), F.col("b.n").alias("n")), "level")
        if level < LEVELS - 1:
            state = state.drop("n")
    nearer = F.col("sum") + F.col("n") - F.col("budget") < F.col("budget") - F.col("sum")
    return state.select("source", (F.col("prefix") + nearer.cast("bigint")).alias("below"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text, 0 for null) and hash of every document."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        mix_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target, times, below) from the rows of ``sizes``."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = stored(
        targets(sources, weights, limit)
        .withColumn("times", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("int"))
        .withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")), "targets",
    )
    below = thresholds(rows, wanted.where("budget > 0").select("source", "budget")).withColumnRenamed("source", "_source")
    return wanted.join(below, wanted["source"].eqNullSafe(below["_source"]), "left").select(
        "source", "source_size", "target", "times", F.coalesce("below", F.lit(0)).cast("bigint").alias("below")
    )


def copies(times: Column, hash_: Column, below: Column) -> Column:
    """How often the mix takes a document."""
    return times + (hash_ < below).cast("int")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies.

    Only doc_id, text and source are read. Defined cases: a null text has size 0; a null source is a source of its own, last
    in order; a source without words has target 0 and its documents are not taken; rows with equal id and text share their
    hash, so they are taken together; an empty table gives no rows.
    """
    rows = stored(sizes(docs), "sizes")
    found = plan(rows, weights, limit).withColumnRenamed("source", "_source")
    taken = copies(F.col("times"), F.col("hash"), F.col("below"))
    return rows.join(found, rows["source"].eqNullSafe(found["_source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * taken).alias("taken"), taken.alias("copies")
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    rows = stored(sizes(docs), "sizes")
    found = plan(rows, weights, limit).select(F.col("source").alias("_source"), F.col("times").alias("_times"), F.col("below").alias("_below"))
    joined = docs.join(F.broadcast(found) if found.count() <= 1000 else found, docs["source"].eqNullSafe(F.col("_source")))
    n = copies(F.col("_times"), mix_hash(F.col("doc_id"), F.col("text")), F.col("_below"))
    out = [F.col(c) for c in docs.columns]
    return joined.where(n > 0).select(*out, F.explode(F.sequence(F.lit(1), n)).alias("_copy")).drop("_copy")
