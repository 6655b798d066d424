"""Exact search by vector-approximation files.

The approximation file has one cell number per component (CELLS equal cells between the least and greatest component of that dimension), stored apart
from the vectors. First the cells are scanned, in blocks against blocks of queries: they give a lower and an upper bound of every
inner product, and what cannot be among the k best of its block is left out; the k-th largest lower bound over all blocks leaves
out more. Then exact vectors are read in the order of the bounds: those of the k best bounds first, whose k-th exact score
excludes the rest whose upper bound is below it, and what remains last. So the k-th result is certain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import stored
from lexmill.llm.vectors import classes, matrix, usable, vector_digest

CELLS = 128
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512


def _bounds(k: int, dimensions: int, low: np.ndarray, width: np.ndarray):
    """Compare a block of cells with a block of queries; keeps what may be among the k best of the block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.empty(0, object), "class_id": np.empty(0, object), "lower": np.empty(0), "upper": np.empty(0)})
        if not len(left) or not len(right):
            return empty
        cells = np.frombuffer(b"".join(left["cells"]), np.uint8).reshape(len(left), dimensions)
        lo = low + cells * width
        hi = lo + width
        q = matrix(right["vector"])
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        upper = plus @ hi.T + minus @ lo.T
        lower = plus @ lo.T + minus @ hi.T
        # rounding of the sums of products: a bound on its size keeps the bounds safe
        slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T + 1)
        upper, lower = upper + slack, lower - slack
        counts = left["n"].to_numpy()
        out = []
        names, own = left["class_id"].to_numpy(), right["asked"].to_numpy()
        for i in range(len(q)):
            order = np.argsort(-lower[i], kind="stable")
            reach = np.searchsorted(np.cumsum(counts[order]), k + 1)  # one more, as a query's own row does not count
            least = lower[i][order[min(reach, len(order) - 1)]] if counts.sum() > k else -np.inf
            keep = np.flatnonzero(upper[i] >= least)
            out.append(pd.DataFrame({"query": own[i], "class_id": names[keep], "lower": lower[i][keep], "upper": upper[i][keep]}))
        return pd.concat(out) if out else empty

    return run


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def integer_vector(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as double; null, NaN and infinite components stay what they are.

    FLOOR of a double is a long, which turns NaN into 0 and cuts infinities; doubles from 2^53 on are whole already.
    """

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def top_k(rows: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """The k largest inner products of each query with other rows: query_id, rank, vec_id, score; ties to the smaller id.

    ``rows``: vec_id and vector (of doubles, one length). ``queries`` is a condition on vec_id. Rows whose vector is null or
    empty or holds a null or non-finite component, or whose vec_id is null, take no part. A query that fewer rows face gets all
    of them. Equal vectors are one entry of the approximation file; a vec_id names one vector, and its repeated rows count once
    as candidates (as queries each row is answered). An empty table gives no rows.
    """
    spark = rows.sparkSession
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector")
    # a query is kept out of its own result, so one more id of each class is enough
    entries = stored(classes(good, k + 1).withColumn("n", F.size("ids")), "vectors")
    asked = stored(good.where(queries).select("vec_id", vector_digest("vector").alias("class_id")), "queries")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    shape = entries.agg(F.max(F.size("vector")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    d = shape["d"]
    spans = entries.select(*[f(F.element_at("vector", i + 1)).alias(f"{name}{i}") for i in range(d) for name, f in (("a", F.min), ("b", F.max))])
    ends = spans.first()
    low = np.array([ends[f"a{i}"] for i in range(d)], float)
    width = np.maximum((np.array([ends[f"b{i}"] for i in range(d)], float) - low) / CELLS, 1e-9)

    blocks = max(1, -(-shape["n"] // BLOCK_ROWS))
    query_classes = asked.select("class_id").distinct()
    groups = max(1, -(-query_classes.count() // BLOCK_QUERIES))
    hashed = lambda n, salt: F.pmod(F.xxhash64("class_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    @F.pandas_udf("binary")
    def cell_numbers(v: pd.Series) -> pd.Series:
        found = np.clip(np.floor((matrix(v) - low) / width), 0, CELLS - 1).astype(np.uint8) if len(v) else np.empty((0, d), np.uint8)
        return pd.Series([row.tobytes() for row in found], dtype=object)

    file = entries.select("class_id", "n", cell_numbers("vector").alias("cells"))
    left = file.select("class_id", "n", "cells", hashed(blocks, "v").alias("v"), every(groups).alias("q"))
    right = entries.join(query_classes, "class_id", "left_semi").select(F.col("class_id").alias("asked"), "vector", hashed(groups, "q").alias("q"), every(blocks).alias("v"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded = (
        left.repartition(n, "v", "q").groupBy("v", "q")
        .cogroup(right.repartition(n, "v", "q").groupBy("v", "q"))
        .applyInPandas(_bounds(k, d, low, width), "query string, class_id string, lower double, upper double")
    )
    bounded = stored(bounded, "bounds").join(entries.select("class_id", "n"), "class_id")

    # The k + 1 best lower bounds of each query over all blocks, and their exact scores.
    by_lower = Window.partitionBy("query").orderBy(F.col("lower").desc(), "class_id")
    vectors = entries.select("class_id", "ids", "vector")
    of_query = entries.select(F.col("class_id").alias("query"), F.col("vector").alias("vector_q"))

    def exact(candidates: DataFrame) -> DataFrame:
        return candidates.join(vectors, "class_id").join(of_query, "query").select("query", "class_id", "ids", _dot("vector", "vector_q").alias("score"))

    first = stored(exact(bounded.withColumn("_r", F.row_number().over(by_lower)).where(F.col("_r") <= k + 1).select("query", "class_id")), "first")
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "class_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = first.withColumn("_sum", F.sum(F.size("ids")).over(by_score))
    certain = counted.where(F.col("_sum") >= k + 1).groupBy("query").agg(F.max("score").alias("least"))
    rest = bounded.join(first.select("query", "class_id"), ["query", "class_id"], "left_anti").join(certain, "query", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("query", "class_id")
    scored = first.unionByName(exact(rest))

    # k + 1 rows per distinct query vector, then each query leaves itself out.
    each = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = stored(each.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1), "best")
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("found"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")).join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("_at", "x")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
