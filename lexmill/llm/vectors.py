"""Vectors of the search operators: which take part, classes of equal vectors, blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Neither null nor empty nor holding a null or non-finite component (nor all zero)."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = good & (F.size(vector) > 0)
    if nonzero:
        good = good & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def vector_digest(vector: Column | str) -> Column:
    """128 bits that name a vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.concat(F.hex(F.xxhash64(F.lit(1), v)), F.lit("."), F.hex(F.xxhash64(F.lit(2), v)))


def classes(rows: DataFrame, ids_each: int) -> DataFrame:
    """One row per distinct vector of (vec_id, vector): class_id, vector, and its ``ids_each`` smallest ids in order.

    Equal vectors have equal scores and ties go to the smaller id, so no search needs more of them. Repeated rows count once.
    The ranking is cut to ``ids_each`` rows per vector before the shuffle (a rank filter on a window), so a very common
    vector is not gathered.
    """
    marked = rows.withColumn("class_id", vector_digest("vector")).groupBy("class_id", "vec_id").agg(F.first("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("vec_id"))
    few = marked.withColumn("_rank", rank).where(F.col("_rank") <= ids_each)
    return few.groupBy("class_id").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")
    )


def matrix(values, dtype=np.float64) -> np.ndarray:
    """Rows of a pandas column of equally long arrays."""
    return np.array([np.asarray(v, dtype) for v in values]) if len(values) else np.empty((0, 0), dtype)
