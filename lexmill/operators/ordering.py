"""Running totals, positions and ranks over any number of rows.

A window without partition columns puts every row into one task. Here rows are first cut into
order-preserving groups (id ranges, prefixes of a hash, quantile buckets). Each group gets its own
window; the totals of the earlier groups are added by a join with the much smaller group table,
whose own running total is built the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Groups = Sequence[tuple[str, Column]]


def id_groups(key: Column, shifts: Sequence[int] = (28, 12)) -> Groups:
    """Ranges of a non-negative integer key, coarse to fine; unique keys bound every range."""
    return [(f"_range{s}", F.shiftright(key.cast("bigint"), s)) for s in shifts]


def hash_groups(digest: Column, digits: Sequence[int] = (2, 5)) -> Groups:
    """Prefixes of a hexadecimal digest, coarse to fine; evenly filled whatever the data."""
    return [(f"_hex{n}", F.substring(digest, 1, n)) for n in digits]


def running_total(
    df: DataFrame,
    weight: Column,
    order: Sequence[Column],
    groups: Groups,
    within: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Add ``name``: the summed weight of all rows before this one, per ``within`` key.

    The order is (groups, order) and must be total. NULL weights count as 0.
    """
    weighted = df.withColumn("_weight", F.coalesce(weight, F.lit(0)))
    for group, expr in groups:
        weighted = weighted.withColumn(group, expr)
    return _running_total(weighted, list(order), [g for g, _ in groups], list(within), name).drop(
        "_weight", *[g for g, _ in groups]
    )


def _running_total(
    df: DataFrame, order: list[Column], groups: list[str], within: list[str], name: str
) -> DataFrame:
    keys = within + groups
    window = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = df.withColumn(name, F.coalesce(F.sum("_weight").over(window), F.lit(0)))
    if not groups:
        return inner
    sums = df.groupBy(*keys).agg(F.sum("_weight").alias("_weight"))
    offset = f"_offset{len(groups)}"
    offsets = _running_total(sums, [F.col(groups[-1])], groups[:-1], within, offset)
    return (
        inner.join(offsets.select(*keys, offset), keys)
        .withColumn(name, F.col(name) + F.col(offset))
        .drop(offset)
    )


def dense_positions(
    df: DataFrame,
    order: Sequence[Column],
    groups: Groups,
    within: Sequence[str] = (),
    name: str = "pos",
) -> DataFrame:
    """Zero-based position of every row in the given total order, per ``within`` key."""
    return running_total(df, F.lit(1).cast("bigint"), order, groups, within, name)


def quantile_groups(df: DataFrame, column: str, buckets: int | None = None) -> tuple[DataFrame, str]:
    """Order-preserving buckets of a double column, cut at approximate quantiles.

    There are at least as many buckets as shuffle partitions. The cut points are fixed on the driver (at most ``buckets`` numbers), so every pass over the
    data uses the same ones.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(column, probabilities, 1.0 / (4 * buckets)) or []))
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0)), "_bucket"
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(
        splits=splits, inputCol=column, outputCol="_bucket", handleInvalid="keep"
    ).transform(df), "_bucket"


def average_ranks(
    df: DataFrame, column: str, name: str = "avg_rank", buckets: int | None = None, weight: str | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Distinct values of ``column`` with their count and average rank (ties share the mean rank), per ``within`` key.

    With ``weight`` a row stands for that many equal values.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (
        df.where(F.col(column).isNotNull() & ~F.isnan(column))
        .groupBy(*within, F.col(column).cast("double").alias(column))
        .agg(size.alias("n"))
    )
    bucketed, bucket = quantile_groups(counts, column, buckets)
    ranked = running_total(
        bucketed, F.col("n"), [F.col(column)], [("_cut", F.col(bucket))], within=within, name="_smaller"
    )
    return ranked.select(
        *within, column, "n", (F.col("_smaller") + (F.col("n") + 1) / F.lit(2.0)).alias(name)
    )
