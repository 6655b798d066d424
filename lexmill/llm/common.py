"""Helpers shared by the corpus operators: stored intermediate tables, size-checked semi joins, dense positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import shared_path

# Words of all contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Up to so many keys (8 bytes each) a semi join sends its key side to every executor; beyond it the join shuffles.
BROADCAST_KEYS = 500_000
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Later steps read files that every executor sees, so a lost executor costs a task and not the chain before it.
    """
    path = shared_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` has written; call it when their results have been written elsewhere."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_keys(df: DataFrame, keys: DataFrame, key: str, without: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the stored table ``keys`` (``without``: is not); NULL equals NULL.

    The keys are broadcast only if their count is within BROADCAST_KEYS; else both sides are shuffled.
    """
    side = keys.select(F.col(key).alias("_key")).distinct()
    if keys.count() <= BROADCAST_KEYS:
        side = F.broadcast(side)
    return df.join(side, df[key].eqNullSafe(side["_key"]), "left_anti" if without else "left_semi")


def slots(df: DataFrame, key: Column | str, order: Column, spread: int = 1024, name: str = "slot") -> DataFrame:
    """Add ``name``: gapless positions from 0 within each ``key``, without one task per key.

    Rows of a key are cut into ``spread`` hash buckets of ``order`` (a 64-bit hash that tells rows apart); each bucket
    numbers its own rows, and the sizes of earlier buckets, one small row each, are added by a join.
    """
    bucket = F.pmod(order, F.lit(spread)).cast("int")
    cut = df.withColumn("_key", key if isinstance(key, Column) else F.col(key)).withColumn("_order", order).withColumn("_bucket", bucket)
    sizes = cut.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_key", "_bucket").orderBy("_order")
    numbered = cut.withColumn("_own", F.row_number().over(inner) - 1)
    joined = numbered.join(starts, ["_key", "_bucket"])
    return joined.withColumn(name, (F.col("_start") + F.col("_own")).cast("bigint")).drop("_key", "_bucket", "_order", "_start", "_own")
