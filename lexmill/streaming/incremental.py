"""Structured Streaming forms: page ingestion, rates, sessions, running accuracy, resumable results."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.session import shared_path


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they appear under ``path``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def new_pages(pages: DataFrame, url: str = "url", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First row of every URL; the state of a URL is dropped when the watermark has passed it."""
    return pages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([url])


def ingest_rate(events: DataFrame, ts: str = "ts", width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows per tumbling window. In append mode a window is emitted once, when the watermark has passed it; in update mode at
    every change."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "n"
    )


def ingest_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts per key that are separated by idle gaps."""
    session = F.session_window(ts, gap).alias("session")
    return events.withWatermark(ts, delay).groupBy(session, key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n"
    )


def with_last_row(events: DataFrame, last: DataFrame, name: str = "last") -> DataFrame:
    """The stream with the rows of ``last`` as a second source.

    A row far behind all events in time moves the watermark past them, so that a drained stream leaves nothing in its state.
    """
    spark = events.sparkSession
    path = shared_path(spark, name)
    last.select(*events.columns).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


def running_facet_accuracy(predictions: DataFrame) -> DataFrame:
    """Totals per facet value while predictions arrive (update mode); the state has one row per value."""
    return (
        predictions.select(F.explode("facets").alias("facet", "value"), "is_correct")
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"))
        .withColumn("accuracy", F.lit(100.0) * F.col("correct") / F.col("total"))
    )


def append_new_rows(results: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Append result rows to the table at ``path``, leaving out rows whose ``keys`` (step, word, context) it has already.

    A step may arrive over any number of batches, so how many files a batch takes does not change the result. Every batch
    writes below its own folder (by the query's state and the batch) in overwrite mode, so a replayed batch replaces what its
    first try left behind, and a query with fresh state adds to the table. Null keys equal each other.
    """
    own = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(list(keys))
        done = _known_rows(batch.sparkSession, path, own, batch_id, keys)
        if done is not None:
            same = [fresh[k].eqNullSafe(done[k]) for k in keys]
            fresh = fresh.join(done, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/run={own}/batch={batch_id}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known_rows(spark: SparkSession, path: str, own: str, batch_id: int, keys: Sequence[str]) -> DataFrame | None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return None
    return spark.read.parquet(path).where((F.col("run") != own) | (F.col("batch") != batch_id)).select(*keys)


def drain(stream: DataFrame, output_mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all available input and return its rows from a table in the shared folder.

    Append mode uses the file sink; other modes write every batch and keep the latest row per key.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{path}-state")
    if output_mode == "append":
        query = writer.format("parquet").option("path", path).trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part-{batch_id}")

        query = writer.foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    if output_mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key of a drained update-mode stream."""
    rest = [c for c in updates.columns if c not in keys]
    return (
        updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("u")).select(*keys, "u.*").drop("_batch")
    )
