"""Writers: ordered text, prediction documents, partitioned JSONL, results layout, small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import add_document_markers


def write_text(df: DataFrame, path: str, order: list[str], text: str = "text", mode: str = "error") -> None:
    """Lines in global order: range-partitioned, so the part files concatenate to the text."""
    df.orderBy(*order).select(text).write.mode(mode).text(path)


def write_marked_stream(df: DataFrame, path: str, order: list[str], text: str = "text", mode: str = "error") -> None:
    """Documents in order as one stream ``<s> a </s> <s> b </s> ``; the part files concatenate to it."""
    marked = df.orderBy(*order).select(add_document_markers(F.col(text)).alias(text))
    marked.write.mode(mode).option("lineSep", " ").text(path)


def prediction_document_lines(predictions: DataFrame, best_temperature: float | None = None) -> DataFrame:
    """Lines that, in (subtask, part, idx) order, form one nested prediction document.

    ``{"subtask": {"predictions": [...]}, ...}`` without gathering a subtask in one row: every
    prediction is a line of its own, so the document may be larger than any task.
    """
    if best_temperature is not None:
        predictions = predictions.where(F.abs(F.col("temperature") - best_temperature) < 1e-9)
    fields = [c for c in ("id", "pred", "prob", "prev_pred") if c in predictions.columns]
    heads = predictions.groupBy("subtask").agg(F.min("idx").alias("_first"))
    first = predictions.agg(F.min("subtask").alias("s")).scalar()
    name = F.regexp_extract(F.to_json(F.struct(F.col("subtask").alias("k"))), r'^\{"k":(.*)\}$', 1)
    opening = F.concat(F.when(F.col("subtask") == first, F.lit("{")).otherwise(F.lit(",")), name, F.lit(': {"predictions": ['))
    entry = F.concat(F.when(F.col("idx") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), F.to_json(F.struct(*fields)))
    last = predictions.agg(F.max("subtask").alias("s")).scalar()
    closing = F.when(F.col("subtask") == last, F.lit("]}}")).otherwise(F.lit("]}"))
    minus = F.lit(-1).cast("bigint")
    return (
        heads.select("subtask", F.lit(0).alias("part"), minus.alias("idx"), opening.alias("line"))
        .unionByName(
            predictions.join(heads, "subtask").select("subtask", F.lit(1).alias("part"), "idx", entry.alias("line"))
        )
        .unionByName(heads.select("subtask", F.lit(2).alias("part"), minus.alias("idx"), closing.alias("line")))
    )


def write_predictions(predictions: DataFrame, path: str, best_temperature: float | None = None, mode: str = "error") -> None:
    lines = prediction_document_lines(predictions, best_temperature)
    write_text(lines, path, ["subtask", "part", "idx"], "line", mode)


def write_partitioned_jsonl(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """One folder of JSONL files per value of ``key``."""
    df.write.mode(mode).partitionBy(key).json(path)


def results_layout(df: DataFrame) -> DataFrame:
    """Partition columns of stored results; an empty revision is ``main``."""
    return df.withColumn("revision", F.coalesce("revision", F.lit("main")))


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by (model, revision, backend, task, dataset): readers prune by folder."""
    results_layout(df).write.mode(mode).partitionBy("model", "revision", "backend", "task", "dataset").parquet(path)


def write_scores_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_jsonl_report(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)
