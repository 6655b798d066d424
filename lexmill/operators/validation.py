"""Completeness checks, checkpoint schedules, collation and scoreboards over a predictions table.

Predictions: ``model, revision, task, subtask, idx, id, pred, prob``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MILLION = 1_000_000


def size_catalogue(spark: SparkSession, sizes: dict[str, int | dict[str, int]]) -> DataFrame:
    """(task, subtask, expected); a plain number holds for every subtask (NULL subtask)."""
    rows = []
    for task, value in sizes.items():
        rows += [(task, s, n) for s, n in value.items()] if isinstance(value, dict) else [(task, None, value)]
    return spark.createDataFrame(rows, "task string, subtask string, expected bigint")


def check_sizes(predictions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Subtasks whose number of rows differs from the catalogue, or that only one side has.

    Names are compared in lower case. An entry without subtask gives the size of all subtasks of its
    task. The catalogue has one row per subtask, so it is the small side by construction.
    """
    found = predictions.groupBy("task", F.lower("subtask").alias("subtask")).agg(F.count(F.lit(1)).alias("found"))
    named = catalogue.where("subtask is not null").select("task", F.lower("subtask").alias("subtask"), "expected")
    common = catalogue.where("subtask is null").select("task", F.col("expected").alias("_any"))
    joined = found.join(named, ["task", "subtask"], "full_outer").join(common, "task", "left")
    # A task of one size that has no rows at all.
    absent = common.join(found.select("task").distinct(), "task", "left_anti").select(
        "task", F.lit(None).cast("string").alias("subtask"), F.lit(0).cast("bigint").alias("found"),
        F.col("_any").alias("expected"),
    )
    return (
        joined.select(
            "task", "subtask", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", "_any").alias("expected")
        )
        .unionByName(absent)
        .where("expected is null or found <> expected")
    )


def check_completeness(predictions: DataFrame, required: DataFrame) -> DataFrame:
    """Required (task, dataset) sets of which there is no row."""
    return required.join(predictions.select("task", "dataset").distinct(), ["task", "dataset"], "left_anti")


def checkpoint_schedule(spark: SparkSession, track: str) -> DataFrame:
    """(ord, step, word_count): 1..9M, 10..100M by ten, and 200..1000M except for strict-small."""
    millions = [*range(1, 10), *range(10, 101, 10)]
    if track != "strict-small":
        millions += range(200, 1001, 100)
    rows = [(i, f"chck_{m}M", m * MILLION) for i, m in enumerate(millions)]
    return spark.createDataFrame(rows, "ord int, step string, word_count bigint")


def check_checkpoints(results: DataFrame, schedule: DataFrame, rows_per_step: int) -> DataFrame:
    """Steps that are missing, unexpected, or have a wrong number of rows."""
    found = results.groupBy("step").agg(F.count(F.lit(1)).alias("found"))
    return (
        schedule.select("step", F.lit(rows_per_step).cast("bigint").alias("expected"))
        .join(found, "step", "full_outer")
        .select("step", F.coalesce("found", F.lit(0)).alias("found"), "expected")
        .where("expected is null or found <> expected")
    )


def check_shapes(arrays: DataFrame, name: str = "name", values: str = "values") -> DataFrame:
    """Rows and the smallest and largest row width of stored float arrays, per name."""
    return arrays.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size(values)).alias("min_width"),
        F.max(F.size(values)).alias("max_width"),
        F.count_if(F.exists(values, lambda x: x.isNull())).alias("n_with_null"),
    )


def assert_float_arrays(arrays: DataFrame, values: str = "values") -> None:
    kind = arrays.schema[values].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        raise TypeError(f"column {values} must hold floats, not {kind}")


def resume_steps(schedule: DataFrame, done: DataFrame) -> DataFrame:
    """Steps not done yet, each with its own word count."""
    return schedule.join(done.select("step").distinct(), "step", "left_anti")


def append_results(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows plus those of steps that are not there yet."""
    fresh = new.join(existing.select("step").distinct(), "step", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def results_metadata(results: DataFrame, schedule: DataFrame) -> DataFrame:
    steps = results.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return steps.agg(
        F.count(F.lit(1)).alias("completed_steps"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_results")
    ).withColumn("total_steps", schedule.agg(F.count(F.lit(1))).scalar())


def collate_predictions(parts: list[DataFrame]) -> DataFrame:
    """Union of task tables; columns a task lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_later_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which the rows of a later part replace those with the same key of earlier parts."""
    numbered = collate_predictions([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    last = numbered.groupBy(*key).agg(F.max("_part").alias("_part"))
    return numbered.join(last, [*key, "_part"], "left_semi").drop("_part")


def scoreboard(metrics: list[tuple[str, DataFrame]]) -> DataFrame:
    """(line, name, score): one line per metric, percent with two decimals."""
    lines = [
        df.select(F.lit(i).alias("line"), F.lit(name).alias("name"), (F.col("score") * 100).alias("score"))
        for i, (name, df) in enumerate(metrics)
    ]
    return reduce(DataFrame.unionByName, lines).withColumn("text", F.format_string("%s: %.2f", "name", "score"))


def format_report(facets: DataFrame, averages: DataFrame, metric: str = "ACCURACY") -> DataFrame:
    """Text lines of a report with their order (temperature, block, facet, part, value).

    Per temperature: head line, per facet a title and ``value: xx.xx`` lines, then the average;
    blocks end with an empty line. Rank correlations pass ``metric="SPEARMAN'S RHO"``.
    """
    def lines(df: DataFrame, block: int, part: int, line, facet=None, value=None) -> DataFrame:
        empty = F.lit("")
        return df.select(
            "temperature", F.lit(block).alias("block"), (empty if facet is None else facet).alias("facet"),
            F.lit(part).alias("part"), (empty if value is None else value).alias("value"), line.alias("line"),
        )

    facet, empty = F.col("facet"), F.lit("")
    names = facets.select("temperature", "facet").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            lines(averages, 0, 0, F.format_string("TEMPERATURE: %.2f", "temperature")),
            lines(averages, 0, 1, empty),
            lines(names, 1, 0, F.concat(F.lit("### "), F.upper(facet), F.lit(f" {metric}")), facet),
            lines(facets, 1, 1, F.format_string("%s: %.2f", "value", "accuracy"), facet, F.col("value")),
            lines(names, 1, 2, empty, facet),
            lines(averages, 2, 0, F.lit(f"### AVERAGE {metric}")),
            lines(averages, 2, 1, F.format_string("%.2f", "accuracy")),
            lines(averages, 2, 2, empty),
        ],
    )


REPORT_ORDER = ["temperature", "block", "facet", "part", "value"]
