"""Accuracies by facet, macro means, choice of temperature and checkpoint, gold comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators.ordering import dense_positions, id_groups

DIGITS = 9  # to which accuracies are compared
SPLITS = ("regular", "ambiref", "move_contents")


def facet_accuracy(predictions: DataFrame, keys: tuple[str, ...] = ("task", "temperature")) -> DataFrame:
    """Total, correct and accuracy in percent for every value of every facet (UID is one)."""
    return (
        predictions.select(*keys, F.explode("facets").alias("facet", "value"), "is_correct")
        .groupBy(*keys, "facet", "value")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"))
        .withColumn("accuracy", F.lit(100.0) * F.col("correct") / F.col("total"))
    )


def macro_accuracy(facets: DataFrame, keys: tuple[str, ...] = ("task", "temperature")) -> DataFrame:
    """Unweighted mean of the per-UID accuracies."""
    return facets.where("facet = 'UID'").groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))


def split_accuracy(
    facets: DataFrame, splits: tuple[str, ...] = SPLITS, keys: tuple[str, ...] = ("task", "temperature")
) -> DataFrame:
    """Mean of the per-UID accuracies inside each split (UID starts with its name)."""
    split = F.coalesce(*[F.when(F.col("value").startswith(s), F.lit(s)) for s in splits])
    return (
        facets.where("facet = 'UID'").withColumn("split", split).where("split is not null")
        .groupBy(*keys, "split").agg(F.avg("accuracy").alias("accuracy"))
    )


def prefix_macro_accuracy(
    facets: DataFrame, splits: tuple[str, ...] = SPLITS, keys: tuple[str, ...] = ("task", "temperature")
) -> DataFrame:
    """Mean over the splits that occur of their mean accuracy."""
    return split_accuracy(facets, splits, keys).groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))


def best_temperature(accuracies: DataFrame, keys: tuple[str, ...] = ("task",)) -> DataFrame:
    """Highest accuracy, lowest temperature among equals; NaN never wins.

    Accuracies are compared to nine digits: the last bits of a mean follow the order of a sum, which a shuffle may change.
    """
    order = F.struct(F.round("accuracy", DIGITS), -F.col("temperature"))
    return (
        accuracies.where(~F.isnan("accuracy") & (F.col("accuracy") > -1))
        .groupBy(*keys)
        .agg(F.max_by("temperature", order).alias("temperature"), F.max("accuracy").alias("accuracy"))
    )


def best_checkpoint(
    history: DataFrame, metric: str, keys: tuple[str, ...], epoch: str = "epoch", higher_is_better: bool = True
) -> DataFrame:
    """First epoch that is strictly better, to nine digits, than all before; NaN never wins."""
    value = F.round(F.col(metric) if higher_is_better else -F.col(metric), DIGITS)
    return (
        history.where(F.col(metric).isNotNull() & ~F.isnan(metric))
        .groupBy(*keys)
        .agg(
            F.max_by(epoch, F.struct(value, -F.col(epoch))).alias(epoch),
            (F.max(metric) if higher_is_better else F.min(metric)).alias(metric),
        )
    )


def classification_metrics(df: DataFrame, label: str, pred: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, binary F1 (positive = 1) and Matthews correlation from one pass over the rows."""
    y, p = F.col(label), F.col(pred)

    def cell(gold: int, got: int) -> Column:
        return F.count_if((y == gold) & (p == got)).cast("double")

    cells = df.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
        F.count_if(y == p).alias("correct"), F.count(F.lit(1)).alias("total"),
        F.count_if(~y.isin(0, 1) | ~p.isin(0, 1)).alias("other"),
    )
    c = F.col
    spread = F.sqrt((c("tp") + c("fp")) * (c("tp") + c("fn")) * (c("tn") + c("fp")) * (c("tn") + c("fn")))
    f1_base = 2 * c("tp") + c("fp") + c("fn")
    binary = F.when(c("other") > 0, F.raise_error(F.lit("binary F1 needs labels 0 and 1")).cast("double"))
    return cells.select(
        *keys, "total", (c("correct") / c("total")).alias("accuracy"),
        F.coalesce(binary, F.when(f1_base == 0, F.lit(0.0)).otherwise(2 * c("tp") / f1_base)).alias("f1"),
        F.when(spread == 0, F.lit(0.0)).otherwise((c("tp") * c("tn") - c("fp") * c("fn")) / spread).alias("mcc"),
    )


def accuracy_and_mcc(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy and Matthews correlation for any number of classes, from the confusion counts."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    gold = cells.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("t"))
    got = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("p"))
    margins = gold.join(got, "k", "full_outer").agg(
        F.sum(F.coalesce("t", F.lit(0.0)) * F.coalesce("p", F.lit(0.0))).alias("tp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    total = cells.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"))
    s, c = F.col("s"), F.col("c")
    tp, tt, pp = (margins.select(x).scalar() for x in ("tp", "tt", "pp"))
    spread = F.sqrt((s * s - pp) * (s * s - tt))
    return total.select(
        s.cast("bigint").alias("total"), (c / s).alias("accuracy"),
        F.when(spread == 0, F.lit(0.0)).otherwise((c * s - tp) / spread).alias("mcc"),
    )


def score_against_gold(
    predictions: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("subtask",), extra: tuple[str, ...] = ()
) -> DataFrame:
    """Share of equal (stripped) texts per subtask, joined on (keys, idx); unmatched rows are left out.

    ``extra`` group columns (model, revision) come from the predictions: one job for all of them.
    """
    joined = predictions.select(*extra, *keys, "idx", "pred").join(gold.select(*keys, "idx", "gold"), [*keys, "idx"])
    equal = tx.strip(F.col("pred")) == tx.strip(F.col("gold"))
    return joined.groupBy(*extra, *keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(equal).alias("correct"),
        (F.count_if(equal) / F.count(F.lit(1))).alias("score"),
    )


def macro_score(scores: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*extra).agg(F.avg("score").alias("score"))


def entity_gold(raw: DataFrame) -> DataFrame:
    """(subtask, idx, gold) of entity-tracking records: position inside (file stem, numops)."""
    subtask = F.concat_ws("_", "stem", F.col("numops").cast("string"), F.lit("ops"))
    rows = raw.select(subtask.alias("subtask"), F.col("idx").alias("_line"), F.get("options", F.lit(0)).alias("gold"))
    return dense_positions(
        rows, [F.col("_line")], id_groups(F.col("_line")), within=["subtask"], name="idx"
    ).drop("_line")
