"""Losses from stored logits: teacher ensembles, distillation loss, perplexity, model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import numeric as nm

POSITION = ["seq", "pos"]


def ensemble_mean_logits(teachers: DataFrame, keys: list[str] | None = None, logits: str = "logits") -> DataFrame:
    """Element-wise mean of the teachers' logits per position.

    One vector per teacher and position; they are added up pair by pair with ``reduce`` over the
    handful of teachers, without exploding the vocabulary axis.
    """
    keys = keys or POSITION
    stacked = F.collect_list(nm.as_doubles(F.col(logits)))
    added = F.reduce(
        F.slice("_all", F.lit(2), F.size("_all")), F.get("_all", F.lit(0)),
        lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b),
    )
    return (
        teachers.groupBy(*keys).agg(stacked.alias("_all"))
        .withColumn(logits, F.transform(added, lambda v: v / F.size("_all")))
        .drop("_all")
    )


def distillation_loss(
    student: DataFrame, teacher: DataFrame, temperature: float = 2.0, alpha: float = 0.5,
    keys: list[str] | None = None, batch: tuple[str, ...] = ("batch",),
) -> DataFrame:
    """alpha * CE + (1 - alpha) * T^2 * KL(teacher || student) per batch.

    KL is summed over positions and vocabulary and divided by the number of sequences of the batch;
    CE is the mean over positions with a label other than -100.
    """
    keys = keys or POSITION
    t = nm.log_softmax(F.col("_t"), temperature)
    s = nm.log_softmax(F.col("_s"), temperature)
    rows = student.select(*batch, *keys, "label", nm.as_doubles(F.col("logits")).alias("_s")).join(
        teacher.select(*keys, nm.as_doubles(F.col("logits")).alias("_t")), keys
    )
    valid = F.col("label") != -100
    losses = rows.select(
        *batch, *keys, nm.total(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b))).alias("kl"),
        F.when(valid, -nm.target_logprob(F.col("_s"), F.col("label"))).alias("ce"),
    )
    # Sequences are counted by pre-aggregating to one row each.
    per_seq = losses.groupBy(*batch, keys[0]).agg(
        F.sum("kl").alias("kl"), F.sum("ce").alias("ce"), F.count("ce").alias("n_ce")
    )
    sums = per_seq.groupBy(*batch).agg(
        F.sum("kl").alias("kl"), F.sum("ce").alias("ce"), F.sum("n_ce").alias("n_ce"), F.count(F.lit(1)).alias("n_seq")
    )
    kl = F.col("kl") / F.col("n_seq") * (temperature * temperature)
    ce = F.col("ce") / F.col("n_ce")
    return sums.select(*batch, ce.alias("ce"), kl.alias("kl"), (ce * alpha + kl * (1.0 - alpha)).alias("loss"))


def token_weighted_loss(batches: DataFrame, keys: tuple[str, ...] = (), loss: str = "loss", valid: str = "n_valid") -> DataFrame:
    """Mean loss weighted by valid tokens, and its perplexity."""
    mean = F.sum(F.col(loss) * F.col(valid)) / F.sum(valid)
    return batches.groupBy(*keys).agg(mean.alias("loss")).withColumn("perplexity", F.exp("loss"))


def valid_tokens(labels: str = "labels"):
    return F.size(F.filter(labels, lambda x: x != -100))


def compare_models(losses: DataFrame, base: str, other: str, model: str = "model") -> DataFrame:
    """Differences of loss and perplexity; percent improvement only if perplexity went down."""
    def of(name: str, metric: str):
        return F.max(F.when(F.col(model) == name, F.col(metric)))

    row = losses.where(F.col(model).isin(base, other)).agg(
        of(base, "loss").alias("base_loss"), of(base, "perplexity").alias("base_ppl"),
        of(other, "loss").alias("other_loss"), of(other, "perplexity").alias("other_ppl"),
    )
    d_loss, d_ppl = F.col("other_loss") - F.col("base_loss"), F.col("other_ppl") - F.col("base_ppl")
    return row.select(
        "base_loss", "other_loss", d_loss.alias("loss_diff"), d_ppl.alias("ppl_diff"),
        F.when(d_ppl < 0, F.abs(d_ppl / F.col("base_ppl") * 100)).alias("ppl_improvement"),
    )
