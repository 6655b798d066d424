"""Image/text trials: accuracy, softmax over images, KL to human answers, best inverse temperature.

A trial row holds ``trial`` and ``values``: one number per image, the right image first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.session import cut_lineage

# Fixed search range of the inverse temperature.
BETA_LOW, BETA_HIGH = 0.025, 40.0
# Probabilities are clipped to this one, as in numeric.kl_clipped.
KL_FLOOR = 1e-10
_LOG_FLOOR = math.log(KL_FLOOR)
# Intervals (some tens of bytes each) that are sent to every executor; more are joined by a shuffle.
BROADCAST_INTERVALS = 100_000


def trial_accuracy(trials: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of trials whose first value is strictly greater than every other one."""
    first = F.get("values", F.lit(0))
    rest = F.expr("slice(values, 2, size(values))")
    right = F.forall(rest, lambda x: first > x)
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg(right.cast("double")).alias("accuracy")
    )


def softmax_images(trials: DataFrame, beta: float = 1.0) -> DataFrame:
    return trials.withColumn("values", nm.softmax(nm.as_doubles(F.col("values")), beta))


def _both(human: DataFrame, model: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    def filled(column: str):
        return F.transform(nm.as_doubles(F.col(column)), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))

    return human.select(*keys, "trial", filled("values").alias("p")).join(
        model.select("trial", nm.as_doubles(F.col("values")).alias("logits")), "trial"
    )


def mean_kl(human: DataFrame, model_probs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean KL(human || model) over the trials that both have; missing values count as 0."""
    return _both(human, model_probs, keys).groupBy(*keys).agg(
        F.avg(nm.kl_clipped(F.col("p"), F.transform("logits", lambda x: F.coalesce(x, F.lit(0.0))))).alias("mean_kl")
    )


def _grid(low: float, high: float, points: int) -> list[float]:
    ratio = (high / low) ** (1.0 / (points - 1))
    return [low * ratio**i for i in range(points)]


def kl_by_beta(human: DataFrame, logits: DataFrame, betas: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean KL per beta of a fixed grid (and per group), in one aggregation."""
    beta = F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta")
    return (
        _both(human, logits, keys).select(*keys, "p", "logits", beta)
        .select(*keys, "beta", nm.kl_clipped(F.col("p"), nm.softmax(F.col("logits"), F.col("beta"))).alias("kl"))
        .groupBy(*keys, "beta").agg(F.avg("kl").alias("mean_kl"))
    )


def best_of_grid(by_beta: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lowest mean KL, compared to nine digits (the last bits follow the order of a sum), then the lowest beta."""
    return by_beta.where(~F.isnan("mean_kl")).groupBy(*keys).agg(
        F.min_by("beta", F.struct(F.round("mean_kl", 9), "beta")).alias("beta"), F.min("mean_kl").alias("mean_kl")
    )


def _at(beta: Column) -> Column:
    """At one beta: the clipped KL of a trial, its slope as long as nothing is clipped, and whether something is."""
    logs = nm.let(F.transform("x", lambda v: v * beta), lambda z: nm.let(nm.log_sum_exp(z), lambda s: F.transform(z, lambda v: v - s)))
    return nm.let(
        logs,
        lambda q: F.struct(
            (F.col("entropy") - nm.dot(F.col("a"), F.transform(q, lambda v: F.greatest(v, F.lit(_LOG_FLOOR))))).alias("f"),
            (F.col("mass") * nm.total(F.zip_with(q, F.col("x"), lambda g, v: F.exp(g) * v)) - nm.dot(F.col("a"), F.col("x"))).alias("slope"),
            F.coalesce(F.array_min(q) < _LOG_FLOOR, F.lit(True)).alias("cut"),
        ),
    )


def _bounds(each: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, l, r, fl, fr, lower): mean KL at both ends of every interval and a number that it does not fall below in between.

    log softmax is concave in beta, so a trial with nothing clipped at both ends has nothing clipped between them; its KL is convex there,
    and so is the sum over such trials: it lies above its tangents at the ends. The KL of any other trial changes
    by no more than mass * (largest - smallest logit) per unit of beta.
    """
    smooth = ~F.col("p.cut") & ~F.col("q.cut")
    reach = F.coalesce(F.col("mass") * (F.array_max("x") - F.array_min("x")), F.lit(0.0)) * (F.col("r") - F.col("l"))
    rough = (F.col("p.f") + F.col("q.f") - reach) / 2
    ends = each.withColumns({"p": _at(F.col("l")), "q": _at(F.col("r"))})
    some = lambda c: F.sum(F.when(smooth, c).otherwise(0.0))
    sums = ends.groupBy(*keys, "l", "r").agg(
        F.avg("p.f").alias("fl"), F.avg("q.f").alias("fr"), F.count(F.lit(1)).alias("n"), F.sum(F.when(smooth, 0.0).otherwise(rough)).alias("rough"),
        some(F.col("p.f")).alias("sl"), some(F.col("q.f")).alias("sr"), some(F.col("p.slope")).alias("gl"), some(F.col("q.slope")).alias("gr"),
    )
    c = F.col
    meet = (c("sr") - c("sl") + c("gl") * c("l") - c("gr") * c("r")) / (c("gl") - c("gr"))
    convex = F.when(c("gl") >= 0, c("sl")).when(c("gr") <= 0, c("sr")).otherwise(c("sl") + c("gl") * (meet - c("l")))
    return sums.where(~F.isnan("fl") & ~F.isnan("fr")).select(*keys, "l", "r", "fl", "fr", ((convex + c("rough")) / c("n")).alias("lower"))


def _cut(low, high, parts: int):
    """Array of ``parts`` intervals (l, r) of equal length from ``low`` to ``high``."""
    at = lambda i: F.when(i == 0, low).when(i == parts, high).otherwise(low + (high - low) * i / parts)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(at(i).alias("l"), at(i + 1).alias("r")))


def certified_beta(
    human: DataFrame, logits: DataFrame, keys: tuple[str, ...] = (), tolerance: float = 1e-9, levels: int = 20, parts: int = 8
) -> DataFrame:
    """(keys, beta, mean_kl, error): the lowest mean KL over the whole range of beta for every group, at most ``error`` above the true minimum.

    Dividing intervals: the range is cut in intervals, each with a lower bound of the mean KL within it; those that may
    still hold something lower than the best value found by more than ``tolerance`` are cut in ``parts``. One job per level for all
    groups; the driver reads a number of intervals. ``error`` is ``tolerance`` unless ``levels`` end the search before.
    Values are compared to twelve digits (the last bits follow the order of a sum); ties go to the lower beta. Groups with NaN values give no row; missing human values count as 0.
    """
    floor = F.lit(KL_FLOOR)
    clipped = F.transform("p", lambda v: F.least(F.greatest(v, floor), F.lit(1.0)))
    prepared = cut_lineage(
        _both(human, logits, keys).select(*keys, clipped.alias("a"), F.col("logits").alias("x"))
        .select(*keys, "a", "x", F.aggregate("a", F.lit(0.0), lambda s, v: s + v * F.log(v)).alias("entropy"), nm.total(F.col("a")).alias("mass"))
    )
    grid = _grid(BETA_LOW, BETA_HIGH, 4 * parts + 1)
    first = F.array(*[F.struct(F.lit(low).alias("l"), F.lit(high).alias("r")) for low, high in zip(grid, [*grid[1:-1], BETA_HIGH])])
    each = prepared.select("*", F.inline(first))
    best, columns = None, [*keys, "beta", "mean_kl"]
    for level in range(levels):
        bounds = cut_lineage(_bounds(each, keys))
        ends = bounds.select(*keys, F.inline(F.array(*[F.struct(F.col(b).alias("beta"), F.col(f).alias("mean_kl")) for b, f in (("l", "fl"), ("r", "fr"))])))
        found = ends if best is None else ends.unionByName(best.select(columns))
        best = cut_lineage(
            found.groupBy(*keys).agg(F.min_by("beta", F.struct(F.round("mean_kl", 12), "beta")).alias("beta"), F.min("mean_kl").alias("mean_kl"))
            .where("mean_kl is not null")
        )
        known = best.select(*keys, "mean_kl")
        together = bounds.join(known, list(keys)) if keys else bounds.crossJoin(known)  # without keys ``known`` is one row
        open_ones = together.where(F.col("lower") < F.col("mean_kl") - tolerance).select(*keys, "l", "r", (F.col("mean_kl") - F.col("lower")).alias("gap"))
        left = open_ones.count()
        if left == 0:
            return best.withColumn("error", F.lit(tolerance))
        if level < levels - 1:
            new = open_ones.select(*keys, F.inline(_cut(F.col("l"), F.col("r"), parts)))
            side = F.broadcast(new) if left * parts <= BROADCAST_INTERVALS else new
            each = prepared.join(side, list(keys)) if keys else prepared.crossJoin(side)
    gaps = open_ones.groupBy(*keys).agg(F.max("gap").alias("gap"))
    reported = best.join(gaps, list(keys), "left") if keys else best.crossJoin(gaps)
    return reported.select(*columns, F.greatest(F.coalesce("gap", F.lit(0.0)), F.lit(tolerance)).alias("error"))


def best_beta(human: DataFrame, logits: DataFrame, tolerance: float = 1e-9) -> tuple[float, float]:
    """(beta, mean KL) of the minimum over all trials; (NaN, infinity) without any."""
    row = certified_beta(human, logits, (), tolerance).first()
    return (float("nan"), float("inf")) if row is None else (row["beta"], row["mean_kl"])


def best_beta_by_group(human: DataFrame, logits: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, beta, mean_kl, error) for every group."""
    return certified_beta(human, logits, (key,), tolerance)
