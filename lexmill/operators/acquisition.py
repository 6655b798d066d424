"""Age of acquisition: wide-to-long word tables, sigmoid fits per word, curve fitness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.operators.stats import pearson
from lexmill.session import python_partitions

AGES = range(16, 31)
APPROXIMATE_VOCAB = 300_000


def cdi_to_long(cdi: DataFrame) -> DataFrame:
    """(word, age, proportion) from the age columns that exist; missing values are dropped."""
    ages = [str(a) for a in AGES if str(a) in cdi.columns]
    if not ages:
        raise ValueError("No age columns found in CDI data")
    return (
        cdi.unpivot(["word"], ages, "age", "proportion")
        .where(F.col("proportion").isNotNull() & ~F.isnan("proportion"))
        .select("word", F.col("age").cast("int").alias("age"), F.col("proportion").cast("double").alias("proportion"))
    )


def first_row_per_word(cdi: DataFrame, order: str) -> DataFrame:
    """The first row of every word in ``order``; later rows of the same word are ignored."""
    return (
        cdi.groupBy("word").agg(F.min_by(F.struct(*cdi.columns), order).alias("r")).select("r.*").drop(order)
    )


def monthly_means(cdi: DataFrame) -> DataFrame:
    """Mean per age, and the mean of those means in a row whose age is NULL."""
    months = cdi_to_long(cdi).groupBy("age").agg(F.avg("proportion").alias("mean_score"))
    overall = months.agg(F.avg("mean_score").alias("mean_score")).select(F.lit(None).cast("int").alias("age"), "mean_score")
    return months.unionByName(overall)


def sigmoid(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b, c, d = p
    return a / (1 + np.exp(-np.clip(b * (x - c), -700, 700))) + d


def fit_sigmoid(x, y, start, low=None, high=None, weights=None, steps: int = 1000) -> np.ndarray:
    """Damped least squares for a/(1+exp(-b(x-c)))+d, kept inside the bounds by clipping; NaN if the steps run out."""
    x, y = np.asarray(x, float)[None], np.asarray(y, float)[None]
    w = np.ones_like(x) if weights is None else np.asarray(weights, float)[None]
    low, high = (None if side is None else np.asarray(side, float)[None] for side in (low, high))
    return fit_sigmoids(x, y, np.asarray(start, float)[None], low, high, w, steps)[0]


def fit_sigmoids(x, y, start, low, high, weights, steps: int = 1000) -> np.ndarray:
    """``fit_sigmoid`` for many curves of as many points, one in a row. Curves that are done drop out.

    Products are those of single curves, and each system is solved by itself, so a curve's result does not depend on the others.
    """
    out = np.full(start.shape, np.nan)
    low = np.full(start.shape, -np.inf) if low is None else low
    high = np.full(start.shape, np.inf) if high is None else high
    with np.errstate(all="ignore"):
        w, p = np.sqrt(weights), np.clip(start, low, high)
        residual = w * (y - sigmoid(x, p.T[:, :, None]))
        cost, damping, left = _squares(residual), np.full(len(p), 1e-3), np.full(len(p), steps)
        row, open_rows = np.arange(len(p)), np.isfinite(p).all(axis=1) & np.isfinite(cost)
        while True:
            row, x, y, w, p, low, high, residual, cost, damping, left = (
                v[open_rows] for v in (row, x, y, w, p, low, high, residual, cost, damping, left)
            )
            if not len(row):
                return out
            a, b, c, _d = p.T[:, :, None]
            e = 1 / (1 + np.exp(-np.clip(b * (x - c), -700, 700)))
            slope = a * e * (1 - e)
            jacobian = w[:, :, None] * np.stack([e, slope * (x - c), -slope * b, np.ones_like(x)], axis=2)
            gradient = (np.swapaxes(jacobian, 1, 2) @ residual[:, :, None])[:, :, 0]
            # Parameters that press against a bound stay fixed in this step.
            free = ~(((p <= low) & (gradient < 0)) | ((p >= high) & (gradient > 0)))
            flat = np.where(free, np.abs(gradient), 0).max(axis=1) < 1e-10
            hessian = np.swapaxes(jacobian, 1, 2) @ jacobian
            sound = np.isfinite(hessian).all(axis=(1, 2)) & np.isfinite(gradient).all(axis=1)
            diagonal = damping[:, None] * np.maximum(np.diagonal(hessian, axis1=1, axis2=2), 1e-12)
            system, step = hessian + diagonal[:, :, None] * np.eye(4), np.zeros_like(p)
            whole = free.all(axis=1)
            for i in np.flatnonzero(sound & ~flat & (damping < 1e12)):
                if whole[i]:
                    step[i] = np.linalg.lstsq(system[i], gradient[i], rcond=None)[0]
                else:
                    f = np.flatnonzero(free[i])
                    step[i, f] = np.linalg.lstsq(system[i][np.ix_(f, f)], gradient[i, f], rcond=None)[0]
            trial = np.clip(p + step, low, high)
            trial_residual = w * (y - sigmoid(x, trial.T[:, :, None]))
            trial_cost = _squares(trial_residual)
            tried = sound & ~flat & (damping < 1e12)
            moved = tried & (trial_cost < cost)
            small = moved & (cost - trial_cost < 1e-10 * np.maximum(cost, 1e-300))
            p, residual = np.where(moved[:, None], trial, p), np.where(moved[:, None], trial_residual, residual)
            cost = np.where(moved, trial_cost, cost)
            # a step that does not lower the cost is tried again with more damping
            damping = np.where(moved, np.maximum(damping / 8, 1e-12), damping * 4)
            left = left - moved
            done = (sound & ~tried) | small
            out[row[done]] = p[done]
            open_rows = tried & ~small & (left > 0)


def _squares(rows: np.ndarray) -> np.ndarray:
    return (rows[:, None, :] @ rows[:, :, None])[:, 0, 0]


def _crossings(p: np.ndarray, level: np.ndarray) -> np.ndarray:
    a, b, c, d = p.T
    with np.errstate(all="ignore"):
        inside = np.isfinite(p).all(axis=1) & (a > 0) & (b > 0) & (level > d) & (level < a + d)
        return np.where(inside, c - np.log(a / (level - d) - 1) / b, np.nan)


# Points of the curves that are fitted at once.
CELLS = 500_000


def _each_word(points: DataFrame, word: str, order: str, name: str, fit) -> DataFrame:
    """(word, name): ``fit`` of many words at once, from their points in ``order``.

    ``fit`` takes arrays of words x points, one for each column, for words of as many points; NaN becomes NULL.
    """
    columns = [order, *[c for c in points.columns if c not in (word, order)]]
    doubles = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    lists = (
        python_partitions(points, word).groupBy(word).agg(F.array_sort(F.collect_list(doubles)).alias("points"))
        .select(F.col(word).cast("string").alias("word"), "points")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sizes = batch.column(1), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = points.flatten(), np.append(0, np.cumsum(sizes))
            values = [flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
            out = np.full(len(sizes), np.nan)
            for size in np.unique(sizes):
                alike, most = np.flatnonzero(sizes == size), max(1, CELLS // size)
                for some in (alike[i : i + most] for i in range(0, len(alike), most)):
                    place = starts[some][:, None] + np.arange(size)
                    out[some] = fit(*[v[place] for v in values])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=np.isnan(out))], ["word", name])

    return lists.mapInArrow(run, f"word string, {name} double")


def child_aoa(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Age at which the fitted curve of a word reaches the threshold; NULL outside the ages.

    ``long`` has one row per word and age.
    """
    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if x.shape[1] < 3:
            return np.full(len(x), np.nan)
        one = np.ones(len(x))
        p = fit_sigmoids(
            x, y, np.stack([one, 0.1 * one, x.mean(axis=1), 0 * one], axis=1), np.stack([0 * one, 0 * one, x[:, 0], -0.5 * one], axis=1),
            np.stack([2 * one, one, x[:, -1], 0.5 * one], axis=1), np.ones_like(x),
        )
        aoa = _crossings(p, np.full(len(x), threshold))
        return np.where((aoa >= x[:, 0]) & (aoa <= x[:, -1]), aoa, np.nan)

    return _each_word(long.select("word", "age", "proportion"), "word", "age", "child_aoa", fit)


def step_statistics(surprisal: DataFrame) -> DataFrame:
    """Per word and step: number of points, mean and minimum surprisal.

    Least squares over all points of a step equals weighted least squares over the step means, so a
    word's group shrinks to its steps however many contexts it has.
    """
    valid = surprisal.where(
        F.col("step_num").isNotNull() & F.col("surprisal").isNotNull() & ~F.isnan("surprisal")
    )
    return valid.groupBy("target_word", "step_num").agg(
        F.count(F.lit(1)).alias("n"), F.avg("surprisal").alias("mean_y"), F.min("surprisal").alias("min_y"),
        F.max("surprisal").alias("max_y"),
    )


def model_aoa(
    surprisal: DataFrame, threshold: float = 0.5, approximate_vocab: float = APPROXIMATE_VOCAB
) -> DataFrame:
    """log10 step at which a word's fitted learning curve is half way from chance to its best value.

    Needs at least four points, as the curve has four parameters; NULL if the fit does not converge or is not rising, the level is outside the curve, or
    the step lies outside the observed ones. Chance is log2 of the vocabulary size.
    """
    chance = math.log2(approximate_vocab)

    def fit(steps, n, mean_y, min_y, max_y) -> np.ndarray:
        x, y, best, worst = np.log10(steps + 1), -mean_y, min_y.min(axis=1), max_y.max(axis=1)
        start = np.stack([worst - best, np.ones(len(x)), (x * n).sum(axis=1) / n.sum(axis=1), -worst], axis=1)
        enough = n.sum(axis=1) >= 4
        p = np.full(start.shape, np.nan)
        p[enough] = fit_sigmoids(x[enough], y[enough], start[enough], None, None, n[enough])
        out = _crossings(p, -(chance - threshold * (chance - best)))
        step = 10.0 ** np.minimum(out, 300.0) - 1
        return np.where((step >= steps[:, 0]) & (step <= steps[:, -1]), out, np.nan)

    return _each_word(step_statistics(surprisal), "target_word", "step_num", "model_aoa", fit)


def with_step_number(surprisal: DataFrame) -> DataFrame:
    return surprisal.withColumn("step_num", nm.parse_step(F.col("step").cast("string")))


def curve_fitness(child: DataFrame, model: DataFrame) -> DataFrame:
    """Correlation of model and child ages over the words that have both; 0 below three words."""
    both = child.join(model, "word").where("child_aoa is not null and model_aoa is not null")
    stats = pearson(both, "model_aoa", "child_aoa")
    few = F.col("n") < 3
    return stats.select(
        F.when(few, F.lit(0.0)).otherwise(F.col("r")).alias("curve_fitness"),
        F.when(~few, F.col("p_value")).alias("p_value"), F.col("n").alias("n_words"),
    )
