"""Regressions, p-values, curve fits and trial statistics against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.operators import acquisition, distill, metrics, scoring, stats, trials


def test_student_p_known_values():
    # Two-sided p-values from published tables.
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.960, 1e7, 0.05), (0.0, 5, 1.0)):
        assert stats.student_p(t, df) == pytest.approx(p, abs=2e-4)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"])
    pdf["y"] = 1.5 + 2 * pdf["a"] - pdf["b"] + 0.5 * pdf["a"] * pdf["b"] + 1e6 + rng.normal(size=400)
    pdf.loc[::37, "b"] = np.nan
    fit = stats.fit_ols(spark.createDataFrame(pdf), "y", stats.main_and_pairwise(("a", "b"), "c"))
    kept = pdf.dropna()
    x = np.column_stack([np.ones(len(kept)), kept["a"], kept["b"], kept["a"] * kept["b"], kept["c"]])
    beta, rss, *_ = np.linalg.lstsq(x, kept["y"], rcond=None)
    tss = ((kept["y"] - kept["y"].mean()) ** 2).sum()
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(kept) - 5))
    assert fit["n"] == len(kept)
    assert fit["r2"] == pytest.approx(1 - rss[0] / tss, rel=1e-9)
    assert list(fit["coef"]) == ["a", "b", "a:b", "c"]
    assert list(fit["coef"].values()) == pytest.approx(beta[1:], rel=1e-6)
    assert list(fit["t"].values()) == pytest.approx((beta / errors)[1:], rel=1e-6)
    n = len(kept)
    assert fit["aic"] == pytest.approx(n * math.log(2 * math.pi * rss[0] / n) + n + 10, rel=1e-9)


def test_gain_rows_may_differ(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(100, 3)), columns=["x", "pred", "y"])
    pdf.loc[:29, "pred"] = np.nan
    df = spark.createDataFrame(pdf)
    assert stats.r2_gain(df, "y", ("x",), "pred")["base"]["n"] == 100
    assert stats.r2_gain(df, "y", ("x",), "pred", common_rows=True)["base"]["n"] == 70


def test_rsa_without_pairs_equals_matrices(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(40, 3))
    def table(m):
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "vec_id int, embedding array<double>")
    def lower(m):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        return (u @ u.T)[np.tril_indices(len(m), k=-1)]
    row = stats.rsa_pearson_vectors(table(a).repartition(5), table(b)).first()
    assert row["n_pairs"] == 780
    assert row["r"] == pytest.approx(np.corrcoef(lower(a), lower(b))[0, 1], abs=1e-10)
    with pytest.raises(ValueError):
        stats.rsa(table(a), "i", "j", "kendall")


def test_sigmoid_fit_recovers_parameters():
    x = np.arange(16, 31, dtype=float)
    true = np.array([1.0, 0.6, 22.0, 0.0])
    p = acquisition.fit_sigmoid(x, acquisition.sigmoid(x, true), [1.0, 0.1, x.mean(), 0.0], [0, 0, 16, -0.5], [2, 1, 30, 0.5])
    assert p == pytest.approx(true, abs=1e-4)


def test_aoa_rules(spark):
    x = np.arange(16, 31, dtype=float)
    rising = acquisition.sigmoid(x, np.array([1.0, 0.6, 22.0, 0.0]))
    rows = [("known", *rising.tolist()), ("flat", *[0.1] * 15), ("few", 0.2, 0.9, *[None] * 13)]
    cdi = spark.createDataFrame(rows, "word string, " + ", ".join(f"`{a}` double" for a in range(16, 31)))
    child = {r["word"]: r["child_aoa"] for r in acquisition.child_aoa(acquisition.cdi_to_long(cdi)).collect()}
    assert child["known"] == pytest.approx(22.0, abs=1e-3)
    assert child["flat"] is None and child["few"] is None
    with pytest.raises(ValueError):
        acquisition.cdi_to_long(cdi.select("word"))


def test_model_aoa_on_clean_curve(spark):
    steps = [m * 1_000_000 for m in (1, 2, 3, 5, 8, 10, 20, 30, 50, 80, 100)]
    logs = np.log10(np.array(steps) + 1.0)
    values = -acquisition.sigmoid(logs, np.array([12.0, 5.0, 7.0, -18.0]))
    data = [(f"chck_{s // 1_000_000}M", "w", float(v) + d) for s, v in zip(steps, values) for d in (0.0, 0.0, 0.0)]
    frame = spark.createDataFrame(data, "step string, target_word string, surprisal double")
    got = acquisition.model_aoa(acquisition.with_step_number(frame)).first()["model_aoa"]
    level = -(math.log2(300_000) - 0.5 * (math.log2(300_000) - values.min()))
    assert got == pytest.approx(7.0 - math.log(12.0 / (level + 18.0) - 1) / 5.0, abs=1e-3)


def test_curve_fitness_needs_three_words(spark):
    child = spark.createDataFrame([("a", 20.0), ("b", 21.0), ("c", None)], "word string, child_aoa double")
    model = spark.createDataFrame([("a", 6.0), ("b", 7.0), ("c", 7.0)], "word string, model_aoa double")
    row = acquisition.curve_fitness(child, model).first()
    assert (row["curve_fitness"], row["n_words"]) == (0.0, 2)


def test_best_beta_finds_planted_value(spark):
    rng = np.random.default_rng(8)
    logits = rng.normal(size=(60, 4))
    shifted = logits - logits.max(axis=1, keepdims=True)
    human = np.exp(3.7 * shifted)
    human /= human.sum(axis=1, keepdims=True)
    def frame(m, extra=None):
        return spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(m)], "trial int, g int, values array<double>")
    beta, kl = trials.best_beta(frame(human), frame(logits))
    assert beta == pytest.approx(3.7, rel=1e-3) and kl < 1e-6
    groups = trials.best_beta_by_group(frame(human), frame(logits), "g").collect()
    assert [r["beta"] for r in groups] == pytest.approx([3.7, 3.7], rel=1e-3)
    assert [r["error"] for r in groups] == [1e-9, 1e-9]


def _mean_kl(p, x, beta):
    z = beta * (x - x.max(axis=1, keepdims=True))
    q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    a, q = np.clip(p, 1e-10, 1), np.clip(q, 1e-10, 1)
    return (a * np.log(a / q)).sum(axis=1).mean()


@pytest.mark.parametrize("scale", [0.05, 1.0, 30.0])
def test_certified_beta_against_a_fine_grid(spark, scale):
    """Also where most probabilities are clipped (large logits), so that the mean is not convex."""
    rng = np.random.default_rng(int(scale * 100))
    logits = rng.normal(size=(40, 4)) * scale
    human = rng.dirichlet([0.3] * 4, size=40)
    human[::5] = np.eye(4)[rng.integers(0, 4, 8)]
    def frame(m):
        return spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(m)], "trial int, g int, values array<double>")
    tolerance = 1e-5
    rows = trials.certified_beta(frame(human), frame(logits), ("g",), tolerance).collect()
    assert len(rows) == 3
    grid = np.concatenate([np.linspace(0.025, 40, 20_000), np.geomspace(0.025, 40, 5_000)])
    for r in rows:
        p, x = human[r["g"] :: 3], logits[r["g"] :: 3]
        assert r["mean_kl"] == pytest.approx(_mean_kl(p, x, r["beta"]), abs=1e-9)
        assert r["error"] == tolerance
        assert r["mean_kl"] - r["error"] <= min(_mean_kl(p, x, b) for b in grid)
    few = trials.certified_beta(frame(human), frame(logits), ("g",), 1e-12, levels=2).collect()
    exact = {r["g"]: r["mean_kl"] for r in rows}
    assert all(r["mean_kl"] - r["error"] <= exact[r["g"]] for r in few)


def test_certified_beta_defined_cases(spark):
    schema = "trial int, g int, values array<double>"
    nan = float("nan")
    human = spark.createDataFrame([(1, 0, [0.7, 0.3]), (2, 1, [0.5, None]), (3, 2, [0.5, 0.5])], schema)
    logits = spark.createDataFrame([(1, 0, [1.0, 1.0]), (2, 0, [2.0, nan]), (3, 0, [5.0, 5.0])], schema)
    rows = {r["g"]: r for r in trials.certified_beta(human, logits, ("g",)).collect()}
    assert set(rows) == {0, 2}  # a group with NaN gives no row
    assert rows[0]["beta"] == rows[2]["beta"] == 0.025  # equal everywhere: the lowest
    assert rows[2]["mean_kl"] == pytest.approx(0.0, abs=1e-12)
    assert trials.certified_beta(human.limit(0), logits, ("g",)).count() == 0
    assert math.isnan(trials.best_beta(human.limit(0), logits)[0])


def test_nan_never_wins(spark):
    acc = spark.createDataFrame([("t", 1.0, 50.0), ("t", 0.5, 50.0), ("t", 2.0, float("nan"))], "task string, temperature double, accuracy double")
    assert metrics.best_temperature(acc).first()["temperature"] == 0.5
    history = spark.createDataFrame([(0, float("nan")), (1, 0.7), (2, 0.9), (3, 0.9)], "epoch int, m double")
    assert metrics.best_checkpoint(history, "m", ()).first()["epoch"] == 2
    assert metrics.best_checkpoint(history, "m", (), higher_is_better=False).first()["epoch"] == 1
    scores = spark.createDataFrame([(1, 0, float("nan")), (1, 1, -5.0), (1, 2, -5.0)], "idx int, cand int, logprob double")
    assert scoring.rank_candidates(scores, ["idx"]).first()["chosen"] == 1


def test_f1_needs_two_classes(spark):
    df = spark.createDataFrame([(0, 0), (2, 1)], "y int, p int")
    with pytest.raises(Exception, match="binary F1"):
        metrics.classification_metrics(df, "y", "p").collect()


def test_temperature_grid():
    assert scoring.temperatures(1.0) == [1.0]
    assert scoring.temperatures(0.5, 1.5, 0.25) == [0.5, 0.75, 1.0, 1.25, 1.5]
    # The number of values is ceil((high + step - low) / step): rounding can add one above ``high``.
    assert scoring.temperatures(0.0, 0.2, 0.1) == [1e-6, 0.1, 0.2, 0.3]


def test_softmax_functions(spark):
    x = [1000.0, 1001.0, -1000.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    row = df.select(nm.log_softmax(F.col("x"), 2.0).alias("l"), nm.softmax(F.col("x"), 0.5).alias("s"),
                    nm.target_logprob(F.col("x"), F.lit(0), 2.0).alias("t")).first()
    e = np.exp(np.array(x) / 2 - 500.5)
    assert row["s"] == pytest.approx(e / e.sum())
    assert row["l"][:2] == pytest.approx(np.log(e / e.sum())[:2])
    assert row["t"] == pytest.approx(row["l"][0])


def test_distillation_loss_against_numpy(spark):
    rng = np.random.default_rng(9)
    s, t = rng.normal(size=(2, 6, 5))
    label = [0, 1, -100, 3, 4, 2]
    def soft(m, k):
        e = np.exp(m / k - (m / k).max(axis=1, keepdims=True))
        return np.log(e / e.sum(axis=1, keepdims=True))
    rows = [(0, i // 3, i % 3, label[i], s[i].tolist()) for i in range(6)]
    student = spark.createDataFrame(rows, "batch int, seq int, pos int, label int, logits array<double>")
    two = [(k, i // 3, i % 3, (t[i] + d).tolist()) for i in range(6) for k, d in ((0, -1.0), (1, 1.0))]
    teachers = spark.createDataFrame(two, "teacher int, seq int, pos int, logits array<double>")
    got = distill.distillation_loss(student, distill.ensemble_mean_logits(teachers)).first()
    ls, lt = soft(s, 2.0), soft(t, 2.0)
    kl = (np.exp(lt) * (lt - ls)).sum() / 2 * 4
    ce = -np.mean([soft(s, 1.0)[i, label[i]] for i in range(6) if label[i] != -100])
    assert got["kl"] == pytest.approx(kl) and got["ce"] == pytest.approx(ce)
    assert got["loss"] == pytest.approx(0.5 * ce + 0.5 * kl)
