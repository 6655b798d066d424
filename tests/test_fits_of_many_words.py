"""Fits of many words at once give what fits of one word give."""

import numpy as np

from lexmill.operators import acquisition as ac


def test_many_fits_equal_single_fits():
    rng = np.random.default_rng(1)
    x = np.tile(np.arange(16.0, 31.0), (60, 1))
    y = np.vstack([0.3 + 0.4 * rng.random((30, 15)), ac.sigmoid(x[:30], (0.9, 0.6, 22.0, 0.05)) + 0.05 * rng.random((30, 15))])
    weights = 1.0 + rng.integers(0, 5, size=x.shape)
    start, low, high = np.tile([1.0, 0.1, 23.0, 0.0], (60, 1)), np.tile([0, 0, 16, -0.5], (60, 1)), np.tile([2.0, 1.0, 30.0, 0.5], (60, 1))
    together = ac.fit_sigmoids(x, y, start, low, high, weights)
    alone = [ac.fit_sigmoid(*c) for c in zip(x, y, start, low, high, weights)]
    assert np.array_equal(together, alone, equal_nan=True) and np.isfinite(together).all()
    # one step is not enough
    assert np.isnan(ac.fit_sigmoids(x[30:], y[30:], start[30:], low[30:], high[30:], weights[30:], steps=1)).all()


def test_words_of_different_sizes_share_a_batch(spark, monkeypatch):
    rows = [(w, a, float(ac.sigmoid(np.array(a), (1.0, 0.8, c, 0.0)))) for w, c, n in (("a", 20.0, 15), ("b", 24.0, 12), (None, 21.0, 15)) for a in range(16, 16 + n)]
    rows += [("few", 16, 0.1), ("few", 17, 0.9), ("flat", 16, 0.2), ("flat", 18, 0.2), ("flat", 20, 0.2)]
    long = spark.createDataFrame(rows, "word string, age int, proportion double").repartition(3)
    for cells in (ac.CELLS, 1):
        monkeypatch.setattr(ac, "CELLS", cells)
        plan = ac.child_aoa(long)
        got = {r["word"]: r["child_aoa"] and round(r["child_aoa"], 3) for r in plan.collect()}
        assert got == {"a": 20.0, "b": 24.0, None: 21.0, "few": None, "flat": None}
    # no Python call for each word
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()


def test_model_ages_of_one_batch(spark):
    rows = [(w, 10.0**s, 16 - float(ac.sigmoid(np.array(s), (10.0, 4.0, c, 0.0)))) for w, c in (("a", 3.0), ("b", 4.0)) for s in range(1, 8) for _ in range(2)]
    rows += [("few", 10.0, 5.0), ("few", 100.0, 4.0)]
    surprisal = spark.createDataFrame(rows, "target_word string, step_num double, surprisal double")
    got = {r["word"]: r["model_aoa"] for r in ac.model_aoa(surprisal).collect()}
    assert got["few"] is None and 2.5 < got["a"] < 3.5 < got["b"] < 4.5
