"""Rank correlation over all pairs against matrices."""

import numpy as np
import pandas as pd
import pytest

from lexmill.operators import pair_ranks

SCHEMA = "vec_id int, embedding array<double>"


def table(spark, m):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], SCHEMA)


def lower(m, digits=None):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (u @ u.T)[np.tril_indices(len(m), k=-1)]
    return s if digits is None else np.round(s, digits)


def spearman(x, y):
    return np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]


@pytest.mark.parametrize("block_rows", [7, 8192])
@pytest.mark.parametrize("digits", [1, 2, 6])
def test_equals_matrices(spark, digits, block_rows):
    rng = np.random.default_rng(digits)
    a = rng.normal(size=(90, 6)) + 2 * rng.normal(size=(3, 6))[np.arange(90) % 3]
    b = a[:, :4] + rng.normal(size=(90, 4))
    row = pair_ranks.rsa_spearman_vectors(table(spark, a).repartition(5), table(spark, b), digits=digits, block_rows=block_rows).first()
    assert row["n_pairs"] == 90 * 89 // 2
    assert row["rho"] == pytest.approx(spearman(lower(a, digits), lower(b, digits)), abs=1e-12)
    assert abs(row["rho"] - spearman(lower(a), lower(b))) <= row["error"]
    assert row["error"] < {1: 1.0, 2: 0.1, 6: 1e-4}[digits]


def test_repeated_vectors_tie(spark):
    a = np.repeat(np.random.default_rng(1).normal(size=(5, 4)), 8, axis=0)
    b = np.random.default_rng(2).normal(size=(40, 3))
    row = pair_ranks.rsa_spearman_vectors(table(spark, a), table(spark, b), block_rows=9).first()
    assert row["rho"] == pytest.approx(spearman(lower(a, 6), lower(b, 6)), abs=1e-12)


def test_unusable_vectors_and_small_tables(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [0.0, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    spoiled = table(spark, a).union(spark.createDataFrame(bad, SCHEMA))
    whole = table(spark, b).union(spark.createDataFrame([(i, [1.0, 2.0, float(i or 0)]) for i, _ in bad], SCHEMA))
    row = pair_ranks.rsa_spearman_vectors(spoiled, whole).first()
    assert row["n_pairs"] == 190
    assert row["rho"] == pytest.approx(spearman(lower(a, 6), lower(b, 6)), abs=1e-12)
    for n in (0, 1):
        assert pair_ranks.rsa_spearman_vectors(table(spark, a[:n]), table(spark, b[:n])).first()["n_pairs"] == 0
    same = pair_ranks.rsa_spearman_vectors(table(spark, np.ones((4, 2))), table(spark, b[:4])).first()
    assert same["n_pairs"] == 6 and np.isnan(same["rho"])
    with pytest.raises(ValueError):
        pair_ranks.rsa_spearman_vectors(table(spark, a), table(spark, b), digits=9)
