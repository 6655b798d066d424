"""Hard negatives: the trees and the operator against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import gnat, queries

INF, NAN = float("inf"), float("nan")


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """(anchor, positive, rank, negative, scores) by scoring all rows of (vec_id, label, vector)."""
    rows = sorted({(i, c, tuple(v)) for i, c, v in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for a, label, v in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in rows if i != a)
        for ps, p, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * -ps <= 100 * -r[0] <= high * -ps]
            out += [(a, p, k + 1, i, float(-ps), float(-ns)) for k, (ns, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<double>")
    clashing = {"query": "q", "shard": "s", "class_id": 5, "ids": 1, "data": "d", "window": 2, "low": 3, "found": "f", "block": "b", "rank": 9}
    return df.withColumns({k: F.lit(v) for k, v in clashing.items()})


def clusters(rng, n, dimensions=6, centres=8):
    """Integer vectors about some centres, with copies under the same and under other labels."""
    middle = [[rng.gauss(0, 100) for _ in range(dimensions)] for _ in range(centres)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.2:
            _, c, v = rng.choice(rows)
            rows.append((i, c if rng.random() < 0.7 else rng.randrange(4), v))
        else:
            rows.append((i, rng.randrange(4), [float(math.floor(x + rng.gauss(0, 25))) for x in rng.choice(middle)]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_operator_equals_brute_force(spark, monkeypatch, small):
    """Also with many shards, several blocks and units each, and small leaves."""
    if small:
        for name, value in (("SHARD_ROWS", 40), ("BLOCK_ROWS", 30), ("UNIT_ASKS", 4), ("LEAF", 8), ("FANOUT", 3), ("SCORES", 64), ("HITS", 50)):
            monkeypatch.setattr(gnat, name, value)
    rows = clusters(random.Random(11), 700)
    rows += [(5000 + i, 1, [7.0, 9.0, 30.0, -60.0, 90.0, 5.0]) for i in range(200)]  # a common vector, with anchors
    rows += rows[:30]  # repeated rows
    rows += [(9000, None, rows[0][2]), (9010, 1, None), (9020, 1, []), (9030, 1, [NAN] * 6), (9040, 2, [INF] * 6), (9050, 2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, 2, rows[0][2])]
    rows += [(9100, 3, [0.0] * 6)]
    got = result(gnat.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0))
    expected = brute(rows, lambda i: i % 10 == 0)
    assert got == expected and len(got) > 500


def test_empty_table_and_lone_rows(spark):
    assert result(gnat.hard_negatives(table(spark, [(0, 1, [1.0])]).where("false"), F.col("vec_id") % 10 == 0)) == []
    assert result(gnat.hard_negatives(table(spark, [(0, 1, [1.0]), (1, 2, [1.0])]), F.col("vec_id") % 10 == 0)) == []


def test_search_prunes_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(gnat, "LEAF", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (12, 5))
    rows = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 6, (3000, 5)))
    labels = rng.integers(0, 3, 3000)
    space = gnat.Space(5, float((rows * rows).sum(axis=1).max()))
    top = (rows[:40] @ rows.T).max(axis=1)
    asked = gnat.Windows(rows[:40], np.arange(40), labels[:40], 30 * top, 90 * top)
    w, r, s = gnat.search(space, rows, labels, asked, 10, False)
    for i in range(40):
        score = rows @ rows[i]
        fits = (labels != labels[i]) & (100 * score >= 30 * top[i]) & (100 * score <= 90 * top[i])
        assert sorted(s[w == i].tolist(), reverse=True)[:10] == sorted(score[fits].tolist(), reverse=True)[:10]
    tree = gnat.grow(space, space.lifted(rows), np.arange(3000))
    near = space.radius((rows[:40] ** 2).sum(axis=1), 0.98 * (rows[:40] ** 2).sum(axis=1))
    assert tree[0].reached(space, rows[:40], np.zeros(40), near).mean() < 0.7


def test_registered_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    name = "op12_hard_negatives"
    expected = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({queries.ORACLE[name]})").fetchall()
    assert result(queries.QUERIES[name](spark, folder)) == sorted(expected)
