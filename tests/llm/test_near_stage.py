"""The near-duplicate stage of the pipeline against brute force at its own threshold."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lexmill.llm import minhash
from test_near_duplicates import brute, edited, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shared(a, b):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "unused").collect()]


def test_pairs_between_080_and_085_are_linked(spark):
    rng = random.Random(8)
    rows, between = [], 0
    for i in range(120):
        base = words(rng, 240)
        a, b = " ".join(base), edited(rng, base, rng.randrange(3, 7))
        rows += [(2 * i, a), (2 * i + 1, b)]
        between += 0.80 <= shared(a, b) < 0.85
    assert between >= 20
    rng.shuffle(rows)
    expected = {d for d, _, _, kept in brute(rows, 80) if kept}
    assert expected != {d for d, _, _, kept in brute(rows, 85) if kept}
    assert Counter(d for d, _ in stage(spark, rows)) == Counter(expected)


@pytest.mark.parametrize("percent", [75, 80, 85, 90])
def test_few_pairs_at_the_threshold_lie_beyond_the_keys(percent):
    assert minhash.layout(percent).miss(percent) <= minhash.MISS
    assert minhash.layout(percent).symbols <= len(minhash._FACTOR) == len(minhash._FLIP)


def test_rows_that_share_their_id_are_decided_each(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(7, a), (7, b), (7, b), (3, c), (7, c), (9, d), (9, d + " more"), (None, e), (None, c), (5, e), (1, "%"), (2, None), (2, None)]
    got = Counter(stage(spark, rows))
    assert {k: n for k, n in got.items() if k[0] != 9} == {(7, a): 1, (7, b): 1, (3, c): 1, (5, e): 1, (1, "%"): 1, (2, None): 1}
    assert sum(n for k, n in got.items() if k[0] == 9) == 1  # near copies with one id are one group
