"""Vocabularies of the production size, and rounds with few pairs or few segments."""

from collections import Counter

import pytest

from lexmill.operators import tokens as tk
from lexmill.plans import token_queries

SF = "/root/testdata/sf0.001"


def one_at_a_time(words, first, room):
    """Merges by counting all pairs anew each time."""
    words, merges = [(list(w), n) for w, n in words], []
    while len(merges) < room:
        counts = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                counts[p] += n
        best = min(((-n, *p) for p, n in counts.items() if n >= 2), default=None)
        if best is None:
            break
        merges.append(best[1:])
        words = [(tk.replaced(w, *best[1:], first + len(merges) - 1), n) for w, n in words]
    return merges


@pytest.mark.parametrize("options", [{}, {"candidates": 40}, {"most_segments": 60}])
def test_rounds_equal_one_merge_at_a_time(spark, options):
    counts = tk.pretoken_counts(spark.read.parquet(f"{SF}/documents.parquet").limit(40)).limit(400).localCheckpoint()
    rows = [(r[0], r[1]) for r in counts.collect()] + [(" aaaaaaa", 5), ("aaa", 3), ("abababab", 4)]
    table = spark.createDataFrame(rows, "pretoken string, count bigint")
    got = tk.train_bpe(table, vocab_size=260, **options)
    of = got.byte_ids()
    expected = one_at_a_time([([of[b] for b in w.encode()], n) for w, n in rows], len(got.specials) + len(got.alphabet), 260 - len(got.specials) - len(got.alphabet))
    assert got.merges == expected and len(expected) > 60


def test_registered_queries_train_the_production_size(spark):
    assert token_queries.VOCAB == tk.VOCAB_SIZE
    vocabulary = token_queries._vocabulary(spark, SF)
    # all of what the small table gives: no pair is left that occurs twice
    assert len(vocabulary.merges) > 500
    row = token_queries.bpe_roundtrip(spark, SF).first()
    assert row["n_docs"] == row["n_equal"] == 200
