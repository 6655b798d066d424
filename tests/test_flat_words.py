"""Merges and cuts of many words at once against one word at a time; frequencies from distinct pre-tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import flat_words as fw
from lexmill.operators import tokens as tk
from lexmill.plans import token_queries


def words_and_merges(rng, base=4):
    merges = []
    while len(merges) < 12:
        pair = (rng.randrange(base + len(merges)), rng.randrange(base + len(merges)))
        if pair not in merges:
            merges.append(pair)
    words = [[rng.randrange(base) for _ in range(rng.randrange(40))] for _ in range(30)]
    return words, merges


def flat(words):
    return np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words], np.int64)


@pytest.mark.parametrize("long", [20, 1000])
def test_merges_of_many_words(monkeypatch, long):
    monkeypatch.setattr(fw, "LONG", long)
    rng = random.Random(long)
    for _ in range(200):
        words, merges = words_and_merges(rng)
        ids, sizes = fw.merged(*flat(words), fw.PairTable(merges), 4)
        expected = [fw.merged_ids(list(w), {p: i for i, p in enumerate(merges)}, 4) for w in words]
        assert ids.tolist() == [x for w in expected for x in w] and sizes.tolist() == [len(w) for w in expected]


def test_cuts_and_counts_of_many_words():
    rng = random.Random(2)
    for _ in range(100):
        words, merges = words_and_merges(rng)
        inside = {p for p in merges if max(p) < 4}
        expected, counts = [], {}
        for i, w in enumerate(words):
            run = w[:1]
            for pair in zip(w, w[1:]):
                counts[pair] = counts.get(pair, 0) + i
                if pair not in inside:
                    expected, run = [*expected, (run, i)], []
                run = [*run, pair[1]]
            expected.append((run, i))
        ids, sizes, word = fw.cut_apart(*flat(words), fw.PairTable(inside))
        ends = np.cumsum(sizes)
        assert [(ids[e - s : e].tolist(), i) for s, e, i in zip(sizes, ends, word)] == [(r, i) for r, i in expected if len(r) > 1]
        a, b, n = fw.pair_counts(*flat(words), np.arange(len(words)))
        assert {(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist())} == counts


def test_encoder_in_small_slices_and_nulls(spark):
    docs = spark.createDataFrame([(1, "the cat the cat"), (2, None), (3, ""), (4, "caté the")], "doc_id int, text string").coalesce(1)
    vocabulary = tk.train_bpe(tk.pretoken_counts(docs.limit(1)), vocab_size=30)
    pieces = docs.select("doc_id", tk.pretokens(F.col("text")).alias("p"))
    many = pieces.select("doc_id", tk.encoder(vocabulary)("p").alias("t")).orderBy("doc_id").collect()
    assert pieces.select("doc_id", tk.encoder(vocabulary, most_pieces=1)("p").alias("t")).orderBy("doc_id").collect() == many
    assert many[1]["t"] is None and [len(r["t"]) > 0 for r in many if r["t"] is not None] == [True, True, True]


def test_frequencies_encode_every_pretoken_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["low lower lowest low", None, "naïve 😀 low  low", ""] * 3)], "doc_id int, text string")
    counts = tk.pretoken_counts(docs)
    vocabulary = tk.train_bpe(counts, vocab_size=60)
    expected = tk.token_frequencies(tk.encode_docs(docs, vocabulary)).collect()
    assert {tuple(r) for r in tk.pretoken_frequencies(counts, vocabulary).collect()} == {tuple(r) for r in expected}
    # the query has no use for tokens of documents
    monkeypatch.setattr(tk, "encode_docs", None)
    rows = token_queries.bpe_vocabulary(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["freq"] for r in rows) > 0


def test_a_part_of_the_words_shows_too_many_segments(spark, monkeypatch):
    """Rounds over all words are few: counts of segments that exceed the limit come from a bounded part."""
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdefgh") for _ in range(9)), rng.randrange(1, 5)) for _ in range(400)]
    table = spark.createDataFrame(rows, "pretoken string, count bigint")
    whole = tk.train_bpe(table, vocab_size=60)
    calls, segments = [], tk._segments

    def counted(words, inside, most):
        calls.append(words.count())
        return segments(words, inside, most)

    monkeypatch.setattr(tk, "_segments", counted)
    assert tk.train_bpe(table, vocab_size=60, most_segments=20).merges == whole.merges
    assert min(calls) < 200 < max(calls)
