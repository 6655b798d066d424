"""Vocabulary learning and encoding against a public tokenizer library; packing by invariants."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexmill.operators import tokens as tk

try:
    import tokenizers
except ImportError:
    tokenizers = None
needs_library = pytest.mark.skipif(tokenizers is None, reason="compares with the public tokenizer library")

TEXTS = [
    "the cat sat on the mat and the rat sat on the cat", "low lower lowest newer newest wide wider",
    "naïve café 123 12 1 it's we're  double  space\n\nnext line \n", "aaaa aaa aa a abababab",
    "Ünïcödé 😀 text — with dashes…", "the theme then there these", "banana bandana ananas",
]


def trained(spark, texts, vocab_size, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return docs, tk.train_bpe(tk.pretoken_counts(docs), vocab_size=vocab_size, **options)


def library(texts, vocab_size):
    from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers, trainers

    t = Tokenizer(models.BPE())
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.decoder = decoders.ByteLevel()
    t.normalizer = normalizers.NFKC()
    t.train_from_iterator(texts, trainers.BpeTrainer(
        vocab_size=vocab_size, min_frequency=2, special_tokens=list(tk.SPECIALS), show_progress=False))
    return t


@needs_library
def test_same_vocabulary_and_ids_as_library(spark):
    docs, vocabulary = trained(spark, TEXTS, 120)
    other = library(TEXTS, 120)
    assert vocabulary.size == other.get_vocab_size()
    rows = tk.encode_docs(docs, vocabulary).orderBy("doc_id").collect()
    assert [r["tokens"] for r in rows] == [other.encode(t).ids for t in TEXTS]


def test_batched_merges_equal_single_merges(spark):
    _, batched = trained(spark, TEXTS, 110)
    _, single = trained(spark, TEXTS, 110, candidates=1)
    assert batched.merges == single.merges


def test_roundtrip(spark):
    docs, vocabulary = trained(spark, TEXTS, 90)
    row = tk.roundtrip_check(tk.encode_docs(docs, vocabulary), vocabulary).first()
    assert row["n_docs"] == row["n_equal"] == len(TEXTS)


@needs_library
def test_pretokens_match_library(spark):
    from tokenizers.pre_tokenizers import ByteLevel

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = docs.select(tk.pretokens(F.col("t")).alias("p")).orderBy("i").collect()
    split = ByteLevel(add_prefix_space=True)
    for row, text in zip(rows, TEXTS):
        prefixed = text if text[:1].isspace() else " " + text
        assert "".join(row["p"]) == prefixed
        assert len(row["p"]) == len(split.pre_tokenize_str(text))


@pytest.mark.parametrize("length,offset", [(4, 0), (4, 3), (7, 1), (100, 0)])
def test_pack_sequences(spark, length, offset):
    lists = [[], list(range(5)), [], list(range(5, 6)), list(range(6, 40)), list(range(40, 50))]
    docs = spark.createDataFrame([(i * 5000, t) for i, t in enumerate(lists)], "doc_id bigint, tokens array<int>")
    stream = list(range(50))[offset:]
    expected = [stream[i * length : (i + 1) * length] for i in range(len(stream) // length)]
    rows = tk.pack_sequences(docs.repartition(3), length, offset).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(len(expected)))
    assert [r["tokens"] for r in rows] == expected


def test_random_offset_chunks(spark):
    docs = spark.createDataFrame([(i, list(range(i * 10, i * 10 + 10))) for i in range(7)], "doc_id bigint, tokens array<int>")
    rows = tk.random_offset_chunks(docs, 8, seed=3).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(70 // 8 - 1))
    for r in rows:
        start = r["tokens"][0]
        assert r["chunk_id"] * 8 <= start < r["chunk_id"] * 8 + 8
        assert r["tokens"] == list(range(start, start + 8))


def test_mask_positions_without_start_token(spark):
    df = spark.createDataFrame([([5, 6, 7], [1, 0, 1])], "tokens array<int>, phrase_mask array<int>")
    rows = tk.mask_each_position(df, "mntp", 9, has_bos=False).collect()
    assert [(r["position"], r["predict_at"], r["target"], r["masked"]) for r in rows] == [(2, 1, 7, [5, 6, 9])]
    with pytest.raises(ValueError):
        tk.mask_each_position(df, "other", 9)


def test_short_sequences(spark):
    df = spark.createDataFrame([([],), ([1],), ([1, 2],)], "tokens array<int>")
    rows = [(r["inputs"], r["targets"]) for r in tk.next_token_pairs(df).collect()]
    assert rows == [([], []), ([], []), ([1], [2])]


def _merged_by_scans(ids, merges, base):
    for rank, pair in enumerate(merges):
        out, i = [], 0
        while i < len(ids):
            hit = tuple(ids[i : i + 2]) == pair
            out.append(base + rank if hit else ids[i])
            i += 2 if hit else 1
        ids = out
    return ids


def test_heap_of_merges_equals_scans():
    rng = random.Random(5)
    for trial in range(300):
        base, merges = 4, []
        while len(merges) < 12:
            pair = (rng.randrange(base + len(merges)), rng.randrange(base + len(merges)))
            if pair not in merges:
                merges.append(pair)
        ids = [rng.randrange(base) for _ in range(trial % 60)]
        assert tk.merged_ids(list(ids), {p: i for i, p in enumerate(merges)}, base) == _merged_by_scans(ids, merges, base)


@needs_library
def test_very_long_pretoken(spark):
    """A word of 1,000,000 letters: same ids as the library, in seconds."""
    _, vocabulary = trained(spark, TEXTS, 120)
    rng = random.Random(6)
    long = "".join(rng.choice("abnesth") for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    start = time.time()
    got = tk.encode_docs(docs, vocabulary).first()["tokens"]
    assert time.time() - start < 60
    assert got == library(TEXTS, 120).encode(long).ids
