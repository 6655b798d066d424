"""Running totals, positions, ranks and samples do not depend on partitioning."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.operators import ngrams, splits, stats
from lexmill.operators.ordering import average_ranks, dense_positions, hash_groups, id_groups, running_total


@pytest.fixture(scope="module")
def keyed(spark):
    rng = random.Random(1)
    keys = rng.sample(range(1 << 34), 3000)
    # One group holds a third of all rows.
    rows = [(k, "hot" if i % 3 == 0 else f"g{i % 50}", rng.randint(0, 9)) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k bigint, g string, w bigint")


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_running_total(keyed, partitions):
    out = running_total(keyed.repartition(partitions), F.col("w"), [F.col("k")], id_groups(F.col("k"))).toPandas()
    out = out.sort_values("k")
    assert out["before"].tolist() == (out["w"].cumsum() - out["w"]).tolist()


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_within_hot_group(keyed, partitions):
    out = dense_positions(
        keyed.repartition(partitions), [F.col("k")], id_groups(F.col("k")), within=["g"]
    ).toPandas().sort_values("k")
    assert out["pos"].tolist() == out.groupby("g").cumcount().tolist()


def test_average_ranks_with_ties_and_infinities(spark):
    values = [3.0, 1.0, 3.0, float("inf"), -1.0, 1.0, 1.0, float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["avg_rank"] for r in average_ranks(df, "v", buckets=3).collect()}
    series = pd.Series([v for v in values if v is not None and v == v])
    assert got == dict(zip(series, series.rank()))


def test_spearman_against_pandas(spark):
    rng = random.Random(2)
    pdf = pd.DataFrame({"x": [rng.choice([1.0, 2.0, 5.0, rng.random()]) for _ in range(800)]})
    pdf["y"] = pdf["x"] * 2 + [rng.choice([0.0, 1.0]) for _ in range(800)]
    expected = pdf["x"].rank().corr(pdf["y"].rank())
    df = spark.createDataFrame(pdf)
    for partitions in (1, 16):
        row = stats.spearman(df.repartition(partitions), "x", "y").first()
        assert row["n"] == 800
        assert row["rho"] == pytest.approx(expected, abs=1e-12)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    # A third of the documents are copies of one text.
    texts = ["same copy text here" if i % 3 == 0 else " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 30))) for i in range(900)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("target", [1, 500, 10**9])
def test_budget_is_reached_and_not_exceeded_before_last(docs, target):
    first = splits.sample_by_word_budget(docs.repartition(1), target, 7).toPandas()
    again = splits.sample_by_word_budget(docs.repartition(9), target, 7).toPandas()
    assert set(first["doc_id"]) == set(again["doc_id"])
    assert (first["before"] < target).all()
    total = first["n_words"].sum()
    assert total >= target or len(first) == 900


def test_no_text_in_both_splits(docs):
    train = splits.sample_by_word_budget(docs, 2000, 1)
    pool = splits.exclude_selected(docs, train)
    val = splits.sample_by_word_budget(pool, 1000, 2)
    texts = docs.join(train, "doc_id").select("text").intersect(docs.join(val, "doc_id").select("text"))
    assert texts.count() == 0
    assert pool.count() > 0


def test_budget_check():
    splits.check_budget(10, 6, 4)
    with pytest.raises(ValueError):
        splits.check_budget(10, 6, 5)


def test_merge_keeps_file_order_and_head_split(spark):
    lines = [(f, n * 10) for f in "abc" for n in range(7)]
    df = spark.createDataFrame(lines, "file string, line_no bigint").repartition(5)
    merged = splits.head_ratio_split(splits.merge_files_in_order(df, 5), 0.34).orderBy("pos").collect()
    assert [r["pos"] for r in merged] == list(range(21))
    for f in "abc":
        assert [r["line_no"] for r in merged if r["file"] == f] == [n * 10 for n in range(7)]
    assert [r["split"] for r in merged].count("val") == 7
    plain = splits.merge_files_in_order(df, None).orderBy("pos").collect()
    assert [r["file"] for r in plain] == list("aaaaaaabbbbbbbccccccc")


def test_epoch_drops_last_batch(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    rows = splits.shuffled_epoch(df, 8, 1, "doc_id").collect()
    assert len(rows) == 48 and {r["batch_id"] for r in rows} == set(range(6))


def test_hash_groups_cover_digest(spark):
    df = spark.range(300).withColumn("d", F.md5(F.col("id").cast("string")))
    rows = dense_positions(df, [F.col("d")], hash_groups(F.col("d"), (1, 2))).orderBy("d").collect()
    assert [r["pos"] for r in rows] == list(range(300))


def test_contexts_by_hand(spark):
    docs = spark.createDataFrame([(1, "the cat sat. the cat ran! Hi"), (2, "the cat sat."), (3, None)], "doc_id bigint, text string")
    sents = ngrams.sentences(docs)
    windows = ngrams.prefix_windows(sents, 2)
    pairs = {(r["context"], r["next"]): r["count"] for r in ngrams.next_word_stats(windows).collect()}
    assert pairs == {("the", "cat"): 3, ("the cat", "sat."): 2, ("the cat", "ran!"): 1}
    full = {r["next"]: r["count"] for r in ngrams.next_word_stats(ngrams.full_prefix_windows(sents)).collect()}
    assert full == {"cat": 3, "sat.": 2, "ran!": 1}
    words = spark.createDataFrame([("cat",), ("absent",), ("a",)], "word string")
    lists = ngrams.contexts_per_word(ngrams.top_contexts(windows, words, 3), words)
    assert {r["word"]: len(r["contexts"]) for r in lists.collect()} == {"cat": 1, "absent": 0, "a": 0}
    assert ngrams.words_with_enough_contexts(lists, 1).count() == 1
    with pytest.raises(ValueError):
        ngrams.sentences(docs.select("doc_id"))


def test_context_text_of_digest(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    sents = ngrams.sentences(docs)
    windows = ngrams.full_prefix_windows(sents).where("next = 'three'")
    assert ngrams.context_text(windows, sents).first()["context_text"] == "one two"


def test_split_refuses_more_words_than_there_are(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y") for i in range(50)] + [(100, "w1 x y")], "doc_id bigint, text string")
    train, val = splits.train_val_split(docs, 60, 30, seed=4)
    chosen = [{r["doc_id"] for r in d.collect()} for d in (train, val)]
    assert not chosen[0] & chosen[1] and len(chosen[0]) == 20 and len(chosen[1]) == 10
    with pytest.raises(ValueError):
        splits.train_val_split(docs, 120, 60, seed=4)
