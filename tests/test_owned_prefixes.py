"""Counts of full contexts, for which sentences are shuffled and windows are not."""

import hashlib
import random
import re
from collections import Counter

from __spark_entry__ import queries
from lexmill.operators import ngrams


def expected(sents) -> Counter:
    return Counter((hashlib.md5(" ".join(w[:i]).encode()).hexdigest(), w[i]) for w in sents for i in range(1, len(w)))


def counted(df) -> Counter:
    rows = [(r["context"], r["next"], r["count"]) for r in df.collect()]
    assert len(rows) == len({r[:2] for r in rows})  # each window once
    return Counter({(c, n): k for c, n, k in rows})


def test_full_contexts_shuffle_no_window(spark, tmp_path):
    rows = [(1, "a b c d e f. a b c d e g! a b. a"), (2, "a b c d e f. 好。b c。 x"), (3, None), (4, ""), (None, "a b c d e f.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["full_context_stats"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in re.findall(r"Exchange hashpartitioning\(.*", plan) if "context" in x or "next" in x]
    sents = [s.split() for s in ("a b c d e f.", "a b c d e g!", "a b.", "a", "a b c d e f.", "b c。", "x", "a b c d e f.")]
    assert counted(found) == expected(sents)


def test_prefixes_are_counted_once_whatever_their_words(spark):
    # marks below the blank, words that begin other words, many sentences that begin alike, one of many words, repeated ones
    draw = random.Random(5)
    words = ["a", "a\x01", "ab", "a!", "\x00", "é", "好", "z"]
    sents = [[draw.choice(words) for _ in range(draw.choice((0, 1, 2, 3, 4, 5, 9)))] for _ in range(1500)]
    sents += [["the", "same", "start", "of", "all", str(i % 70), "end"] for i in range(400)] + [["w"] * 5000] + [["w"] * 4990 + ["x"]] * 2
    given = spark.createDataFrame([(s,) for s in sents], "tokens array<string>").repartition(5)
    found = ngrams.pair_counts(ngrams.full_prefix_windows(ngrams.owned_prefixes(given)))
    assert counted(found) == expected(sents)


def test_one_task_holds_all_starts(spark):
    sents = [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["a", "b", "d", "c"], ["a", "b", "c", "d"], ["b"], []]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        owned = ngrams.owned_prefixes(spark.createDataFrame([(s,) for s in sents], "tokens array<string>"))
        assert counted(ngrams.pair_counts(ngrams.full_prefix_windows(owned))) == expected(sents)
        assert ngrams.owned_prefixes(spark.createDataFrame([([],), (["x"],)], "tokens array<string>")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
