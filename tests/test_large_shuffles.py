"""Plans that move no more than they must: what is shuffled, and the same results as plain code."""

import math

from __spark_entry__ import queries
from lexmill.operators import ngrams, stats


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows(spark):
    docs = spark.createDataFrame([(1, "a b c. a b d! x"), (2, "a b c a b c. “q r.” s t"), (3, None), (4, "好。好 b。c d")], "doc_id long, text string")
    return ngrams.prefix_windows(ngrams.sentences(docs), 2)


def test_windows_are_not_built_in_a_lambda(spark):
    found = windows(spark)
    assert "lambdafunction" not in plan(found)
    rows = {(r["doc_id"], r["sent_no"], r["i"]): (r["next"], r["context"], r["context_size"]) for r in found.collect()}
    assert rows[2, 0, 3] == ("a", "b c", 2)
    assert rows[2, 1, 1] == ("r.”", "“q", 1)
    assert (1, 2, 1) not in rows


def test_sentences_are_cut_where_they_were(spark):
    docs = spark.createDataFrame([(1, "好。好 b。”c d.  e (f!) g ? h")], "doc_id long, text string")
    assert [r["tokens"] for r in ngrams.sentences(docs).orderBy("sent_no").collect()] == [["好。"], ["好", "b。”"], ["c", "d."], ["e", "(f!)"], ["g", "?"], ["h"]]


def test_pair_counts_shuffle_once(spark):
    counts = ngrams.pair_counts(windows(spark))
    assert plan(counts).count("Exchange hashpartitioning") == 1 and "Join" not in plan(counts)


def test_full_contexts_shuffle_binary_digests_once(spark):
    found = queries()["full_context_stats"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(found) and "unhex" in plan(found)
    assert {len(r["context"]) for r in found.limit(50).collect()} == {32}


def test_next_word_stats_shuffle_once(spark):
    stats_ = ngrams.next_word_stats(windows(spark))
    assert plan(stats_).count("Exchange hashpartitioning") == 1
    assert "Join" not in plan(stats_)
    rows = {(r["context"], r["next"]): (r["count"], r["context_count"]) for r in stats_.collect()}
    assert rows["a b", "c."] == (2, 4) and rows["a b", "c"] == (1, 4) and rows["a b", "d!"] == (1, 4)


def test_summary_makes_no_second_table_of_pairs(spark):
    found = ngrams.corpus_summary(windows(spark), 2)
    assert "Subquery" not in plan(found)
    row, rows = found.first(), windows(spark).collect()
    assert (row["total_windows"], row["total_words"]) == (len(rows), len(rows))
    assert (row["unique_contexts"], row["unique_words"]) == (len({r["context"] for r in rows}), len({r["next"] for r in rows}))
    assert tuple(ngrams.corpus_summary(windows(spark).where("false"), 2).first()) == (0, 0, 0, 0, 2)


def test_chosen_contexts_are_sent_to_the_windows(spark):
    words = spark.createDataFrame([("c",), ("d!",)], "word string")
    found = ngrams.with_context_share(ngrams.top_contexts(windows(spark), words, 3, 2), windows(spark))
    assert "BroadcastHashJoin" in plan(found) and "LeftSemi" in plan(found).split("BroadcastHashJoin", 1)[1]
    assert {(r["word"], r["context"], r["count"], r["frequency"]) for r in found.collect()} == {("c", "a b", 1, 0.25), ("d!", "a b", 1, 0.25)}


def test_pairs_are_shuffled_without_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [0.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [1.0, 2.0, 3.0]), (5, []), (None, [1.0, 1.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    pairs = [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (4, 0, "e"), (5, 5, "f"), (9, 0, "g"), (None, 0, "h"), (0, None, "i"), (1, 0, "a")]
    wanted = spark.createDataFrame(pairs, "i long, j long, rating string")
    for size in (1, 65_536):
        found = stats.pair_similarities(wanted, table, block_rows=size)
        assert "Join" not in plan(found)
        assert found.columns == ["j", "i", "rating", "sim"]
        rows = sorted((r["rating"], -9.0 if r["sim"] is None else round(r["sim"], 9)) for r in found.collect())
        half = round(math.sqrt(0.5), 9)
        assert rows == [("a", 0.0), ("a", 0.0), ("a", half), ("a", half), ("b", half), ("b", half), ("b", 1.0), ("b", 1.0),
                        ("c", -9.0), ("d", -9.0), ("e", -9.0), ("f", 0.0)]


def test_empty_tables_give_no_pair(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert stats.pair_similarities(spark.createDataFrame([(1, 0)], "i long, j long"), vectors).count() == 0
