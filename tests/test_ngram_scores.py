"""The n-gram scorer: packed windows, and steps that meet the pairs where those lie."""

import math
import re
from collections import Counter

import pytest
from __spark_entry__ import queries
from lexmill.operators import ngrams, scoring


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(1, "a b c. a b d! x"), (2, "a b c a b c. q r. s t"), (3, None), (4, "a b c. c b a")]
    turns = [(1, 0, "user", "a b c"), (1, 1, "assistant", "b"), (2, 0, "user", "c b a zz q"), (2, 1, "user", None), (3, 0, None, "t s"), (4, 0, "user", "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sents = [s.split() for s in ("a b c.", "a b d!", "x", "a b c a b c.", "q r.", "s t", "a b c.", "c b a")]
    return str(tmp_path), turns, Counter((x, y) for s in sents for x, y in zip(s, s[1:]))


def logprob(words, pairs: Counter, floor: float) -> float:
    total = 0.0
    for x, y in zip(words, words[1:]):
        before, after = sum(n for (a, _), n in pairs.items() if a == x), sum(n for (_, b), n in pairs.items() if b == y)
        total += math.log(pairs[x, y] / before) if pairs[x, y] else math.log(after / pairs.total()) if after else floor
    return total


def test_pairs_are_shuffled_once_and_not_stored(spark, folder):
    found = queries()["ngram_score"](spark, folder[0])
    exchanges = re.findall(r"Exchange hashpartitioning\((.*)", plan(found))
    assert "Scan ExistingRDD" not in plan(found)
    assert not [x for x in exchanges if "context" in x and "next" in x]
    assert all("REPARTITION_BY_NUM" in x for x in exchanges if "context" in x)


def test_scores_of_turns_and_their_reverse(spark, folder):
    from lexmill.plans.score_queries import FLOOR

    path, turns, pairs = folder
    rows = {(r["conv_id"], r["turn"], r["cand"]): r["logprob"] for r in queries()["ngram_score"](spark, path).collect()}
    wanted = {(c, t, k): logprob((x or "").split()[:: 1 - 2 * k], pairs, FLOOR) for c, t, _, x in turns for k in (0, 1)}
    assert rows == pytest.approx(wanted, abs=1e-4)


def test_ranking_shuffles_pairs_once(spark, folder):
    found = queries()["ngram_ranking"](spark, folder[0])
    assert "Scan ExistingRDD" not in plan(found) and not re.findall(r"hashpartitioning\(context#\d+, next", plan(found))
    # where both are equally likely, as without any step, the first is taken
    path, turns, pairs = folder
    better = {(c, t): logprob((x or "").split(), pairs, -20.0) >= logprob((x or "").split()[::-1], pairs, -20.0) for c, t, _, x in turns}
    wanted = {role: (sum(r == role for _, _, r, _ in turns), sum(better[c, t] for c, t, r, _ in turns if r == role)) for role in ("user", "assistant")}
    rows = {r["role"]: (r["total"], r["correct"]) for r in found.collect()}
    assert {k: rows[k] for k in wanted} == wanted


def test_candidates_with_equal_or_null_keys(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.25)], "context string, next string, frequency double")
    words = spark.createDataFrame([("b", 0.125), ("c", 0.5)], "next string, frequency double")
    given = [(1, "a b c"), (1, "a b a b"), (1, "x"), (None, "b b"), (None, None), (2, "c"), (3, None), (4, "z z")]
    found = scoring.ngram_score(spark.createDataFrame(given, "id long, sentence string"), pairs, words, ["id"], -9.0)
    half, eighth = math.log(0.5), math.log(0.125)
    assert {r["id"]: r["logprob"] for r in found.collect()} == pytest.approx(
        {1: 3 * half + math.log(0.25) - 9.0, None: eighth, 2: 0.0, 3: 0.0, 4: -9.0}
    )


def test_packed_windows_are_the_same_windows(spark, monkeypatch):
    rows = [("a", "b"), ("a", "b"), ("a", ""), ("", "a"), ("a", "x\ny"), ("a", None), (None, "b"), ("b c", "d"), ("好", "é"), ("a", ""), ("a", "\n")]
    given = spark.createDataFrame(rows * 3, "context string, next string").coalesce(1)
    assert sorted(map(repr, ngrams.next_word_stats(given, packed=True).collect())) == sorted(map(repr, ngrams.next_word_stats(given).collect()))
    assert ngrams.next_word_stats(given.where("false"), packed=True).count() == 0
    table = given.where("context is not null").toArrow()
    monkeypatch.setattr(ngrams, "PACKED_WINDOWS", 4)
    packs = [r for b in ngrams._packer(iter(table.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    back = [(r["context"], x) for r in packs for x in ([r["alone"]] if r["packed"] is None else r["packed"].split("\n"))]
    assert Counter(back) == Counter((c, n) for c, n in rows * 3 if c is not None)
    assert len(packs) < len(back)
