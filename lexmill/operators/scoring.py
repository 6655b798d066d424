"""Candidate log-probabilities, temperature grids, ranking, and scorers that plug in."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.functions import text as tx
from lexmill.operators.ordering import dense_positions, id_groups
from lexmill.session import python_partitions

ITEM = ["task", "uid", "idx"]


def temperatures(low: float, high: float | None = None, step: float = 0.05) -> list[float]:
    """Grid from ``low`` in integer multiples of ``step``; the last value may lie above ``high``."""
    if high is None:
        return [low]
    count = math.ceil((high + step - low) / step)
    return [max(round(low + i * step, 12), 1e-6) for i in range(count)]


def with_temperatures(df: DataFrame, grid: list[float]) -> DataFrame:
    """Every row once per temperature of the (fixed, short) grid."""
    return df.select("*", F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))


def token_logprobs(logits: DataFrame, grid: list[float]) -> DataFrame:
    """Add ``temperature`` and ``logprob`` of ``target`` to rows with an array ``logits``."""
    x = nm.as_doubles(F.col("logits"))
    return with_temperatures(logits, grid).withColumn(
        "logprob", nm.target_logprob(x, F.col("target"), F.col("temperature"))
    )


def completion_logprob(tokens: DataFrame, keys: list[str], mask: str | None = None) -> DataFrame:
    """Sum of token log-probabilities per candidate, over tokens whose ``mask`` is 1."""
    value = F.col("logprob") if mask is None else F.col("logprob") * F.col(mask)
    return tokens.groupBy(*keys).agg(F.sum(value).alias("logprob"))


def rank_candidates(scores: DataFrame, keys: list[str] | None = None, cand: str = "cand") -> DataFrame:
    """The candidate with the highest log-probability; ties and NaN go to the lowest index."""
    keys = keys or [*ITEM, "temperature"]
    score = F.when(~F.isnan("logprob"), F.col("logprob")).otherwise(F.lit(float("-inf")))
    return scores.groupBy(*keys).agg(
        F.max_by(F.col(cand), F.struct(score, -F.col(cand))).alias("chosen")
    )


def first_candidate_prob(scores: DataFrame, keys: list[str] | None = None, cand: str = "cand") -> DataFrame:
    """Softmax over the candidates' log-probabilities, value of candidate 0.

    ``prob = 1 / sum(exp(x_k - x_0))`` per item; an item has a handful of candidates.
    """
    keys = keys or [*ITEM, "temperature"]
    values = F.array_sort(F.collect_list(F.struct(F.col(cand).alias("c"), F.col("logprob").alias("x"))))
    xs = F.transform("_v", lambda s: s["x"])
    return (
        scores.groupBy(*keys).agg(values.alias("_v"))
        .withColumn("prob", F.exp(F.get(xs, F.lit(0)) - nm.log_sum_exp(xs)))
        .drop("_v")
    )


def build_predictions(
    ranked: DataFrame, items: DataFrame, full_sentence_tasks: tuple[str, ...] = ("comps",)
) -> DataFrame:
    """Prediction rows ``(task, uid, idx, temperature, id, pred, chosen, is_correct)``.

    The id counts the items of a uid in (idx) order. The count is a dense position built from
    range-bounded groups, as one uid may hold a large part of all items.
    """
    counted = dense_positions(
        items.select(*ITEM), [F.col("idx")], id_groups(F.col("idx")), within=["task", "uid"], name="_k"
    )
    texts = F.when(F.col("task").isin(*full_sentence_tasks), F.col("sentences")).otherwise(F.col("completions"))
    return (
        ranked.join(items.select(*ITEM, "label", texts.alias("_texts")), ITEM)
        .join(counted, ITEM)
        .select(
            *ITEM, "temperature", F.concat_ws("_", "uid", "_k").alias("id"),
            F.get("_texts", F.col("chosen")).alias("pred"), "chosen",
            (F.col("chosen") == F.col("label")).alias("is_correct"),
        )
    )


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_with(candidates: DataFrame, scorer: Scorer) -> DataFrame:
    """Apply a user's model: an iterator of batches gets a column ``logprob``.

    The scorer runs once per Python worker and partition, below any temperature expansion.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", logprob double"
    return candidates.mapInPandas(scorer, schema)


def ngram_score(
    candidates: DataFrame, pairs: DataFrame, words: DataFrame, keys: list[str], floor: float,
    text: str = "sentence",
) -> DataFrame:
    """Log-probability of a sentence under next-word statistics.

    log P(next | previous word) from ``pairs`` (context, next, frequency; each once) of one-word contexts, else
    log P(next) from ``words`` (next, frequency), else ``floor``. Steps are dealt by context, as the rows of ``next_word_stats`` are, and
    meet the pairs there, so pairs, the larger side, are not shuffled again. All equal steps meet in one task; those that take the
    word's probability meet in a join, whose large groups adaptive execution splits.
    """
    tokens = tx.words(F.col(text))
    taken = candidates.select(*keys, tokens.alias("tokens"))
    several = F.size("tokens") > 1
    steps = taken.where(several).select(
        *keys,
        F.explode(
            F.zip_with(
                F.expr("slice(tokens, 1, size(tokens) - 1)"), F.expr("slice(tokens, 2, size(tokens))"),
                lambda a, b: F.struct(a.alias("context"), b.alias("next")),
            )
        ).alias("s"),
    ).select("s.context", "s.next", F.struct(*keys).alias("_of"))
    asked = python_partitions(steps, "context").withColumn("_pair", F.lit(None).cast("double"))
    nobody = F.lit(None).cast(asked.schema["_of"].dataType)
    known = pairs.select("context", "next", nobody.alias("_of"), F.log("frequency").alias("_pair"))
    met = (
        known.unionByName(asked).withColumn("_pair", F.max("_pair").over(Window.partitionBy("context", "next")))
        .where("_of is not null")
    )
    scored = met.join(words.select("next", F.log("frequency").alias("_word")), "next", "left").select(
        "_of.*", F.coalesce("_pair", "_word", F.lit(float(floor))).alias("_lp")
    )
    without = taken.where(~F.coalesce(several, F.lit(False))).select(*keys, F.lit(0.0).alias("_lp"))
    return scored.unionByName(without).groupBy(*keys).agg(F.sum("_lp").alias("logprob"))


def surprisal_context(context: Column, use_bos_only: bool = False, bos: str = "<s>") -> Column:
    """Context text in front of a target word: stripped plus one space, or the start token only."""
    return F.lit(bos) if use_bos_only else F.concat(tx.strip(context), F.lit(" "))


def word_surprisal(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Minus the summed log-probability (nats) of a word's tokens; NaN if a token has none."""
    missing = F.count_if(F.col("logprob").isNull() | F.isnan("logprob")) > 0
    return tokens.groupBy(*keys).agg(
        F.when(missing, F.lit(float("nan"))).otherwise(-F.sum("logprob")).alias("surprisal")
    )


def chained_word_prob(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Product of the sub-token probabilities and whether there is more than one of them."""
    return tokens.groupBy(*keys).agg(
        F.exp(F.sum("logprob")).alias("prob"), (F.count(F.lit(1)) > 1).alias("multi_token")
    )


def word_and_prev_surprisal(rows: DataFrame) -> DataFrame:
    """``pred`` and ``prev_pred`` from the probabilities of a word and the word before it."""
    return rows.withColumns(
        {
            "pred": -F.log("prob"),
            "prev_pred": F.when(F.col("prev_item").isNotNull(), -F.log("prev_prob")),
        }
    )


def argmax_class(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("pred", nm.argmax(F.col(logits)))
