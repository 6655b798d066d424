"""Sentence-prefix contexts, next-word statistics and context selection for target words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as tx
from lexmill.session import cut_lineage, python_partitions

# Marks that end a sentence, and what may close a quotation or bracket behind them.
ENDS = ".!?。！？।؟"
CLOSERS = r"\"'”’»)\]}」』）"

# Most rows of chosen contexts that are sent to every executor.
BROADCAST_ROWS = 200_000

# Windows that lie within so many words of a sentence's start are counted apart from the longer ones, see ``owned_prefixes``.
START = 3

# Windows that a task packs at a time, and what stands between the packed words.
PACKED_WINDOWS = 1 << 21
BETWEEN = "\n"


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences cut after a sentence mark (with closing quotes or brackets) and white space, as white-space separated tokens.

    After the marks of scripts without blanks the white space may be missing.
    """
    if text not in docs.columns:
        raise ValueError(f"column '{text}' not found, there is: {docs.columns}")
    # One character is looked at first at every place, so the longer look behind runs at white space and behind marks only.
    blank = rf"(?=[{tx.SPACE}])(?<=[{ENDS}][{CLOSERS}]{{0,3}})[{tx.SPACE}]+"
    joined = rf"(?<=[。！？{CLOSERS}])(?<=[。！？][{CLOSERS}]{{0,3}})(?![{CLOSERS}。！？{tx.SPACE}]|$)"
    parts = F.split(text, f"{blank}|{joined}")
    return (
        docs.select(key, F.posexplode_outer(parts).alias("sent_no", "sentence"))
        .where("sentence is not null")
        .select(key, "sent_no", tx.words(F.col("sentence")).alias("tokens"))
    )


def prefix_windows(
    sents: DataFrame, max_context: int, next_in: DataFrame | None = None, key: str = "doc_id"
) -> DataFrame:
    """One row per token after the first of a sentence: ``next`` and its ``context``.

    The context is the sentence before the token, cut to the last ``max_context`` tokens, so a row
    never carries more than that. ``next_in`` (column ``word``) keeps only windows of those words.
    """
    # Built behind the generator, where it is compiled; a lambda over the positions is interpreted per token.
    size = F.least("i", F.lit(max_context))
    exploded = (
        sents.select(key, "sent_no", "tokens", F.posexplode_outer("tokens").alias("i", "next"))
        .where("i > 0 and next is not null")
        .select(
            key, "sent_no", "i", "next",
            F.array_join(F.slice("tokens", F.col("i") - size + 1, size), " ").alias("context"), size.alias("context_size"),
        )
    )
    if next_in is None:
        return exploded
    words = next_in.select(F.col("word").alias("next")).distinct()
    return exploded.join(words, "next", "left_semi")


@F.pandas_udf(T.ArrayType(T.StringType()))
def prefix_digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """MD5 of every proper prefix of a token list, extended token by token (linear time)."""
    def digests(tokens) -> list[str]:
        running, out = hashlib.md5(), []
        for i, token in enumerate(tokens[:-1]):
            running.update((" " if i else "").encode() + token.encode())
            out.append(running.hexdigest())
        return out

    for batch in batches:
        yield batch.map(digests)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``owned_prefixes`` from sorted texts; holds one batch and the prefixes of the current text."""
    before: list[str] = []
    open_at: list[list] = [[]]  # the owner of each open prefix, by its number of words
    owners: list[list] = []  # of open prefixes: text, first, counts
    for batch in batches:
        done = []
        for text, n in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words = text.split(" ")
            size = len(words) - 1  # behind the last blank there is nothing
            same = 0
            for a, b in zip(before, words):
                if a != b:
                    break
                same += 1
            while owners and owners[-1][1] >= same:
                done.append(owners.pop())
            low, first = 1 if size <= START else START, max(same, 1)
            for i in range(low, first):
                owner = open_at[i]
                owner[2][i - owner[1]] += n
            if first < size:
                owner = [text, first, [n if i >= low else 0 for i in range(first, size)]]
                owners.append(owner)
                open_at[first:] = [owner] * (size - first)
            before = words[:size]
        yield _owner_batch(done)
    yield _owner_batch(owners)


def _owner_batch(owners: list[list]) -> pa.RecordBatch:
    texts, firsts, counts = zip(*owners, strict=True) if owners else ((), (), ())
    columns = [pa.array(texts, pa.string()), pa.array(firsts, pa.int32()), pa.array(counts, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["text", "first", "counts"])


def owned_prefixes(sents: DataFrame) -> DataFrame:
    """Sentences (``tokens``) with the number of uses (``counts``) of the prefixes that no sentence before has, from ``first`` words on.

    Together they have each proper prefix with its next word once. What is shuffled are sentences, equal ones once, and no windows: a
    digest of each window takes several times the text. Equal windows start with the same words, so sentences are dealt by their
    first ``START`` + 1 words and the windows of shorter contexts come from the first ``START`` words alone, dealt by two of them. In
    the order of their texts the sentences of a prefix are neighbours. Words must be free of blanks.
    """
    start = F.slice("tokens", 1, START)
    texts = F.when(F.size("tokens") > START, F.array(start, F.col("tokens"))).otherwise(F.array(start))
    # the blank behind the last word keeps the sentences of a prefix together whatever characters words have
    text = F.concat(F.array_join("part", " "), F.lit(" "))
    counted = (
        sents.where(F.size("tokens") > 1).select(F.explode(texts).alias("part"))
        .groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    )
    words = F.split("text", " ", START + 2)
    first = F.when(F.size(words) > START + 1, F.slice(words, 1, START + 1)).otherwise(F.slice(words, 1, 2))
    dealt = python_partitions(counted, F.xxhash64(first))
    owned = dealt.sortWithinPartitions("text").mapInArrow(_owners, "text string, first int, counts array<bigint>")
    tokens = F.split("text", " ")
    return owned.select(F.slice(tokens, F.lit(1), F.size(tokens) - 1).alias("tokens"), "first", "counts")


def full_prefix_windows(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """As ``prefix_windows`` with unlimited context, which is identified by its MD5.

    Writing out all prefixes of a sentence takes quadratic space, so the shuffle carries digests;
    ``context_text`` cuts the text of chosen contexts out of one of their sentences. From the rows of ``owned_prefixes`` it
    makes each distinct window once, with its ``count`` in place of its position.
    """
    digests, following = prefix_digests("tokens"), F.expr("slice(tokens, 2, size(tokens))")
    if "counts" in sents.columns:
        at = [F.col("first"), F.size("counts")]
        own = F.arrays_zip(F.slice(digests, *at).alias("context"), F.slice(following, *at).alias("next"), F.col("counts").alias("count"))
        return sents.select(F.explode_outer(own).alias("w")).select("w.*").where("count > 0")
    pairs = F.arrays_zip(digests.alias("context"), following.alias("next"))
    return (
        sents.select(key, "sent_no", F.posexplode_outer(F.when(F.size("tokens") > 1, pairs)).alias("at", "w"))
        .where("w is not null")
        .select(
            key, "sent_no", (F.col("at") + 1).alias("i"), F.col("w")["next"].alias("next"),
            F.col("w")["context"].alias("context"), (F.col("at") + 1).alias("context_size"),
        )
    )


def context_text(chosen: DataFrame, sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text of contexts given as (key, sent_no, context_size) of one occurrence."""
    return chosen.join(sents, [key, "sent_no"]).withColumn(
        "context_text", F.array_join(F.slice("tokens", F.lit(1), F.col("context_size")), " ")
    ).drop("tokens")


def _per_million(frequency: Column) -> Column:
    return F.log10(frequency * 1_000_000)


def _with_share(counts: DataFrame, by: str, pairs: DataFrame | None = None) -> DataFrame:
    # The total comes from the counts, so the windows are built once and the exchange is reused.
    total = (counts if pairs is None else pairs).agg(F.sum("count").alias("total")).scalar()
    frequency = F.col("count") / total
    return counts.select(
        by, "count", frequency.alias("frequency"), _per_million(frequency).alias("log_freq_per_million")
    )


def context_stats(windows: DataFrame) -> DataFrame:
    """Count, share of all windows and log10 per million of every context."""
    return _with_share(windows.groupBy("context").agg(F.count(F.lit(1)).alias("count")), "context")


def word_stats_of_pairs(pairs: DataFrame) -> DataFrame:
    """``word_stats`` from the rows of ``next_word_stats``, so that windows are counted once for both."""
    # the total of the pairs is that of the words; where words are joined a filter keeps their exchange from being used again
    return _with_share(pairs.groupBy("next").agg(F.sum("count").alias("count")), "next", pairs)


def word_stats(windows: DataFrame) -> DataFrame:
    """Counts of next words; the first token of a sentence is never counted."""
    return _with_share(windows.groupBy("next").agg(F.count(F.lit(1)).alias("count")), "next")


def pair_counts(windows: DataFrame) -> DataFrame:
    """Count of every (context, next), in one aggregation; windows that come once, with a ``count``, are counted already."""
    if "count" in windows.columns:
        return windows.select("context", "next", "count")
    return windows.groupBy("context", "next").agg(F.count(F.lit(1)).alias("count"))


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Next words of a context in one row, equal ones side by side; a word that is NULL or holds ``BETWEEN`` stands ``alone``."""
    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        alone = pc.fill_null(pc.match_substring(table["next"], BETWEEN), True)
        odd, plain = table.filter(alone), table.filter(pc.invert(alone))
        if plain.num_rows:
            contexts, words = (plain[k].combine_chunks().dictionary_encode() for k in ("context", "next"))
            codes = contexts.indices.to_numpy().astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
            codes.sort()
            context, word = np.divmod(codes, len(words.dictionary))
            starts = np.flatnonzero(np.diff(context, prepend=-1))
            ends = np.append(starts, len(codes)).astype(np.int32)
            packed = pc.binary_join(pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(word))), BETWEEN)
            yield batch(contexts.dictionary.take(pa.array(context[starts])), packed, pa.nulls(len(starts), pa.string()))
        if odd.num_rows:
            yield batch(odd["context"].combine_chunks(), pa.nulls(odd.num_rows, pa.string()), odd["next"].combine_chunks())

    def batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns], ["context", "packed", "alone"])

    held, rows = [], 0
    for some in batches:
        held.append(some)
        rows += some.num_rows
        if rows >= PACKED_WINDOWS:
            yield from pack(held)
            held, rows = [], 0
    if held:
        yield from pack(held)


def _dealt_packed(windows: DataFrame) -> DataFrame:
    """Windows dealt by context; a task sends the next words that it has for a context together, a row each takes several times the bytes."""
    packed = windows.mapInArrow(_packer, "context string, packed string, alone string")
    words = F.when(F.col("packed").isNotNull(), F.split("packed", BETWEEN)).otherwise(F.array("alone"))
    return python_partitions(packed, "context").select("context", F.explode(words).alias("next"))


def next_word_stats(windows: DataFrame, packed: bool = False) -> DataFrame:
    """Count of every (context, next) and its share inside the context.

    The windows are dealt by context once; pairs and totals are both counted where they lie. As a context NULL is no context, it is left out.
    ``packed`` is for short contexts, of which a task has many windows: the shuffle then takes less than half.
    """
    known = windows.where("context is not null").select("context", "next")
    dealt = _dealt_packed(known) if packed else known.repartition("context")
    total = F.sum("count").over(Window.partitionBy("context"))
    frequency = F.col("count") / F.col("context_count")
    return pair_counts(dealt).withColumn("context_count", total).select(
        "context", "next", "count", "context_count", frequency.alias("frequency"),
        _per_million(frequency).alias("log_freq_per_million"),
    )


def corpus_summary(windows: DataFrame, max_context: int | None) -> DataFrame:
    """Totals and numbers of distinct contexts and words, all from one pass over the windows."""
    return windows.agg(
        F.count(F.lit(1)).alias("total_windows"), F.count(F.lit(1)).alias("total_words"),
        # in a struct a NULL is a value like any other
        F.count_distinct(F.struct("context")).alias("unique_contexts"), F.count_distinct(F.struct("next")).alias("unique_words"),
        F.lit(max_context).cast("int").alias("max_context_size"),
    )


def _select_contexts(
    windows: DataFrame, words: DataFrame, n: int, min_window: int, order: list[Column]
) -> DataFrame:
    """Per word the first ``n`` contexts in the given order.

    ``windows`` must hold every window of the corpus if shares inside the context are wanted; the
    pair counts that feed the ranking are restricted to the target words before they are built.
    """
    targets = words.select(F.col("word").alias("next")).distinct()
    pairs = (
        windows.where(F.col("context_size") >= min_window)
        .join(targets, "next", "left_semi")
        .groupBy("next", "context").agg(F.count(F.lit(1)).alias("count"))
    )
    # Two rounds: the first keeps n rows per (word, slice), so a very frequent word is spread over
    # many tasks and the final window sees at most 64 * n rows of it.
    sliced = pairs.withColumn("_slice", F.pmod(F.xxhash64("context"), F.lit(64)))
    first = Window.partitionBy("next", "_slice").orderBy(*order)
    final = Window.partitionBy("next").orderBy(*order)
    kept = sliced.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn")
    return (
        kept.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= n)
        .select(F.col("next").alias("word"), "rank", "context", "count")
    )


def top_contexts(windows: DataFrame, words: DataFrame, n: int, min_window: int = 1) -> DataFrame:
    """The ``n`` most frequent contexts of every word; ties in context order."""
    return _select_contexts(windows, words, n, min_window, [F.desc("count"), F.col("context")])


def random_contexts(
    windows: DataFrame, words: DataFrame, n: int, seed: int, min_window: int = 1
) -> DataFrame:
    """``n`` contexts of every word, drawn without replacement in seeded hash order."""
    order = [tx.seeded_key(seed, F.col("next"), F.col("context")), F.col("context")]
    return _select_contexts(windows, words, n, min_window, order)


def with_context_share(selected: DataFrame, windows: DataFrame) -> DataFrame:
    """Add the share of the word inside each selected context, counted over all windows."""
    # Stored, so that the choice is made once and its size is known: a small one is sent to the windows, which then need not be shuffled.
    selected = cut_lineage(selected)
    contexts = selected.select("context").distinct()
    if selected.count() <= BROADCAST_ROWS:
        contexts = F.broadcast(contexts)
    totals = (
        windows.join(contexts, "context", "left_semi")
        .groupBy("context").agg(F.count(F.lit(1)).alias("context_count"))
    )
    share = F.col("count") / F.col("context_count")
    return selected.join(totals, "context").select(
        "word", "rank", "context", "count", share.alias("frequency"),
        _per_million(share).alias("log_freq_per_million"),
    )


def contexts_per_word(selected: DataFrame, words: DataFrame) -> DataFrame:
    """One row per word with its contexts in rank order; an empty list where there is none.

    A list holds at most the requested ``n`` contexts.
    """
    lists = selected.groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("rank", "context", "count"))).alias("contexts")
    )
    return words.select("word").distinct().join(lists, "word", "left").select(
        "word",
        F.coalesce(
            "contexts", F.expr("cast(array() as array<struct<rank:int,context:string,count:bigint>>)")
        ).alias("contexts"),
    )


def filter_spelled_words(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Words whose lower case is in the lexicon (column ``word``)."""
    known = lexicon.select(F.lower("word").alias("_known")).distinct()
    return words.join(known, F.lower(word) == F.col("_known"), "left_semi")


def words_with_enough_contexts(contexts: DataFrame, min_contexts: int = 0) -> DataFrame:
    """Words longer than one character that have at least ``min_contexts`` contexts."""
    return contexts.where((F.length("word") > 1) & (F.size("contexts") >= min_contexts))
