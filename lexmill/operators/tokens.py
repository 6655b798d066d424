"""Byte-level subword vocabularies, encoding, and fixed-length training sequences."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as tx
from lexmill.functions.numeric import let
from lexmill.operators import flat_words as fw
from lexmill.operators.flat_words import merged_ids  # noqa: F401  (also by its old place)
from lexmill.operators.ordering import id_groups, running_total
from lexmill.session import cut_lineage

# Fixed values of the tokenizer set-up.
SPECIALS = ("<pad>", "<s>", "</s>")
VOCAB_SIZE = 16_000
MIN_FREQUENCY = 2
# Pre-tokens: contractions, words, numbers and other signs with an optional leading space, white space.
_WS = r"\t-\r\x{85}\p{Z}"
PRETOKEN = (
    r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+)"
)


def pretokens(text: Column, add_prefix_space: bool = True) -> Column:
    """Pre-tokens of a text that is already normalised."""
    if add_prefix_space:
        text = F.when(text.rlike(rf"^[{_WS}]"), text).otherwise(F.concat(F.lit(" "), text))
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(1))


def pretoken_counts(docs: DataFrame, text: str = "text", normalize: bool = True) -> DataFrame:
    source = tx.normalize_nfkc(F.col(text)) if normalize else F.col(text)
    return (
        docs.select(source.alias("_text"))
        .select(F.explode_outer(pretokens(F.col("_text"))).alias("pretoken"))
        .where("pretoken is not null")
        .groupBy("pretoken").agg(F.count(F.lit(1)).alias("count"))
    )


def byte_order() -> list[int]:
    """All byte values in vocabulary order: visible characters first, then the others."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return visible + [b for b in range(256) if b not in set(visible)]


@dataclass
class Vocabulary:
    """A learned vocabulary: specials, single bytes, then one entry per merge."""

    specials: tuple[str, ...]
    alphabet: list[int]
    merges: list[tuple[int, int]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.specials) + len(self.alphabet) + len(self.merges)

    def byte_ids(self) -> dict[int, int]:
        return {b: len(self.specials) + i for i, b in enumerate(self.alphabet)}

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id; specials as their UTF-8 text."""
        out = [s.encode() for s in self.specials] + [bytes([b]) for b in self.alphabet]
        for a, b in self.merges:
            out.append(out[a] + out[b])
        return out


def train_bpe(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    specials: tuple[str, ...] = SPECIALS,
    candidates: int = 65_536,
    most_segments: int = 200_000,
) -> Vocabulary:
    """Learn merges from a (pretoken, count) table, most frequent pair first, ties by lower ids.

    Works in rounds. One aggregation finds the leading ``candidates`` pairs; words are cut wherever a pair is not among them, and equal
    pieces are one segment with a count. Only segments reach the driver, at most ``most_segments``; if there are more, the round takes
    fewer pairs. There merges are learned with counts updated by deltas, as long as the best pair comes before the first pair
    left out. A pair that arises across a cut is no more frequent than the pair that was cut, so the result equals one merge at a
    time over the whole table. A round merges its best pair at least.
    """
    stored = cut_lineage(counts).where("pretoken <> ''").select(F.encode("pretoken", "UTF-8").alias("bytes"), F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
    present = {r[0] for r in stored.select("bytes").mapInArrow(_bytes_in_use, "byte int").distinct().collect()}
    vocabulary = Vocabulary(specials, [b for b in byte_order() if b in present])
    # One task per core: the table is small next to the corpus but read once per round.
    words = cut_lineage(
        stored.repartition(counts.sparkSession.sparkContext.defaultParallelism)
        .mapInArrow(_each_batch(_byte_symbols(vocabulary)), "ids array<int>, n bigint")
    )
    total, taken = words.count(), candidates
    while vocabulary.size < vocab_size:
        best = _best_pairs(words, taken + 1, min_frequency)
        if not best:
            break
        while True:
            leading, after = [(a, b) for a, b, _ in best[:taken]], best[taken] if len(best) > taken else None
            # the runs of one pair differ in their length only
            most = most_segments + 1 if taken > 1 else None
            # if a few of the words have too many segments, so do all
            few = taken > 1 and total > 8 * most_segments and _segments(words.sample(4 * most_segments / total, seed=1), leading, most)
            if not few or len(few) <= most_segments:
                segments = _segments(words, leading, most)
                if len(segments) <= most_segments or taken == 1:
                    break
            taken = max(1, min(taken, len(best)) // 2)
        first = vocabulary.size
        merges = learn_merges(segments, first, vocab_size - first, min_frequency, after)
        vocabulary.merges.extend(merges)
        if vocabulary.size < vocab_size:
            ranks = fw.PairTable(merges)
            words = cut_lineage(
                words.mapInArrow(_each_batch(lambda c, ranks=ranks, first=first: fw.merged(*fw.flat(c), ranks, first)), "ids array<int>, n bigint")
            )
        if len(segments) < most_segments // 4:
            taken = min(candidates, taken * 4)
    return vocabulary


def _bytes_in_use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(fw.flat_bytes(batch.column(0))[0]).astype(np.int32))], ["byte"])


def _byte_symbols(vocabulary: Vocabulary):
    """Function: Arrow binaries -> symbols and sizes; bytes that the vocabulary lacks are left out."""
    table = np.full(256, -1, np.int64)
    for byte, symbol in vocabulary.byte_ids().items():
        table[byte] = symbol

    def run(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values, sizes = fw.flat_bytes(words)
        ids, known = table[values], table[values] >= 0
        if known.all():
            return ids, sizes
        total = np.append(0, np.cumsum(known))
        ends = np.cumsum(sizes)
        return ids[known], total[ends] - total[ends - sizes]

    return run


def _each_batch(fn):
    """Words (symbols, n) of a batch after ``fn``; a word of one symbol takes part in no further merge and is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = fn(batch.column(0))
            open_words = sizes > 1
            ids, n = ids[np.repeat(open_words, sizes)], batch.column(1).filter(pa.array(open_words))
            yield pa.RecordBatch.from_arrays([fw.lists_of(ids, sizes[open_words]), n], ["ids", "n"])

    return run


def _best_pairs(words: DataFrame, k: int, min_frequency: int) -> list[tuple[int, int, int]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = fw.pair_counts(*fw.flat(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    pairs = words.mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency)
    return [tuple(r) for r in pairs.orderBy(F.desc("n"), "a", "b").limit(k).collect()]


def _segments(words: DataFrame, inside: list[tuple[int, int]], most: int | None) -> list[tuple[list[int], int]]:
    """Distinct segments with their counts, at most ``most`` if given. Words are cut wherever a pair is not ``inside``."""
    table = fw.PairTable(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, word = fw.cut_apart(*fw.flat(batch.column(0)), table)
            yield pa.RecordBatch.from_arrays([fw.lists_of(ids, sizes), batch.column(1).take(pa.array(word))], ["segment", "n"])

    found = words.mapInArrow(cut, "segment array<int>, n bigint").groupBy("segment").agg(F.sum("n").alias("n"))
    rows = (found.limit(most) if most else found).toArrow()
    return list(zip(rows["segment"].to_pylist(), rows["n"].to_pylist()))


def replaced(ids: list[int], a: int, b: int, new: int) -> list[int]:
    """``ids`` with every pair (a, b), from the left, replaced by ``new``."""
    out, i, last = [], 0, len(ids) - 1
    while i <= last:
        if i < last and ids[i] == a and ids[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def learn_merges(
    segments: list[tuple[list[int], int]], first: int, room: int, min_frequency: int, after: tuple[int, int, int] | None
) -> list[tuple[int, int]]:
    """At most ``room`` merges, each of the best pair (count, then lower ids), while it comes before the pair ``after`` (a, b, n)."""
    counts: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], set[int]] = {}
    for i, (ids, n) in enumerate(segments):
        for pair in zip(ids, ids[1:]):
            counts[pair] = counts.get(pair, 0) + n
            where.setdefault(pair, set()).add(i)
    end = (-after[2], after[0], after[1]) if after else (1, 0, 0)
    segments = list(segments)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < room:
        best = heapq.heappop(heap)
        n, a, b = -best[0], *best[1:]
        if counts.get((a, b), 0) != n:  # its present count has an entry of its own
            continue
        if n < min_frequency or best >= end:
            break
        new, changed = first + len(merges), set()
        merges.append((a, b))
        for i in where.pop((a, b)):
            ids, n = segments[i]
            after_merge = replaced(ids, a, b, new)
            if len(after_merge) == len(ids):
                continue
            for pair in zip(ids, ids[1:]):
                counts[pair] -= n
                changed.add(pair)
            for pair in zip(after_merge, after_merge[1:]):
                counts[pair] = counts.get(pair, 0) + n
                where.setdefault(pair, set()).add(i)
                changed.add(pair)
            segments[i] = (after_merge, n)
        for pair in changed:
            if counts[pair] > 0:
                heapq.heappush(heap, (-counts[pair], *pair))
            else:
                del counts[pair]
                where.pop(pair, None)
    return merges


def vocabulary_table(docs_vocab: Vocabulary, spark) -> DataFrame:
    """(id, token_hex, special) of a vocabulary; its size is fixed by the training call."""
    rows = [
        (i, token.hex().upper(), i < len(docs_vocab.specials))
        for i, token in enumerate(docs_vocab.token_bytes())
    ]
    return spark.createDataFrame(rows, "id int, token_hex string, special boolean")


def token_frequencies(encoded: DataFrame, tokens: str = "tokens") -> DataFrame:
    return (
        encoded.select(F.explode_outer(tokens).alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("freq"))
    )


def pretoken_frequencies(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, freq) in all texts from their (pretoken, count) table: a pre-token is encoded once, however often it occurs."""
    encode = _symbols_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = encode(batch.column(0))
            found, place = np.unique(ids, return_inverse=True)
            freq = np.zeros(len(found), np.int64)
            np.add.at(freq, place, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(freq)], ["id", "freq"])

    known = counts.where("pretoken is not null").select(F.encode("pretoken", "UTF-8").alias("bytes"), F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
    return known.mapInArrow(run, "id int, freq bigint").groupBy("id").agg(F.sum("freq").alias("freq"))


def _symbols_of(vocabulary: Vocabulary):
    """Function: Arrow binaries -> ids after all merges, and sizes."""
    base, ranks, symbols = len(vocabulary.specials) + len(vocabulary.alphabet), fw.PairTable(vocabulary.merges), _byte_symbols(vocabulary)
    return lambda words: fw.merged(*symbols(words), ranks, base)


def encoder(vocabulary: Vocabulary, most_pieces: int = 1_000_000):
    """Column function array<string> of pre-tokens -> array<int> of ids.

    A narrow step: documents are not shuffled. Of about ``most_pieces`` pre-tokens at a time (one document at least) each distinct one is
    encoded once, as most are frequent ones.
    """
    encode_words = _symbols_of(vocabulary)

    def some(lists: pa.Array) -> pa.Array:
        pieces = lists.flatten().dictionary_encode()
        ids, sizes = encode_words(pieces.dictionary.cast(pa.binary()))
        ends = np.append(0, np.cumsum(sizes[pieces.indices.to_numpy()]))
        offsets = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        tokens = fw.lists_of(ids, sizes).take(pieces.indices).flatten()
        return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), tokens, mask=lists.is_null())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            total = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.append(True, np.diff(total // most_pieces) > 0)) if len(total) else []
            for start, end in zip(cuts, [*cuts[1:], len(total)]):
                yield some(lists.slice(start, end - start))

    return encode


def encode_docs(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add ``tokens``: the ids of the normalised text."""
    return docs.withColumn("tokens", encoder(vocabulary)(pretokens(tx.normalize_nfkc(F.col(text)))))


def decoded(tokens: Column, vocabulary: Vocabulary) -> Column:
    """Text of a list of ids: byte values looked up, joined and decoded inside the JVM."""
    hexes = F.from_json(F.lit(json.dumps([t.hex() for t in vocabulary.token_bytes()])), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(tokens, lambda i: F.get(hexes, i)), "")), "UTF-8")


def roundtrip_check(encoded: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Documents and those whose decoded ids give back the normalised text (line ends unified)."""
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("\r\n"), F.lit("\n"))

    source = tx.normalize_nfkc(F.col(text))
    prefixed = F.when(source.rlike(rf"^[{_WS}]"), source).otherwise(F.concat(F.lit(" "), source))
    return encoded.select(
        plain(prefixed).alias("source"), plain(decoded(F.col("tokens"), vocabulary)).alias("back")
    ).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("source") == F.col("back")).alias("n_equal")
    )


def pack_sequences(docs: DataFrame, length: int, offset: int = 0, ord_col: str = "doc_id",
                   tokens: str = "tokens") -> DataFrame:
    """Concatenate all token lists in ``ord_col`` order and cut the stream into chunks of ``length``.

    The first ``offset`` tokens and the incomplete last chunk are dropped. Token positions come from
    a running total over document lengths; a chunk group never holds more than ``length`` tokens.
    """
    return _gather(_pieces(docs, length, offset, ord_col, tokens), length)


def _pieces(docs: DataFrame, length: int, offset: int, ord_col: str, tokens: str) -> DataFrame:
    starts = running_total(
        docs.select(ord_col, F.size(tokens).cast("bigint").alias("_n")), F.col("_n"),
        [F.col(ord_col)], id_groups(F.col(ord_col)), name="_start",
    ).where("_n > 0").select(
        ord_col, (F.col("_start") - offset).alias("_start"), (F.col("_start") - offset + F.col("_n")).alias("_end")
    )
    placed = docs.join(starts, ord_col)
    chunks = F.sequence(
        F.floor(F.greatest("_start", F.lit(0)) / length), F.floor((F.col("_end") - 1) / length)
    )
    begin = F.greatest(F.col("chunk_id") * length, "_start")
    end = F.least((F.col("chunk_id") + 1) * length, "_end")
    return (
        placed.where("_end > 0")
        .select("_start", "_end", tokens, F.explode(chunks).alias("chunk_id"))
        .select(
            "chunk_id", begin.alias("at"),
            F.slice(tokens, (begin - F.col("_start") + 1).cast("int"), (end - begin).cast("int")).alias("piece"),
        )
    )


def _gather(pieces: DataFrame, length: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return (
        pieces.groupBy("chunk_id")
        .agg(F.flatten(F.transform(ordered, lambda s: s["piece"])).alias("tokens"))
        .where(F.size("tokens") == length)
    )


def random_offset_chunks(docs: DataFrame, length: int, seed: int, epoch: int = 0,
                         ord_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Chunk i reads ``length`` tokens from i*length plus a seeded offset in [0, length).

    There is one chunk less than whole chunks in the stream. Each piece of the stream is sent to the
    two chunks it can belong to and cut to their ranges there.
    """
    # Stored, as sizes, pieces and the total would each compute the tokens again.
    docs = cut_lineage(docs.select(ord_col, tokens))
    pieces = _pieces(docs, length, 0, ord_col, tokens)
    targets = F.array(F.col("chunk_id"), F.col("chunk_id") - 1)
    offset = F.pmod(
        F.conv(F.substring(tx.seeded_key(seed, F.lit(epoch), F.col("target")), 1, 8), 16, 10).cast("bigint"),
        F.lit(length),
    )
    moved = (
        pieces.select(F.explode(targets).alias("target"), "at", "piece")
        .where("target >= 0")
        .withColumn("_from", F.col("target") * length + offset)
        .withColumn("_lo", F.greatest("_from", "at"))
        .withColumn("_hi", F.least(F.col("_from") + length, F.col("at") + F.size("piece")))
        .where("_lo < _hi")
        .select(
            F.col("target").alias("chunk_id"), F.col("_lo").alias("at"),
            F.slice("piece", (F.col("_lo") - F.col("at") + 1).cast("int"),
                    (F.col("_hi") - F.col("_lo")).cast("int")).alias("piece"),
        )
    )
    whole = docs.agg((F.sum(F.size(tokens).cast("bigint")) / length).cast("bigint").alias("n"))
    return _gather(moved, length).where(F.col("chunk_id") < whole.scalar() - 1)


def next_token_pairs(seqs: DataFrame, tokens: str = "tokens") -> DataFrame:
    size = F.greatest(F.size(tokens) - 1, F.lit(0))
    return seqs.withColumns(
        {"inputs": F.slice(tokens, F.lit(1), size), "targets": F.slice(tokens, F.lit(2), size)}
    )


def completion_positions(
    offsets: Column, sentence: Column, completion: Column, first_start: Column | int = 0
) -> Column:
    """0/1 per token: its end lies behind the part of the sentence before the completion.

    ``offsets`` are (start, end) character ranges. Causal layouts pass the start of the first token
    as ``first_start``.
    """
    shift = first_start if isinstance(first_start, Column) else F.lit(first_start)
    border = F.length(sentence) - F.length(completion) + shift
    return let(border, lambda b: F.transform(offsets, lambda o: (o["end"] > b).cast("int")))


def mask_each_position(
    items: DataFrame, mode: str, mask_id: int, tokens: str = "tokens", in_completion: str = "phrase_mask",
    has_bos: bool = True,
) -> DataFrame:
    """One row per completion token with that token masked.

    ``mlm`` predicts at the masked position, ``mntp`` one position earlier (the first token is
    skipped without a start token), ``enc_dec_mask`` in the second decoder position.
    """
    if mode not in ("mlm", "mntp", "enc_dec_mask"):
        raise ValueError(f"unknown mode {mode}")
    ids = F.col(tokens)
    at = {"mlm": F.col("position"), "mntp": F.col("position") - 1, "enc_dec_mask": F.lit(1)}[mode]
    rows = (
        items.select("*", F.posexplode_outer(in_completion).alias("position", "_chosen"))
        .where("_chosen = 1")
        .select(
            *items.columns, "position", at.alias("predict_at"), F.get(ids, F.col("position")).alias("target"),
            F.concat(
                F.slice(ids, F.lit(1), F.col("position")), F.array(F.lit(mask_id)),
                F.slice(ids, F.col("position") + 2, F.size(ids)),
            ).alias("masked"),
        )
    )
    if mode == "mntp" and not has_bos:
        rows = rows.where("position > 0")
    return rows


def prefix_target_layout(
    items: DataFrame, cls_id: int, mask_id: int, eos_id: int, bos_id: int,
    prefix: str = "prefix_tokens", completion: str = "completion_tokens",
) -> DataFrame:
    """Encoder [CLS] prefix [MASK] [EOS]; decoder [BOS] [MASK] completion without its last token."""
    empty = F.expr("cast(array() as array<int>)")
    done = F.col(completion)
    return items.withColumns(
        {
            "encoder": F.concat(
                F.array(F.lit(cls_id)), F.coalesce(prefix, empty), F.array(F.lit(mask_id), F.lit(eos_id))
            ),
            "decoder": F.concat(
                F.array(F.lit(bos_id), F.lit(mask_id)), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            ),
            "targets": done,
        }
    )


def append_masks(
    items: DataFrame, mask_id: int, k: int = 3, tokens: str = "tokens", shifted: bool = False,
    end_id: int | None = None,
) -> DataFrame:
    """Sentence, ``k`` masks and an optional end token; ``predict_at`` is the first mask.

    ``shifted`` layouts predict one position before the mask.
    """
    parts = [F.col(tokens), F.array_repeat(F.lit(mask_id), k)]
    if end_id is not None:
        parts.append(F.array(F.lit(end_id)))
    return items.withColumns(
        {"with_masks": F.concat(*parts), "predict_at": F.size(tokens) - (1 if shifted else 0)}
    )


def truncate(tokens: Column, max_length: int) -> Column:
    return F.slice(tokens, 1, max_length)
