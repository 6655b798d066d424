"""Groups of spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each leads to.

Bloom-guided neighbourhoods. The vocabulary fills a Bloom filter that is sharded by word length and blocked: a word sets PROBES bits of one
64-bit block of its length's shard. The filter is built by an aggregation and broadcast; it has BITS bits for each word, and
MOST_BLOCKS blocks at most, whatever the vocabulary (with more words it lets more false positives through, and stays exact after the join).
Every word then generates its deletions and its replacements by a later letter of the alphabet, as hashes only, and probes them:
of two near words one deletes its way to the other, or replaces by a later letter, so each pair is met from one side. Only what the filter
lets through becomes a string, is shuffled, and is joined with the vocabulary, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stored

# Letters of a word: the alphabet of replacements, as code points. The common ones stand last, as a letter is only replaced by later ones.
LETTERS = [*range(ord("A"), ord("Z") + 1), *range(0xC0, 0x100), *range(ord("a"), ord("z") + 1)]
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 24
PROBES = 5
# 32 MB of filter at most.
MOST_BLOCKS = 4_000_000
# Edits that are hashed at once.
EDITS = 2_000_000

_rng = np.random.default_rng(20240601)
_LETTER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ALPHABET = np.array(LETTERS, np.uint8)
_PLACE = np.zeros(256, np.int64)
_PLACE[_ALPHABET] = np.arange(len(LETTERS))
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(length: int) -> np.ndarray:
    return np.array([pow(_BASE, length - 1 - i, 2**64) for i in range(length)], np.uint64)


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points (all below 256) of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def hashes(letters: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each row."""
    return (_LETTER[letters] * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each hash in a shard of ``blocks`` blocks."""
    x = (h ^ (h >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    x ^= x >> np.uint64(31)
    mask = np.zeros(x.shape, np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), mask


def deletions(letters: np.ndarray) -> np.ndarray:
    """Hashes of every row without its i-th letter, in column i."""
    n, length = letters.shape
    value = _LETTER[letters]
    low, high = value * _powers(length), value * np.append(_powers(length - 1), np.uint64(0))
    behind = low[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1] - low
    return high.cumsum(axis=1, dtype=np.uint64) - high + behind


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Parts of bounded size of the words of each length."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, some in groups.items():
        step = max(1, EDITS // (length * len(LETTERS)))
        for i in range(0, len(some), step):
            yield length, some[i : i + step]


def _filter_bits(blocks: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words in _by_length(batch.column("word").to_pylist()):
                block, mask = places(hashes(codes(words, length)), blocks[length])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), length, np.int32)), pa.array(block), pa.array(mask.view(np.int64))], ["length", "block", "bits"])

    return run


def neighbours(words: list[str], length: int, held) -> tuple[list[str], list[str]]:
    """(word, edited): the deletions and later replacements of words of one length that the filter ``held(length, hashes)`` lets through."""
    letters = codes(words, length)
    own: list[str] = []
    found: list[str] = []
    dropped = held(length - 1, deletions(letters)) if length > 1 else np.zeros(letters.shape, bool)
    dropped[:, 1:] &= letters[:, 1:] != letters[:, :-1]  # of equal letters in a row the first one goes
    for w, i in zip(*np.nonzero(dropped)):
        own.append(words[w])
        found.append(words[w][:i] + words[w][i + 1 :])
    whole, powers = hashes(letters), _powers(length)
    for i in range(length):
        base = whole - _LETTER[letters[:, i]] * powers[i]
        later = len(LETTERS) - 1 - _PLACE[letters[:, i]]
        row = np.repeat(np.arange(len(words)), later)
        letter = _ALPHABET[len(LETTERS) - 1 - (np.arange(len(row)) - np.repeat(later.cumsum() - later, later))]
        hit = np.flatnonzero(held(length, base[row] + _LETTER[letter] * powers[i]))
        for w, c in zip(row[hit], letter[hit]):
            own.append(words[w])
            found.append(words[w][:i] + chr(c) + words[w][i + 1 :])
    return own, found


def _probe(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = filters.value

        def held(length: int, h: np.ndarray) -> np.ndarray:
            if length not in shards:
                return np.zeros(h.shape, bool)
            block, mask = places(h, len(shards[length]))
            return (shards[length][block] & mask) == mask

        for batch in batches:
            counts = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            for length, words in _by_length(list(counts)):
                own, found = neighbours(words, length, held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.string()), pa.array([counts[w] for w in own], pa.int64()), pa.array(found, pa.string())], ["word", "n", "other"]
                )

    return run


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair once, of the distinct words of the stored table ``vocabulary`` (word, n).

    Words are of letters below code point 256. Defined cases: no words, no pairs.
    """
    spark = vocabulary.sparkSession
    # one row for each length of a word; a word is at most as long as a text, and lengths that no word has cost nothing
    lengths = {r["length"]: r["words"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()}
    total = sum(lengths.values())
    share = min(BITS / 64, MOST_BLOCKS / max(total, 1))
    blocks = {length: max(1, int(n * share)) for length, n in lengths.items()}
    bits = vocabulary.select("word").mapInArrow(_filter_bits(blocks), "length int, block bigint, bits bigint")
    shards = {length: np.zeros(n, np.uint64) for length, n in blocks.items()}
    merged = stored(bits.groupBy("length", "block").agg(F.bit_or("bits").alias("bits")), "bloom").toArrow()
    length, block, mask = (merged.column(c).to_numpy() for c in ("length", "block", "bits"))
    for key, shard in shards.items():
        mine = length == key
        shard[block[mine]] = mask[mine].view(np.uint64)
    probed = vocabulary.select("word", "n").mapInArrow(_probe(spark.sparkContext.broadcast(shards)), "word string, n bigint, other string")
    known = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return probed.join(known, "other").select("word", "n", "other", "other_n")


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, misspelt: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``min_length`` letters and ``min_count`` occurrences in whole texts.

    Words are maximal runs of letters, A-Z lower-cased. With ``misspelt`` a run whose crc32 of `doc_id:run` it divides loses the
    code point at that number modulo the run's length.
    """
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    runs = docs.select("doc_id", F.explode_outer(found).alias("run")).where(F.length("run") >= min_length)
    word = F.col("run")
    if misspelt:
        h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
        at = F.pmod(h, F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.pmod(h, F.lit(misspelt)) == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the stored table ``forms`` (word, form): the last word of each chain of forms, by doubling the reach each round.

    A form has several times its word's occurrences, so there are no rings and chains are short.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, factor: int = 5, misspelt: int | None = None) -> DataFrame:
    """One row per word of the texts: word, n, n_near, form, form_n, root.

    n counts occurrences, n_near the near words; ``form`` is the near word of most occurrences (ties: the first in code-point order) if it has at least
    ``factor`` times the word's, else null; ``root`` follows the forms to the last one. Only the columns doc_id and text are read.
    Defined cases: null, empty and letterless texts have no words; every repeated row counts; a null doc_id reads as empty; an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(vocabulary(docs, min_length, min_count, misspelt), "vocabulary")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select("word", "n", "other", "other_n").union(pairs.select("other", "other_n", "word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    near = stored(
        near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "variants"
    )
    ends = roots(stored(near.where("form is not null").select("word", "form"), "forms"))
    return (
        words.join(near, "word", "left").join(ends, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )
