"""Packing token sequences by length patterns.

Documents become token ids; those over the limit are cut into full pieces, of which the first may be shorter. Lengths below the
limit are packed from their histogram, which has at most ``limit`` entries: all patterns of two or three lengths that fill a
sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares, rounded without
exceeding what is there, and the residual is packed by best fit on the histogram. The number of patterns is bounded by
limit^2 / 12, whatever the corpus. Each piece then finds its sequence from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import slots, stored

END = 2
ITERATIONS = 400
ROUND_UP = 0.25  # fractions of a repeat count from here on become one repeat; the rest is left to best fit
_TOKENIZERS: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how the byte-level vocabulary cuts a text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, for a byte-level vocabulary file of the ``tokenizers`` library.

    If the file's merges are in the order of their ids, the same vocabulary is used as ranks of ``tiktoken``, which gives the same
    ids in a fifth of the time. ``added``: strings of the file's added tokens become those tokens, as in ``tokenizers`` by
    default, and texts that hold one go through ``tokenizers``; else they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        layout = json.loads(self.tokenizer.to_str())
        model, cut_by = layout["model"], layout["pre_tokenizer"] or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        vocabulary = model.get("vocab", {})
        ranked = [vocabulary.get(m, -1) for m in merges]
        plain = cut_by.get("type") == "ByteLevel" and cut_by.get("use_regex") and not cut_by.get("add_prefix_space") and not layout["normalizer"]
        self.fast = None
        self.added = [t["content"] for t in layout["added_tokens"]] if added else []
        if plain and ranked == sorted(ranked) and min(ranked, default=-1) >= 256:
            import tiktoken

            letters, special = _byte_letters(), {t["content"] for t in layout["added_tokens"]}
            ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
            self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        fast = self.fast and not any(t in text for t in self.added)
        ids = self.fast.encode_ordinary(text) if fast else self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()


def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder of each kind for each Python process."""
    if (path, added) not in _TOKENIZERS:
        _TOKENIZERS[path, added] = Encoder(path, added)
    return _TOKENIZERS[path, added]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one, or full ones behind a first one that takes the remainder."""
    if n <= limit:
        return [(0, n)]
    first = n % limit
    return ([(0, first)] if first else []) + [(i, limit) for i in range(first, n, limit)]


def _pieces(path: str, limit: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, added)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                out = []
                for doc_id, own, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "own", "text"))):
                    ids = enc.encode(text or "") + end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, limit)):
                        out.append((doc_id, own, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "own", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(limit: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths a >= b >= c (c may be 0) with a + b + c = limit, all of them present."""
    a = np.arange(1, limit)
    two = np.stack([a, limit - a, np.zeros_like(a)], 1)[a >= limit - a]
    rows = [two]
    for c in range(1, limit // 3 + 1):
        b = np.arange(c, (limit - c) // 2 + 1)
        rows.append(np.stack([limit - c - b, b, np.full_like(b, c)], 1))
    every = np.concatenate(rows)
    ok = present.copy()
    ok[0] = True
    return every[ok[every].all(axis=1)]


def fit_counts(columns: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts x that bring sum(x * pattern) near the histogram in least squares (accelerated projected gradient)."""
    n = len(histogram)
    x = np.zeros(len(columns))
    if not len(columns):
        return x
    flat, inside = columns.ravel(), (columns > 0).astype(float)

    def gradient(y: np.ndarray) -> np.ndarray:
        made = np.bincount(flat, weights=np.repeat(y, 3), minlength=n)
        made[0] = 0
        return ((made - histogram)[columns] * inside).sum(axis=1)

    # the largest eigenvalue of A'A by power iteration
    v = np.ones(len(columns))
    for _ in range(20):
        made = np.bincount(flat, weights=np.repeat(v, 3), minlength=n)
        made[0] = 0
        v = (made[columns] * inside).sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    y, t, step = x, 1.0, 1.0 / (1.05 * norm)
    for _ in range(iterations):
        after = np.maximum(y - step * gradient(y), 0.0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(histogram: np.ndarray, limit: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """Patterns (lengths, longest first) and their repeat counts; together they hold the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    shapes: list[tuple[int, ...]] = []
    repeats: list[int] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            shapes.append(lengths)
            repeats.append(int(times))
            for n in lengths:
                left[n] -= times

    def available(lengths: tuple[int, ...]) -> int:
        return min(int(left[n]) // lengths.count(n) for n in lengths)

    take((limit,), int(left[limit]))
    columns = patterns(limit, left > 0)
    x = fit_counts(columns, np.where(np.arange(limit + 1) < limit, left, 0).astype(float))
    shaped = [tuple(int(n) for n in row if n) for row in columns]
    for i in np.argsort(-x, kind="stable"):  # whole parts first
        if x[i] < 1:
            break
        take(shaped[i], min(int(x[i]), available(shaped[i])))
    for i in np.argsort(-(x - np.floor(x)), kind="stable"):  # then the larger fractions, one repeat each
        if x[i] - np.floor(x[i]) < ROUND_UP:
            break
        take(shaped[i], min(1, available(shaped[i])))
    # The residual by best fit: the longest length left, filled with the longest that fits, repeated while the counts allow.
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        chosen, room = [longest], limit - longest
        trial = left.copy()
        trial[longest] -= 1
        while room > 0:
            fits = np.flatnonzero(trial[1 : room + 1])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            chosen.append(n)
            trial[n] -= 1
            room -= n
        take(tuple(chosen), available(tuple(chosen)))
    return shapes, repeats


class Placement:
    """Where the r-th piece of each length goes: arrays whose size depends on the patterns only."""

    def __init__(self, shapes: list[tuple[int, ...]], repeats: list[int], limit: int):
        first = np.concatenate([[0], np.cumsum(repeats)]).astype(np.int64) if repeats else np.zeros(1, np.int64)
        at: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]
        for k, lengths in enumerate(shapes):
            offset = 0
            for n in lengths:
                at[n].append((repeats[k], int(first[k]), offset))
                offset += n
        self.ends = [np.cumsum([r for r, _, _ in rows]) for rows in at]
        self.first = [np.array([f for _, f, _ in rows], np.int64) for rows in at]
        self.offset = [np.array([o for _, _, o in rows], np.int64) for rows in at]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            ends = self.ends[n]
            k = np.searchsorted(ends, rank[rows], "right")
            before = np.concatenate([[0], ends[:-1]])[k]
            sequence[rows] = self.first[n][k] + rank[rows] - before
            offset[rows] = self.offset[n][k]
        return sequence, offset


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 1024, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text, then id 2; with ``added`` strings of added tokens are those tokens. Defined cases: a null or empty text is the one id 2; repeated rows are
    packed one by one; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    own = F.xxhash64("doc_id", "text", F.lit("pack"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), own.alias("own"), "text")
    schema = "doc_id bigint, own bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stored(source.mapInArrow(_pieces(tokenizer_path, limit, added), schema), "pieces")
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``limit`` rows
    histogram = np.zeros(limit + 1, np.int64)
    for r in counted:
        histogram[r["length"]] = r["n"]
    shapes, repeats = plan(histogram, limit)
    where = spark.sparkContext.broadcast(Placement(shapes, repeats, limit))
    ranked = slots(pieces, "length", F.xxhash64("own", "piece", F.lit("rank")), name="rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = where.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*names).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
