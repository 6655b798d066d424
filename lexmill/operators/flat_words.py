"""Many words at once, as one flat array of symbols and the size of every word, in Arrow and numpy."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

# Longer words are merged one by one, as a pass over all words costs as many rounds as the longest one has merges.
LONG = 1000
_SHIFT = 32


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes of the lists of an Arrow array without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of the words of an Arrow array of binaries without nulls."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    return values, np.diff(offsets)


def lists_of(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


def _keys(a, b) -> np.ndarray:
    return (np.asarray(a, np.int64) << _SHIFT) | np.asarray(b, np.int64)


def _pairs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the pair that begins at every symbol, and whether there is one: the last symbol of a word begins none."""
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(sizes)[sizes > 0] - 1] = False
    return _keys(ids, np.append(ids[1:], 0)), inner


class PairTable:
    """Pairs of symbols with their places in a list, looked up for arrays of keys."""

    def __init__(self, pairs):
        pairs = np.asarray(list(pairs), np.int64).reshape(-1, 2)
        keys = _keys(pairs[:, 0], pairs[:, 1])
        self.none = len(keys)
        self.place = np.argsort(keys, kind="stable")
        self.keys = keys[self.place]

    def places(self, keys: np.ndarray, inner: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.none, np.int64)
        if self.none:
            asked = np.flatnonzero(inner)
            at = np.minimum(np.searchsorted(self.keys, keys[asked]), self.none - 1)
            hit = self.keys[at] == keys[asked]
            out[asked[hit]] = self.place[at[hit]]
        return out


def pair_counts(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) with the sum of the counts ``n`` of the words they stand in, once for each occurrence."""
    keys, inner = _pairs(ids, sizes)
    keys, weights = keys[inner], np.repeat(n, np.maximum(sizes - 1, 0))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    totals = np.add.reduceat(weights, starts) if len(keys) else np.zeros(0, np.int64)
    return keys[starts] >> _SHIFT, keys[starts] & ((1 << _SHIFT) - 1), totals


def cut_apart(ids: np.ndarray, sizes: np.ndarray, inside: PairTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of at least two symbols whose neighbouring pairs are all in ``inside``: symbols, sizes, and the word of every run."""
    hit = inside.places(*_pairs(ids, sizes)) < inside.none
    before = np.append(False, hit[:-1]) if len(hit) else hit
    covered = hit | before
    first = np.flatnonzero(hit & ~before)
    last = np.flatnonzero(before & ~hit)
    return ids[covered], last - first + 1, np.repeat(np.arange(len(sizes)), sizes)[first]


def merged(ids: np.ndarray, sizes: np.ndarray, ranks: PairTable, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and sizes after all merges: in every word always the pair of the lowest rank, the leftmost first; rank r makes the symbol ``first`` + r.

    A round merges all pairs of the lowest rank of every word, as they are next to each other only if their symbols are equal.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    out_ids, out_word = [], []
    if len(sizes) and sizes.max() > LONG:
        long = np.flatnonzero(sizes > LONG)
        ends = np.cumsum(sizes)
        known = {(int(k >> _SHIFT), int(k & ((1 << _SHIFT) - 1))): int(r) for k, r in zip(ranks.keys, ranks.place)}
        for w in long:
            done = merged_ids(ids[ends[w] - sizes[w] : ends[w]].tolist(), known, first)
            out_ids.append(np.asarray(done, np.int64))
            out_word.append(np.full(len(done), w))
        short = ~np.isin(word, long)
        ids, word = ids[short], word[short]
    while len(ids):
        inner = np.append(word[1:] == word[:-1], False)
        place = ranks.places(_keys(ids, np.append(ids[1:], 0)), inner)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.repeat(np.minimum.reduceat(place, starts), np.diff(np.append(starts, len(ids))))
        active = least < ranks.none
        out_ids.append(ids[~active])
        out_word.append(word[~active])
        ids, word, place, least = ids[active], word[active], place[active], least[active]
        at = np.flatnonzero(place == least)
        if not len(at):
            break
        # of equal symbols in a row, pairs overlap: every other one from the left is merged
        begins = np.append(True, at[1:] != at[:-1] + 1)
        run = at[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        at = at[(at - run) % 2 == 0]
        ids[at] = first + place[at]
        kept = np.ones(len(ids), bool)
        kept[at + 1] = False
        ids, word = ids[kept], word[kept]
    if not out_ids:
        return ids, sizes
    ids, word = np.concatenate(out_ids), np.concatenate(out_word)
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


def merged_ids(ids: list[int], ranks: dict[tuple[int, int], int], base: int) -> list[int]:
    """``ids`` after all merges: always the pair of the lowest rank, the leftmost first, becomes the id base + rank.

    The pairs wait in a heap and the ids in a linked list, so n ids take n log n steps. An entry whose pair has changed since is passed over;
    a merge makes only pairs of higher ranks, as they hold the id it has made.
    """
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
    heapq.heapify(heap)
    gone = -1
    while heap:
        rank, i = heapq.heappop(heap)
        k = right[i]
        if k >= n or ranks.get((ids[i], ids[k])) != rank:
            continue
        ids[i], ids[k], after, before = base + rank, gone, right[k], left[i]
        right[i] = after
        if after < n:
            left[after] = i
        for at, to in ((before, i), (i, after)):
            if at >= 0 and to < n and (ids[at], ids[to]) in ranks:
                heapq.heappush(heap, (ranks[ids[at], ids[to]], at))
    return [x for x in ids if x != gone]
