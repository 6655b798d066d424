"""Near-duplicates by a multi-index Hamming join of b-bit minhash signatures.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Its signature holds minima, cut to 16 bits each, and
falls into chunks of a few symbols. If two signatures differ in at most 2 * chunks - 1 places, some chunk differs in at most one
(pigeonhole), so both have a common key among those that leave out one symbol of that chunk. Every pair within that distance
is thus a candidate. ``layout`` chooses chunks and width by the threshold, so that a pair exactly at it lies beyond that distance
with a probability of at most MISS: 11 chunks of six at 0.85 (9.9 differing places on average, standard deviation 2.9), 14 of
five at 0.80 (14 on average, standard deviation 3.3).

Candidates are never listed pair by pair. The smallest set of each key bucket is its pivot and every member is tied to its
pivots only, which is linear in the number of keys. Ties are confirmed on the full sets. Members that their pivot does not
confirm (U) are compared with the other members (V) in blocks of bounded size inside a task, which returns only the links that
a spanning forest needs. Rows of confirmed groups, however large, are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stored, with_keys

WORDS = 5
MISS = 1.6e-4  # probability at most that a pair exactly at the threshold differs in more places than the keys cover
MOST_SYMBOLS = 72
WIDEST = 8


class Layout(NamedTuple):
    """Chunks of a signature and symbols of each."""

    chunks: int
    width: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def max_differ(self) -> int:
        return 2 * self.chunks - 1

    def miss(self, percent: int) -> float:
        """Probability that a pair of that similarity differs in more than ``max_differ`` symbols."""
        n, p = self.symbols, 1 - percent / 100
        return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(self.max_differ + 1, n + 1))


@lru_cache
def layout(percent: int) -> Layout:
    """The widest chunks (so the fewest accidental candidates), then the fewest of them, that miss at most MISS at the threshold."""
    for width in range(WIDEST, 1, -1):
        for chunks in range(1, MOST_SYMBOLS // width + 1):
            if Layout(chunks, width).miss(percent) <= MISS:
                return Layout(chunks, width)
    raise ValueError(f"no signature of {MOST_SYMBOLS} symbols covers {percent} percent")


CHUNKS, WIDTH = DEFAULT = layout(85)
SYMBOLS, MAX_DIFFER = DEFAULT.symbols, DEFAULT.max_differ
# A block of the comparison holds about so many sets and set members at most.
BLOCK_SETS = 512
BLOCK_MEMBERS = 1_000_000
MEMO_WORDS = 200_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240501)
_FACTOR = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_more = np.random.default_rng(20240502)
_FACTOR = np.append(_FACTOR, _more.integers(0, 2**63, MOST_SYMBOLS - SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_FLIP = np.append(_FLIP, _more.integers(0, 2**63, MOST_SYMBOLS - SYMBOLS, dtype=np.uint64))
_POWERS = [np.uint64(pow(int(_MULT), WORDS - 1 - i, 2**64)) for i in range(WORDS)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Memo of word hashes; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole UTF-8 text (A-Z lower-cased, ASCII white space).

    Fewer than WORDS words make one shingle of the whole sequence; no words make an empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        scaled = h * np.array(_POWERS[: len(h)], np.uint64)
        return mix(scaled.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(h) << 32))
    n = len(h) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for i in range(WORDS):
        s += h[i : i + n] * _POWERS[i]
    return np.unique(mix(s))


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set (as signed integers); equal sets have equal ids."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            total = s.sum(dtype=np.uint64, keepdims=True) * _MULT
            out[i] = mix(total ^ np.bitwise_xor.reduce(mix(s ^ _MIX1)) ^ np.uint64(len(s)))[0]
    return out.view(np.int64)


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """One row of 16-bit minima for each non-empty set."""
    out = np.empty((len(sets), symbols), np.uint16)
    start = 0
    while start < len(sets):  # about a quarter million members at a time
        end, members = start, 0
        while end < len(sets) and (end == start or members + len(sets[end]) <= 250_000):
            members += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        offsets = np.cumsum([0, *map(len, sets[start : end - 1])])
        for j in range(symbols):
            least = np.minimum.reduceat((flat ^ _FLIP[j]) * _FACTOR[j], offsets)
            out[start:end, j] = (least * _MIX2) >> np.uint64(48)
        start = end
    return out


def _signed(symbols: int, extra: tuple[str, ...] = ()):
    """doc_id, n_shingles, cid, sig and the ``extra`` columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sets = [shingles(t, memo) for t in part.column("text").cast(pa.binary()).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list[bytes | None] = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full], symbols)):
                    sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(class_ids(sets)), pa.array(sig, pa.binary()), *map(part.column, extra)],
                    ["doc_id", "n_shingles", "cid", "sig", *extra],
                )

    return run


def _keyed(batches: Iterator[pa.RecordBatch], shape: Layout = DEFAULT) -> Iterator[pa.RecordBatch]:
    """(key, cid) for every chunk and left-out symbol."""
    width = shape.width
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            cid = part.column("cid").to_numpy()
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, shape.symbols).astype(np.uint64)
            for c in range(shape.chunks):
                terms = [mix(sig[:, c * width + i] + np.uint64((c * width + i + 1) << 20)) for i in range(width)]
                whole = sum(terms[1:], terms[0])
                keys = np.concatenate([mix(whole - terms[i] + np.uint64((c * width + i) * 2 + 1)) for i in range(width)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(cid, width))], ["key", "cid"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            raw = part.column("text").cast(pa.binary())
            ids = class_ids([shingles(t, memo) for t in raw.to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(ids), raw], ["cid", "raw"])


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * common >= percent * (a + b - common)


def _confirm(percent: int):
    """Rows of a unit follow their pivot's row (``head``); each is compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        held = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for head, pivot, cid, raw in zip(*(batch.column(c).to_pylist() for c in ("head", "pivot", "cid", "raw"))):
                own = shingles(raw, memo)
                if head:
                    held = own
                    continue
                common = np.intersect1d(held, own, assume_unique=True).size
                out.append((pivot, cid, bool(similar(np.int64(common), np.int64(held.size), np.int64(own.size), percent))))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["pivot", "cid", "linked"]
            )

    return run


def block_links(u: np.ndarray, v: np.ndarray, sigs: np.ndarray, raws: list[bytes], percent: int, joined: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows u and rows v (indexes) that a spanning forest needs; ``joined`` holds the groups known so far.

    A pair is compared if ``rank`` of v is the larger one (members that the pivot confirmed rank last), so once.
    Signatures decide what is compared; intersections with all of v come from one pass over the postings of a set's members.
    """
    memo, most = WordHashes(), layout(percent).max_differ
    sets = {int(i): shingles(raws[i], memo) for i in np.union1d(u, v)}
    vs = [sets[int(i)] for i in v]
    sizes = np.array([len(s) for s in vs], np.int64)
    flat = np.concatenate(vs)
    owner = np.repeat(np.arange(len(v)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group = joined.copy()
    found = []
    for i in u:
        near = (sigs[i][None, :] != sigs[v]).sum(axis=1) <= most
        near &= (group[v] != group[i]) & (rank[v] > rank[i])
        if not near.any():
            continue
        own = sets[int(i)]
        lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        lens = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        common = np.bincount(owner[at], minlength=len(v))
        for k in np.flatnonzero(near & similar(common, np.int64(len(own)), sizes, percent)):
            if group[v[k]] != group[i]:
                group[group == group[v[k]]] = group[i]
                found.append((int(i), int(v[k])))
    return found


def _compare(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = np.flatnonzero(rows["side"].to_numpy() == 0), np.flatnonzero(rows["side"].to_numpy() == 1)
        if not len(u) or not len(v):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        cid = rows["cid"].to_numpy(np.int64)
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, layout(percent).symbols)
        # members that the pivot confirmed are one group; a set that is on both sides is one as well
        linked = rows["linked"].to_numpy(bool)
        _, group = np.unique(cid, return_inverse=True)
        group[linked] = -1
        rank = np.where(linked, np.iinfo(np.int64).max, cid)
        found = block_links(u, v, sigs, list(rows["raw"]), percent, group, rank)
        return pd.DataFrame([(cid[i], cid[k]) for i, k in found], columns=["a", "b"]).astype("int64")

    return run


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), by alternating large and small stars.

    Each round is two aggregations and is stored; rounds grow with the logarithm of the longest path. Nodes without an edge
    to another are left out. Empty edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        after = stored(small, name)
        same = now.exceptAll(after).isEmpty() and after.exceptAll(now).isEmpty()
        now = after
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, percent: int = 85, by_row: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable. Only the columns doc_id and text are read. Defined cases: a null or wordless text has an empty set and is
    linked with nothing; equal sets are one class and are compared once; repeated rows give repeated results; a row without
    doc_id takes part, but never names its component (component_id is null if no row of it has a doc_id, and all its rows
    are kept then). An empty table gives no rows. ``by_row`` adds row_key (xxhash64 of doc_id and text) and label, a number of the
    linked group (null for an empty set), which tell rows apart that share a doc_id.
    """
    spark, shape = docs.sparkSession, layout(percent)
    extra, added = (("row_key",), ("row_key", "label")) if by_row else ((), ())
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = source.withColumn("row_key", F.xxhash64("doc_id", "text")) if by_row else source
    schema = "doc_id bigint, n_shingles bigint, cid bigint, sig binary" + "".join(f", {c} bigint" for c in extra)
    signed = stored(hashed.mapInArrow(_signed(shape.symbols, extra), schema), "signatures")
    full = signed.where("n_shingles > 0")
    classes = stored(full.groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig")), "classes")

    keys = classes.select("cid", "sig").mapInArrow(lambda batches: _keyed(batches, shape), "key bigint, cid bigint")
    shared = keys.groupBy("key").agg(F.min("cid").alias("pivot"), F.max("cid").alias("_other")).where("pivot < _other").drop("_other")
    ties = keys.join(shared, "key").where("cid <> pivot").select("pivot", "cid").distinct()
    sides = classes.select(F.col("cid").alias("pivot"), F.col("sig").alias("sig_pivot"))
    ties = stored(ties.join(classes.select("cid", "sig", "n"), "cid").join(sides, "pivot"), "ties")

    # Texts of the sets that are tied to another, one text for each set.
    tied = ties.select("cid").union(ties.select("pivot")).distinct()
    picked = stored(classes.join(tied, "cid", "left_semi").select(F.col("first_id").alias("doc_id"), "cid"), "tied")
    texts = with_keys(source, picked, "doc_id").mapInArrow(_texts, "cid bigint, raw binary")
    texts = stored(texts.join(picked.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "texts")

    # Each tie against its pivot. A unit is a bounded part of a pivot's ties behind the pivot's own text.
    near = ties.where(_differing("sig", "sig_pivot", shape.symbols) <= shape.max_differ).select("pivot", "cid")
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("parts"))
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("cid"), F.lit(True).alias("head"))
    rows = near.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "cid", F.lit(False).alias("head"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = heads.unionByName(rows).join(texts, "cid").repartition(n, "pivot", "part").sortWithinPartitions("pivot", "part", F.col("head").desc())
    confirmed = stored(units.mapInArrow(_confirm(percent), "pivot bigint, cid bigint, linked boolean"), "confirmed")
    links = confirmed.where("linked").select("pivot", "cid")

    # Members that the pivot did not confirm, against all other members, in blocks.
    flagged = stored(
        ties.join(links.withColumn("_linked", F.lit(True)), ["pivot", "cid"], "left")
        .select("pivot", "cid", "sig", "n", F.coalesce("_linked", F.lit(False)).alias("linked")), "members",
    )
    blocks = lambda rows, members: F.ceil(F.greatest(rows / BLOCK_SETS, members / BLOCK_MEMBERS)).cast("int")
    apart = F.when(~F.col("linked"), F.lit(1)).otherwise(F.lit(0))
    sizes = (
        flagged.groupBy("pivot").agg(F.count(F.lit(1)).alias("nv"), F.sum("n").alias("mv"), F.sum(apart).alias("nu"), F.sum(apart * F.col("n")).alias("mu"))
        .where("nu >= 1 and nv >= 2").select("pivot", blocks(F.col("nu"), F.col("mu")).alias("ub"), blocks(F.col("nv"), F.col("mv")).alias("vb"))
    )
    sized = flagged.join(sizes, "pivot").withColumn("_h", F.xxhash64("cid"))
    own = lambda n: F.pmod(F.col("_h"), n).cast("int")
    as_u = sized.where("not linked").select("pivot", own(F.col("ub")).alias("u"), F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("v"), "cid", "sig", "linked", F.lit(0).alias("side"))
    as_v = sized.select("pivot", F.explode(F.sequence(F.lit(0), F.col("ub") - 1)).alias("u"), own(F.col("vb")).alias("v"), "cid", "sig", "linked", F.lit(1).alias("side"))
    units = as_u.unionByName(as_v).join(texts, "cid")
    more = units.repartition(n, "pivot", "u", "v").groupBy("pivot", "u", "v").applyInPandas(_compare(percent), "a bigint, b bigint")

    edges = links.select(F.col("pivot").alias("a"), F.col("cid").alias("b")).union(more)
    labels = components(edges)
    member = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "first_id", F.coalesce("label", "cid").alias("label"))
    smallest = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stored(member.join(smallest, "label").select("cid", "component_id", "label"), "named")
    in_class = full.select("doc_id", "n_shingles", "cid", *extra).join(named, "cid").select("doc_id", "n_shingles", "component_id", *added)
    alone = signed.where("n_shingles = 0").withColumn("label", F.lit(None).cast("bigint")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *added)
    return in_class.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _differing(a: str, b: str, symbols: int):
    """Number of 16-bit symbols in which two signatures differ."""
    at = lambda c, i: F.hex(F.substring(F.col(c), i * 2 + 1, 2))
    total = F.lit(0)
    for i in range(symbols):
        total = total + (at(a, i) != at(b, i)).cast("int")
    return total
