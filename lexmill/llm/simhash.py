"""Near-duplicates by SimHash fingerprints, whose close pairs are found with vantage-point trees.

A fingerprint has 64 bits; bit b is one if bit b is set in over half of the hashes of a text's shingles (repeats included). Equal
fingerprints are one class. Two fingerprints link if they differ in at most ``radius`` bits.

A first vantage-point tree, fitted on a bounded sample of fingerprints, deals all of them into shards: a node holds a
fingerprint of the data and a Hamming distance, what lies within it goes to the inner branch and the rest to the outer one. A
fingerprint at distance d from the vantage point can have a partner in the inner branch only if d - radius is within the
distance, and in the outer one only if d + radius is beyond it. So it lives in one shard and visits every later shard that these
bounds leave (a pair meets in the later shard of the two). The sample decides how even the shards are, never what is found.

Within a shard the same bounds drive a second tree down to leaves of LEAF fingerprints, which are compared bit by bit. A
vantage point links with all that lies within the radius around it; what is known to be connected is not compared again, so a
dense group of any size costs about its number of vantage points. A task returns the links of a spanning forest only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stored
from lexmill.llm.minhash import components

SHINGLE = 4
SEED = 42
RADIUS = 4
# Fingerprints (8 bytes) of one shard; visitors of a unit; fingerprints of a leaf; pairs that are compared at once.
SHARD_ROWS = 32_768
UNIT_VISITORS = 262_144
LEAF = 1024
BLOCK = 262_144
# The sample that the first tree is fitted on, and the number of its shards at most (so 16 sampled fingerprints for each).
SAMPLE = 65_536
MOST_SHARDS = 4096
CANDIDATES = 8
# A class with more than this share of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a whole UTF-8 text; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, total, 100_000):
        upto = min(at + 100_000, total)
        pieces = map(line.__getitem__, map(slice, starts[at:upto].tolist(), ends[at + SHINGLE - 1 : upto + SHINGLE - 1].tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), "<u8", upto - at).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            ones[8 * i : 8 * i + 8] += np.bincount(hashes[:, i], minlength=256) @ _BITS
    return sum(1 << b for b in range(64) if 2 * int(ones[b]) > total)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            prints = np.fromiter(map(fingerprint, part.column("text").cast(pa.binary()).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Hamming distances of unsigned 64-bit arrays (broadcast against each other)."""
    return np.bitwise_count(a ^ b)


def vantage(members: np.ndarray, pool: np.ndarray) -> tuple[np.uint64, int, np.ndarray]:
    """Of a few candidates from ``pool`` the one whose distances to ``members`` spread most, their median, and the distances."""
    best = None
    for v in pool[np.linspace(0, len(pool) - 1, min(CANDIDATES, len(pool))).astype(int)]:
        d = distances(members, v)
        middle = int(np.median(d))
        spread = float(np.var(d))
        if best is None or spread > best[0]:
            best = (spread, v, middle, d)
    return best[1], best[2], best[3]


class Tree(NamedTuple):
    """Flat nodes: vantage point, distance of the inner branch, and the two children; a child below zero is shard -1 - child."""

    point: np.ndarray
    within: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    shards: int


def fit(sample: np.ndarray, shards: int) -> Tree:
    """A tree with about ``shards`` leaves, each for an equal part of the sample."""
    nodes: list[list[int]] = []
    count = 0

    def grow(part: np.ndarray, leaves: int) -> int:
        nonlocal count
        if leaves > 1 and len(part) > 1:
            v, middle, d = vantage(part, part)
            near = d <= middle
            if near.all():  # the median is the largest distance: the inner branch ends one before it
                middle -= 1
                near = d <= middle
            if near.any():
                at = len(nodes)
                nodes.append([int(v), middle, 0, 0])
                mine = min(max(round(leaves * float(near.mean())), 1), leaves - 1)
                nodes[at][2] = grow(part[near], mine)
                nodes[at][3] = grow(part[~near], leaves - mine)
                return at
        count += 1
        return -count

    grow(np.sort(sample), shards)
    table = np.array(nodes, object).reshape(-1, 4)
    return Tree(table[:, 0].astype(np.uint64), *(table[:, i].astype(np.int64) for i in (1, 2, 3)), count)


def route(tree: Tree, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of each fingerprint's home and of the later shards that the triangle bounds do not rule out."""
    home = np.zeros(len(prints), np.int64)
    rows, shards = [], []
    stack = [(0 if len(tree.point) else -1, np.arange(len(prints)), np.ones(len(prints), bool))]
    while stack:
        node, who, own = stack.pop()
        if not len(who):
            continue
        if node < 0:
            home[who[own]] = -1 - node
            rows.append(who)
            shards.append(np.full(len(who), -1 - node))
            continue
        d = distances(prints[who], tree.point[node]).astype(np.int64)
        t = tree.within[node]
        for child, stays, reaches in ((tree.inner[node], d <= t, d - radius <= t), (tree.outer[node], d > t, d + radius > t)):
            stack.append((int(child), who[reaches], (own & stays)[reaches]))
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    shard = np.concatenate(shards) if shards else np.empty(0, np.int64)
    keep = shard >= home[row]
    row, shard = row[keep], shard[keep]
    return row, shard, shard == home[row]


def _routed(tree: Tree, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                prints = part.column("print").to_numpy().view(np.uint64)
                row, shard, home = route(tree, prints, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(prints[row].view(np.int64)), pa.array(home)], ["shard", "print", "home"])

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of an ascending array with the start and end of each one's run."""
    names, starts = np.unique(values, return_index=True)
    return names, starts, np.append(starts[1:], len(values))


class _Groups:
    """Connected rows: every row carries the number of its group; the smaller group takes the other's number."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.rows = {}
        self.links: list[tuple[int, int]] = []

    def join(self, at: int, others: np.ndarray) -> None:
        """Row ``at`` is linked with ``others``; one link of each group that it was not connected with is kept."""
        for other in others[np.unique(self.label[others], return_index=True)[1]]:
            own, g = self.label[at], self.label[other]
            if g == own:
                continue
            self.links.append((at, int(other)))
            a, b = self.rows.pop(int(own), None), self.rows.pop(int(g), None)
            a = np.array([own]) if a is None else a
            b = np.array([g]) if b is None else b
            keep, go = (own, b) if len(a) >= len(b) else (g, a)
            self.label[go] = keep
            self.rows[int(keep)] = np.concatenate([a, b])


def forest(prints: np.ndarray, members: np.ndarray, asking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indexes into ``prints``) that connect every asking row with all members within the radius; a spanning forest of them."""
    groups = _Groups(len(prints))
    label = groups.label

    def compare(m: np.ndarray, q: np.ndarray) -> None:
        own, step = prints[m][None, :], max(1, BLOCK // len(m))
        for i in range(0, len(q), step):
            some = q[i : i + step]
            row, column = np.nonzero(distances(prints[some][:, None], own) <= radius)
            apart = label[some[row]] != label[m[column]]
            row, column = row[apart], column[apart]
            for k, first, last in zip(*_runs(row)):
                groups.join(int(some[k]), m[column[first:last]])

    stack = [(members, asking, 0)]
    while stack:
        m, q, idle = stack.pop()
        if not len(m) or not len(q):
            continue
        lm, lq = label[m], label[q]
        if lm[0] == lq[0] and (lm == lm[0]).all() and (lq == lm[0]).all():
            continue  # all connected
        if len(m) * len(q) <= LEAF * LEAF or len(m) <= 16 or len(q) <= 16:
            compare(m, q)
            continue
        names, counts = np.unique(lm, return_counts=True)
        big = names[counts.argmax()]
        mb, qb = lm == big, lq == big
        if mb.mean() > 0.25 and qb.mean() > 0.25 and mb.sum() * qb.sum() > LEAF * LEAF:
            # one group holds much of both sides: its own pairs are left out
            stack += [(m[~mb], q, idle), (m[mb], q[~qb], idle)]
            continue
        v, middle, dm = vantage(prints[m], prints[m])
        middle = min(middle, int(dm.max()) - 1)  # distinct fingerprints: both branches have members, so each step has fewer
        dq = distances(prints[q], v).astype(np.int64)
        at = int(m[np.flatnonzero(dm == 0)[0]])
        near = np.concatenate([m[dm <= radius], q[dq <= radius]])
        groups.join(at, near)
        dm = dm.astype(np.int64)
        sides = [(dm <= middle, dq - radius <= middle), (dm > middle, dq + radius > middle)]
        kept = sum(int(a.sum()) * int(b.sum()) for a, b in sides)
        # without progress for a few vantage points: compared in blocks
        idle = idle + 1 if kept > 0.97 * len(m) * len(q) and len(near) < 3 else 0
        if idle > 4:
            compare(m, q)
            continue
        stack += [(m[a], q[b], idle) for a, b in sides]
    return groups.links


def _linked(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        prints = rows["print"].to_numpy(np.int64).view(np.uint64)
        home, own = rows["home"].to_numpy(bool), rows["asks"].to_numpy(bool)
        found = forest(prints, np.flatnonzero(home), np.flatnonzero(own), radius)
        signed = prints.view(np.int64)
        return pd.DataFrame({"a": [signed[i] for i, _ in found], "b": [signed[k] for _, k in found]}, dtype="int64")

    return run


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of the stored table ``classes`` (print bigint) that connect all within the radius."""
    spark = classes.sparkSession
    total = classes.count()
    shards = max(1, min(MOST_SHARDS, -(-total // SHARD_ROWS)))
    sample = np.empty(0, np.uint64)
    if shards > 1:
        share = min(1.0, 1.2 * SAMPLE / total)
        order = F.xxhash64("print", F.lit("sample"))
        low = classes.where(F.pmod(order, F.lit(2**20)) < F.lit(int(share * 2**20) + 1)).select("print", order.alias("_o")).orderBy("_o").limit(SAMPLE)
        sample = np.array([r["print"] for r in low.collect()], np.int64).view(np.uint64)
    tree = fit(sample, shards)
    routed = classes.select("print").mapInArrow(_routed(tree, radius), "shard int, print bigint, home boolean")
    # one row of counts for each shard, MOST_SHARDS at most
    sizes = stored(routed.groupBy("shard").agg(F.ceil(F.count_if(~F.col("home")) / UNIT_VISITORS).cast("int").alias("blocks")), "shards")
    dealt = routed.join(F.broadcast(sizes), "shard").withColumn("blocks", F.greatest("blocks", F.lit(1)))
    visiting = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    at = F.when(F.col("home"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(visiting))
    units = dealt.select("shard", F.explode(at).alias("block"), "print", "home").withColumn("asks", ~F.col("home") | (F.col("block") == 0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "shard", "block").groupBy("shard", "block").applyInPandas(_linked(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable).

    Only the columns doc_id and text are read. Defined cases: a null, empty or wordless text has fingerprint zero and is linked like
    any other; equal fingerprints are one class; repeated rows give repeated results; a row without doc_id takes part but never
    names its component (component_id is null if no row of it has a doc_id). An empty table gives no rows.
    """
    signed = stored(docs.select("doc_id", "text").mapInArrow(_printed, "doc_id bigint, print bigint"), "prints")
    classes = stored(signed.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "print-classes")
    labels = components(links(classes, radius), "print-edges")
    member = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "first_id", "n", F.coalesce("label", "print").alias("label"))
    smallest = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # a component holds many classes, not many rows of one class: the join is on numbers of distinct fingerprints
    named = stored(member.join(smallest, "label").select("print", "n", "component_id"), "print-names")
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("n") * HOT > total).select("print", "component_id"))
    rest = named.where(F.col("n") * HOT <= total).select("print", "component_id")
    common = signed.join(hot, "print")
    rare = signed.join(hot, "print", "left_anti").join(rest, "print")
    return common.unionByName(rare).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
