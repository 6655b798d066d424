"""Rank correlation of two similarity matrices over all pairs of their rows, without a row for any pair.

Pairs exist only inside a task: two blocks of vectors make a tile of products. Similarities are taken to ``digits`` decimals, so a
rank is a function of one of 2 * 10**digits + 1 values. The first pass counts these values over all tiles, the second one looks
up mean ranks and sums their products. Shuffled are blocks of vectors and counts of values; what is broadcast is the table of
ranks, whose size depends on ``digits`` alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.session import cut_lineage, python_partitions

# Vectors of a block; rows of a block that are multiplied at once; least vectors of a block when small inputs are spread over the cores.
BLOCK_ROWS = 8192
STRIP = 256
LEAST_ROWS = 128
# 2 * 10**7 + 1 ranks of 8 bytes are 160 MB for each side.
MOST_DIGITS = 7
CHUNK = 4096


def _units(df: DataFrame, on: str, vector: str, name: str) -> DataFrame:
    """Unit vectors; those that are null, hold a null, or have no positive finite length are left out."""
    v = nm.as_doubles(F.col(vector))
    square = nm.dot(v, v)
    return df.where((square > 0) & (square < float("inf"))).select(on, nm.unit(v).alias(name))


def _vectors(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).flatten().to_numpy().reshape(len(p), -1) for p in parts])


def _each_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of one tile after the other, from rows sorted by tile."""
    parts, current = [], None
    for batch in batches:
        tile = np.stack([batch.column(c).to_numpy() for c in ("lo", "hi")], axis=1)
        starts = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(axis=1))) if len(tile) else []
        for start, end in zip(starts, [*starts[1:], len(tile)]):
            if parts and current != tuple(tile[start]):
                yield parts
                parts = []
            current = tuple(tile[start])
            parts.append(batch.slice(start, end - start))
    if parts:
        yield parts


def _values(parts: list[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of both similarities in the list of values, for the pairs of a tile, a strip at a time."""
    u, v = _vectors(parts, "u"), _vectors(parts, "v")
    first = np.concatenate([p.column("first").to_numpy(zero_copy_only=False) for p in parts])
    diagonal = parts[0].column("lo")[0] == parts[0].column("hi")[0]
    left = np.arange(len(first)) if diagonal else np.flatnonzero(first)
    right = left if diagonal else np.flatnonzero(~first)
    sides = [(m[left], m[right]) for m in (u, v)]
    for i in range(0, len(left), STRIP):
        strip = []
        for mine, others in sides:
            x = mine[i : i + STRIP] @ (others[i:] if diagonal else others).T
            x = x[np.triu(np.ones(x.shape, bool), 1)] if diagonal else x.ravel()
            # in place, as fresh arrays of this size cost more than the arithmetic
            x *= scale
            np.clip(np.rint(x, out=x), -scale, scale, out=x)
            x += scale
            strip.append(x.astype(np.int64))
        yield tuple(strip)


def _counts(scale: int):
    """Counts of the values of all tiles of a task, so what is shuffled does not grow with the tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, -(-(2 * scale + 1) // CHUNK) * CHUNK), np.int64)
        for parts in _each_tile(batches):
            for strip in _values(parts, scale):
                for side in (0, 1):
                    if len(strip[side]) >= scale // 4:
                        n = np.bincount(strip[side])
                        counts[side, : len(n)] += n
                    else:
                        np.add.at(counts[side], strip[side], 1)
        pieces = counts.reshape(2, -1, CHUNK)
        for side, chunk in zip(*np.nonzero(pieces.any(axis=2))):
            n = pa.ListArray.from_arrays([0, CHUNK], pa.array(pieces[side, chunk]))
            yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([chunk], pa.int32()), n], ["side", "chunk", "n"])

    return run


def _total(rows: pa.Table) -> pa.Table:
    n = rows["n"].combine_chunks().flatten().to_numpy().reshape(-1, CHUNK).sum(axis=0)
    total = pa.ListArray.from_arrays([0, CHUNK], pa.array(n))
    return pa.table([rows["side"][:1].combine_chunks(), rows["chunk"][:1].combine_chunks(), total], ["side", "chunk", "n"])


def _products(ranks, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ranks.value
        for parts in _each_tile(batches):
            xy = math.fsum(float(a[s] @ b[t]) for s, t in _values(parts, scale))
            yield pa.RecordBatch.from_arrays([pa.array([xy])], ["xy"])

    return run


def _centred_ranks(n: np.ndarray, pairs: int) -> tuple[np.ndarray, float, float]:
    """Mean rank of every value less the middle, as a share of ``pairs``; the sum of their squares; that of ranks within the values."""
    n = n.astype(float)
    ranks = (np.cumsum(n) - n / 2 - pairs / 2) / pairs
    return ranks, float(n @ ranks**2), float(n @ (n * n - 1)) / 12 / pairs / pairs


def _tiles(joined: DataFrame, on: str, blocks: int) -> DataFrame:
    own: Column = F.pmod(F.xxhash64(on), F.lit(blocks)).cast("int")
    each = joined.select("u", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    lo, hi = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    return python_partitions(each.select(lo, hi, (F.col("own") <= F.col("other")).alias("first"), "u", "v"), "lo", "hi").sortWithinPartitions("lo", "hi")


def rsa_spearman_vectors(
    a: DataFrame, b: DataFrame, on: str = "vec_id", vector: str = "embedding", digits: int = 6, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row (rho, n_pairs, error): Spearman correlation, over all pairs, of the cosine similarities in ``a`` and in ``b``.

    Ids are unique in both tables; the vectors of a table have one length. Ranks are exact, with mean ranks for ties, for similarities of
    ``digits`` decimals; ``error`` bounds the distance to the correlation of the unrounded ones (ranks within a value
    have the mean rank as their mean, so their squared deviations are known and the inner products bounded by them). Ids that one
    table lacks, or whose vector has no positive finite length, take no part. Without two ids, or if one side has a single value, rho is NaN.
    """
    if not 1 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits must be 1 to {MOST_DIGITS}")
    spark, scale = a.sparkSession, 10**digits
    joined = cut_lineage(_units(a, on, vector, "u").join(_units(b, on, vector, "v"), on))
    rows = joined.count()
    pairs, nan = rows * (rows - 1) // 2, float("nan")
    schema = "rho double, n_pairs bigint, error double"
    if pairs == 0:
        return spark.createDataFrame([(nan, 0, nan)], schema)
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-rows // block_rows), min(-(-rows // LEAST_ROWS), math.isqrt(2 * cores) + 1))
    tiles = _tiles(joined, on, blocks)
    counted = tiles.mapInArrow(_counts(scale), "side int, chunk int, n array<bigint>")
    # at most 2 * (2 * 10**digits + 1) counts, however many pairs there are
    found = python_partitions(counted, "side", "chunk").groupBy("side", "chunk").applyInArrow(_total, counted.schema).toArrow()
    n = np.zeros((2, -(-(2 * scale + 1) // CHUNK), CHUNK), np.int64)
    n[found["side"].to_numpy(), found["chunk"].to_numpy()] = found["n"].combine_chunks().flatten().to_numpy().reshape(-1, CHUNK)
    n = n.reshape(2, -1)[:, : 2 * scale + 1]
    (ra, xx, ea), (rb, yy, eb) = _centred_ranks(n[0], pairs), _centred_ranks(n[1], pairs)
    if xx == 0 or yy == 0:
        return spark.createDataFrame([(nan, pairs, nan)], schema)
    ranks = spark.sparkContext.broadcast((ra, rb))
    xy = tiles.mapInArrow(_products(ranks, scale), "xy double").agg(F.sum("xy")).first()[0]
    size, ea, eb = math.sqrt(xx * yy), math.sqrt(ea), math.sqrt(eb)
    off = (math.sqrt(xx) * eb + ea * math.sqrt(yy) + ea * eb) / size
    rho = xy / size
    return spark.createDataFrame([(rho, pairs, off + abs(rho) * (1 - size / math.sqrt((xx + ea * ea) * (yy + eb * eb))))], schema)
