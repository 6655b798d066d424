"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt over shards of bounded size by a hash. Each shard builds its graph on its own and stores it as flat arrays (levels,
and for each level a matrix of neighbour numbers). Inner product becomes distance by one more component,
sqrt(M^2 - |x|^2) with M the greatest norm, which leaves the order of the scores as it is. Batches of points are inserted with
the ordinary search of the graph so far, neighbours are chosen by the usual diversity rule and linked both ways. All queries, in
blocks, search every shard; the results are merged per query.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import stored
from lexmill.llm.vectors import classes, matrix, usable, vector_digest

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
LINKS = 16  # of a point in upper levels; twice as many in the lowest
BREADTH = 64  # of a search


class Graph:
    """A navigable small-world graph over the rows of ``points`` by Euclidean distance."""

    def __init__(self, points: np.ndarray, links: int = LINKS, breadth: int = BREADTH):
        self.points = np.ascontiguousarray(points, np.float32)
        self.squares = (self.points.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)
        self.links, self.breadth = links, breadth
        n = len(points)
        rng = np.random.default_rng(n)
        self.levels = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 8) if n else np.empty(0, int)
        self.levels[:1] = self.levels.max(initial=0)  # the entry point is in all levels
        self.neighbours = [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(self.levels.max(initial=0)) + 1)]

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of every query row to its own row of ``ids`` (-1: infinite)."""
        d = self.squares[ids] - 2 * np.einsum("bd,bkd->bk", q, self.points[ids])
        d[ids < 0] = np.inf
        return d

    def _search(self, q: np.ndarray, entry: np.ndarray, level: int, breadth: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once from their entry points: ids (b, breadth) and distances, nearest first."""
        b, links = len(q), self.neighbours[level]
        ids = np.full((b, breadth), -1, np.int32)
        dist = np.full((b, breadth), np.inf, np.float32)
        done = np.zeros((b, breadth), bool)
        width = min(entry.shape[1], breadth)
        first = self._distances(q, entry)
        order = np.argsort(first, axis=1, kind="stable")[:, :width]
        ids[:, :width], dist[:, :width] = np.take_along_axis(entry, order, 1), np.take_along_axis(first, order, 1)
        seen = np.zeros((b, len(self.points)), bool)
        rows = np.arange(b)
        seen[rows[:, None], entry] |= entry >= 0
        alive = rows
        while len(alive):
            waiting = np.where(done[alive] | (ids[alive] < 0), np.inf, dist[alive])
            at = waiting.argmin(axis=1)
            go = np.isfinite(waiting[np.arange(len(alive)), at])
            alive, at = alive[go], at[go]
            if not len(alive):
                break
            done[alive, at] = True
            near = links[ids[alive, at]]
            fresh = (near >= 0) & ~seen[alive[:, None], near]
            if limit is not None:
                fresh &= near < limit
            near = np.where(fresh, near, -1)
            r, c = np.nonzero(fresh)
            seen[alive[r], near[r, c]] = True
            d = self._distances(q[alive], near)
            both_d = np.concatenate([dist[alive], d], axis=1)
            order = np.argpartition(both_d, breadth - 1, axis=1)[:, :breadth]
            ids[alive] = np.take_along_axis(np.concatenate([ids[alive], near], axis=1), order, 1)
            dist[alive] = np.take_along_axis(both_d, order, 1)
            done[alive] = np.take_along_axis(np.concatenate([done[alive], np.zeros_like(fresh)], axis=1), order, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def _diverse(self, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in order of distance, those nearer to the point than to any chosen one; filled up with the nearest others."""
        ok = near >= 0
        near, dist = near[ok][: 4 * most], dist[ok][: 4 * most]
        if len(near) <= most:
            return near
        p = self.points[near]
        between = self.squares[near][:, None] + self.squares[near][None, :] - 2 * p @ p.T
        chosen: list[int] = []
        blocked = np.zeros(len(near), bool)
        for i in range(len(near)):
            if not blocked[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                blocked |= between[i] < dist
        rest = [i for i in range(len(near)) if i not in set(chosen)][: most - len(chosen)]
        return near[chosen + rest]

    def _link(self, level: int, new: np.ndarray, near: np.ndarray, dist: np.ndarray) -> None:
        links = self.neighbours[level]
        most = links.shape[1]
        back: dict[int, list[int]] = {}
        for i, a, d in zip(new, near, dist):
            chosen = self._diverse(a, d, self.links)
            links[i, : len(chosen)] = chosen
            for x in chosen:
                back.setdefault(int(x), []).append(int(i))
        for x, sources in back.items():
            own = links[x][links[x] >= 0]
            every = np.unique(np.concatenate([own, np.array(sources, np.int32)]))
            if len(every) > most:
                d = self.squares[x] + self.squares[every] - 2 * self.points[every] @ self.points[x]
                order = np.argsort(d, kind="stable")
                every = self._diverse(every[order], d[order], most)
            links[x] = -1
            links[x, : len(every)] = every

    def build(self, batch: int = 256) -> Graph:
        n, start = len(self.points), 1
        while start < n:
            new = np.arange(start, min(n, start + min(batch, start)))
            q = self.points[new]
            entry = np.zeros((len(new), 1), np.int32)
            own = self.squares[new][:, None] + self.squares[new][None, :] - 2 * q @ q.T
            for level in range(len(self.neighbours) - 1, -1, -1):
                ids, d = self._search(q, entry, level, self.breadth)
                entry = ids
                here = self.levels[new] >= level
                if here.any():
                    # points of the same batch are candidates too
                    other = np.where((here[None, :] & here[:, None]) & ~np.eye(len(new), dtype=bool), own, np.inf).astype(np.float32)
                    mates = np.where(np.isfinite(other), new[None, :], -1).astype(np.int32)
                    all_d = np.concatenate([np.where(ids >= 0, d + self.squares[new][:, None], np.inf), other], axis=1)
                    order = np.argsort(all_d, axis=1, kind="stable")[:, : self.breadth]
                    near = np.take_along_axis(np.concatenate([ids, mates], axis=1), order, 1)
                    self._link(level, new[here], near[here], np.take_along_axis(all_d, order, 1)[here])
            start = int(new[-1]) + 1
        return self

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` nearest found for every query, nearest first (-1 where there are fewer)."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.zeros((len(q), 1), np.int32)
        for level in range(len(self.neighbours) - 1, 0, -1):
            entry = self._search(q, entry, level, 8)[0]
        return self._search(q, entry, 0, max(self.breadth, k))[0][:, :k]

    def flat(self) -> bytes:
        """Levels and neighbour matrices as one binary value."""
        out = io.BytesIO()
        np.savez(out, levels=self.levels, **{f"n{i}": m for i, m in enumerate(self.neighbours)})
        return out.getvalue()

    @classmethod
    def of(cls, points: np.ndarray, flat: bytes) -> Graph:
        graph = cls(points[:0])
        with np.load(io.BytesIO(flat)) as a:
            graph.levels = a["levels"]
            graph.neighbours = [a[f"n{i}"] for i in range(len(a.files) - 1)]
        graph.points = np.ascontiguousarray(points, np.float32)
        graph.squares = (graph.points.astype(np.float64) ** 2).sum(axis=1).astype(np.float32)
        return graph


def _lifted(x: np.ndarray, greatest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(greatest**2 - (x**2).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _built(greatest: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class_id")
        x = matrix(rows["vector"])
        graph = Graph(_lifted(x, greatest)).build()
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])], "class_ids": [list(rows["class_id"])], "vectors": [x.tobytes()],
            "d": [x.shape[1]], "graph": [graph.flat()],
        })

    return run


def _searched(k: int, greatest: float):
    """One graph against one block of queries: the k + 1 best of the shard by exact inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["d"])
                q = np.frombuffer(row["asked"], np.float64).reshape(-1, row["d"])
                graph = Graph.of(_lifted(x, greatest), row["graph"])
                found = graph.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1), k + 1)
                i, j = np.nonzero(found >= 0)
                hit = found[i, j]
                score = np.einsum("nd,nd->n", q[i], x[hit])
                names, queries = np.array(row["class_ids"], object), np.array(row["asked_ids"], object)
                yield pa.RecordBatch.from_arrays([pa.array(queries[i], pa.string()), pa.array(names[hit], pa.string()), pa.array(score)], ["query", "class_id", "score"])

    return run


def build_index(entries: DataFrame, greatest: float, count: int) -> DataFrame:
    """(shard, class_ids, vectors, d, graph) of (class_id, vector): one row per shard of about SHARD_ROWS vectors."""
    shards = max(1, -(-count // SHARD_ROWS))
    dealt = entries.select("class_id", "vector", F.pmod(F.xxhash64("class_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    n = max(shards, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, "shard").groupBy("shard").applyInPandas(
        _built(greatest), "shard int, class_ids array<string>, vectors binary, d int, graph binary"
    )


def nearest(rows: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """The k nearest found by inner product: query_id, rank, vec_id, score; ties to the smaller id.

    ``rows``: vec_id and vector (of doubles, one length); ``queries`` is a condition on vec_id. Rows whose vector is null, empty or zero or
    holds a null or non-finite component, or whose vec_id is null, take no part. Equal vectors are one point of the graph and
    are expanded in the result; a vec_id names one vector, its repeated rows count once as candidates. A query that faces
    fewer than k rows gets those found. An empty table gives no rows.
    """
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), nonzero=True)).select("vec_id", "vector")
    entries = stored(classes(good, k + 1), "points")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    shape = entries.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("most")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    greatest = float(np.sqrt(shape["most"])) * (1 + 1e-9)
    index = stored(build_index(entries, greatest, shape["n"]), "graphs")

    asked = stored(good.where(queries).select("vec_id", vector_digest("vector").alias("class_id")), "queries")
    distinct = entries.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vector")
    groups = max(1, -(-distinct.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("class_id", F.lit("block")), F.lit(groups)).cast("int")

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(part["block"].iloc[0])], "asked_ids": [list(part["class_id"])], "asked": [matrix(part["vector"]).tobytes()]})

    blocks = distinct.withColumn("block", block).groupBy("block").applyInPandas(packed, "block int, asked_ids array<string>, asked binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(blocks, "block").repartition(n, "block", "shard")
    found = stored(met.select("class_ids", "vectors", "d", "graph", "asked_ids", "asked").mapInArrow(_searched(k, greatest), "query string, class_id string, score double"), "found")

    # k + 1 rows per distinct query vector, then each query leaves itself out
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "class_id")
    top = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    each = top.join(entries.select("class_id", "ids"), "class_id").select("query", "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = stored(each.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1), "best")
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("list"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")).join(lists, "query")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("_at", "x")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
