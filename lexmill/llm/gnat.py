"""Hard negatives by multiway hyperplane trees (geometric near-neighbour access trees).

Scores are inner products. With one more component, sqrt(M - |x|^2) for rows (M: the largest |x|^2) and 0 for anchors, the distance of
anchor and row is sqrt(|a|^2 + M - 2 * score), so a window of scores is an annulus about the anchor, and a better score a smaller radius.

A node has several split points; every row goes to the nearest one. Split point i stores the least and the largest distance to the rows of
each sibling subtree j. A row at distance between r1 and r2 of an anchor at distance d of split point i lies between max(d - r2, r1 - d)
and d + r2 of it; subtree j is left out as soon as its range to one split point misses that interval.

The first node deals all rows into shards: its split points come from a bounded sample, its ranges from an aggregation over all rows. Each
shard is cut into blocks of bounded size, and a task builds the further nodes of a block down to leaves, in which scores are exact. Anchors
travel to the shards that their annuli leave: first home, to bound the least positive score, then to the others, then with the windows
of their positives. A task returns the best few of each window only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import stored
from lexmill.llm.vectors import classes, usable, vector_digest

# Rows of a shard aimed at, shards at most, and rows of a block of a shard at most (on average).
SHARD_ROWS = 8192
MOST_SHARDS = 256
BLOCK_ROWS = 32_768
# Rows that the first split points are chosen from, at most.
SAMPLE = 16_384
# Anchors of a unit; split points of an inner node; rows of a leaf; scores that are held at once; hits before they are thinned.
UNIT_ASKS = 8192
FANOUT = 12
LEAF = 256
SCORES = 2_000_000
HITS = 2_000_000
# A class with more than this share of the anchors is joined by broadcast; there are fewer than HOT of them.
HOT = 1000


class Space(NamedTuple):
    """Dimensions and the largest squared norm of the rows."""

    dimensions: int
    reach: float

    @property
    def slack(self) -> float:
        """More than the rounding of a distance."""
        return 1e-6 * (self.reach**0.5 + 1)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the component that gives all of them the same norm."""
        rest = np.sqrt(np.maximum(self.reach - (rows * rows).sum(axis=1), 0))
        return np.hstack([rows, rest[:, None]])

    def between(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of lifted points and lifted rows."""
        return np.sqrt(np.maximum(2 * (self.reach - points @ rows.T), 0))

    def radius(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance that belongs to a score with an anchor of that squared norm."""
        return np.sqrt(np.maximum(squares + self.reach - 2 * scores, 0))


def split_points(space: Space, rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Up to ``count`` distinct lifted rows that are far apart: of three times as many random rows, always the farthest from those chosen."""
    rng = np.random.default_rng(seed)
    pool = rows[rng.choice(len(rows), min(len(rows), 3 * count), replace=False)]
    chosen, far = [0], space.between(pool[:1], pool)[0]
    while len(chosen) < count:
        at = int(far.argmax())
        if far[at] <= space.slack:
            break
        chosen.append(at)
        far = np.minimum(far, space.between(pool[at : at + 1], pool)[0])
    return pool[chosen]


class Ranges(NamedTuple):
    """Split points with the least and largest distance of point i to the rows of subtree j."""

    points: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def reached(self, space: Space, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Whether the annulus of each window may hold rows of each subtree."""
        squares = (anchors * anchors).sum(axis=1)
        d = space.radius(squares[:, None], anchors @ self.points[:, :-1].T)
        low = np.maximum(d - outer[:, None], inner[:, None] - d) - space.slack
        high = d + outer[:, None] + space.slack
        out = np.ones((len(anchors), self.points.shape[0]), bool)
        for i in range(len(self.points)):
            out &= (self.least[i][None, :] <= high[:, i : i + 1]) & (self.most[i][None, :] >= low[:, i : i + 1])
        return out


def grow(space: Space, rows: np.ndarray, members: np.ndarray, seed: int = 1):
    """A node of the tree over lifted ``rows``: (ranges, children), or the members of a leaf."""
    if len(members) <= LEAF:
        return members
    own = rows[members]
    points = split_points(space, own, FANOUT, seed)
    d = space.between(points, own)
    nearest = d.argmin(axis=0)
    parts = [np.flatnonzero(nearest == j) for j in range(len(points))]
    points, parts = points[[len(p) > 0 for p in parts]], [p for p in parts if len(p)]
    if len(parts) < 2:
        return members  # all at one place
    d = space.between(points, own)
    least = np.array([d[:, p].min(axis=1) for p in parts]).T
    most = np.array([d[:, p].max(axis=1) for p in parts]).T
    return Ranges(points, least, most), [grow(space, rows, members[p], seed + 1) for p in parts]


class Windows(NamedTuple):
    """What is asked: anchor vectors, and for each window its anchor's number and label and the hundredfold least and largest score."""

    anchors: np.ndarray
    anchor: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray


def search(space: Space, rows: np.ndarray, labels: np.ndarray, asked: Windows, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score): what may be among the ``k`` best of each window, of equal labels or of different ones."""
    tree = grow(space, space.lifted(rows), np.arange(len(rows)))
    squares = (asked.anchors * asked.anchors).sum(axis=1)[asked.anchor]
    inner = np.where(np.isinf(asked.high), 0.0, space.radius(squares, np.where(np.isinf(asked.high), 0.0, asked.high) / 100))
    best = np.full((len(asked.anchor), k), -np.inf)  # descending
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def thinned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, r, s = (np.concatenate(x) for x in zip(*hits)) if hits else (np.empty(0, int), np.empty(0, int), np.empty(0))
        keep = s >= best[w, -1]
        return w[keep], r[keep], s[keep]

    def leaf(members: np.ndarray, windows: np.ndarray) -> None:
        nonlocal held, hits
        step = max(1, SCORES // len(members))
        for i in range(0, len(windows), step):
            w = windows[i : i + step]
            names, at = np.unique(asked.anchor[w], return_inverse=True)
            score = (asked.anchors[names] @ rows[members].T)[at]
            fits = (asked.label[w][:, None] == labels[members][None, :]) == same
            fits &= (100 * score >= asked.low[w][:, None]) & (100 * score <= asked.high[w][:, None]) & (score >= best[w, -1:])
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            found = np.where(fits[some], score[some], -np.inf)
            best[w[some]] = -np.sort(-np.hstack([best[w[some]], found]), axis=1)[:, :k]
            row, column = np.nonzero(fits[some] & (score[some] >= best[w[some], -1:]))
            hits.append((w[some[row]], members[column], score[some[row], column]))
            held += len(row)
            if held > HITS:
                hits = [thinned()]
                held = len(hits[0][0])

    stack = [(tree, np.arange(len(asked.anchor)))]
    while stack:
        node, windows = stack.pop()
        if isinstance(node, np.ndarray):
            leaf(node, windows)
            continue
        ranges, children = node
        low = np.maximum(asked.low[windows] / 100, best[windows, -1])
        outer = np.where(np.isinf(low), np.inf, space.radius(squares[windows], np.where(np.isinf(low), 0.0, low)))
        reached = ranges.reached(space, asked.anchors[asked.anchor[windows]], inner[windows], outer)
        order = np.argsort([int(reached[:, j].sum()) for j in range(len(children))], kind="stable")
        stack += [(children[j], windows[reached[:, j]]) for j in order if reached[:, j].any()]
    return thinned()


def _vectors(data, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), dimensions)


def _found(space: Space, k: int, same: bool):
    """The k best (query, window, vec_id, score) of each window of a unit among the rows of its block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": np.empty(0, object), "window": np.empty(0), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        left = left.sort_values("class_id", ignore_index=True)  # the order of a shuffle must not decide the tree
        windows = [np.asarray(w, float) for w in right["windows"]]
        anchor = np.repeat(np.arange(len(right)), [len(w) for w in windows])
        window = np.concatenate(windows)
        bounds = [np.concatenate([np.asarray(b, float) for b in right[c]]) for c in ("low", "high")]
        asked = Windows(_vectors(right["data"], space.dimensions), anchor, right["label"].to_numpy()[anchor], *bounds)
        w, r, s = search(space, _vectors(left["data"], space.dimensions), left["label"].to_numpy(), asked, k, same)
        ids = left["ids"].to_numpy()[r]
        each = np.fromiter(map(len, ids), np.int64, len(ids))
        w, s, vec_id = np.repeat(w, each), np.repeat(s, each), np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64)
        order = np.lexsort((vec_id, -s, w))
        w, s, vec_id = w[order], s[order], vec_id[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w, "left")
        few = rank < k
        w = w[few]
        return pd.DataFrame({"query": right["query"].to_numpy()[anchor[w]], "window": window[w], "vec_id": vec_id[few], "score": s[few]})

    return run


def _dealt(space: Space, points: np.ndarray):
    """Rows with their shard, the number of the nearest split point, and their vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, space.dimensions)
            shard = np.empty(0, int) if not len(rows) else space.between(points, space.lifted(rows)).argmin(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), batch.column("class_id"), batch.column("label"), batch.column("ids"), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary())],
                ["shard", "class_id", "label", "ids", "data"],
            )

    return run


def _measured(space: Space, points: np.ndarray):
    """Least and largest distance (least, most) of each split point to this task's rows of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)
        for batch in batches:
            rows = _vectors(batch.column("data").to_pylist(), space.dimensions)
            shard, d = batch.column("shard").to_numpy(), space.between(points, space.lifted(rows))
            for j in np.unique(shard):
                mine = d[:, shard == j]
                least[:, j], most[:, j] = np.minimum(least[:, j], mine.min(axis=1)), np.maximum(most[:, j], mine.max(axis=1))
        i, j = np.nonzero(most >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(least[i, j]), pa.array(most[i, j])], ["i", "j", "least", "most"])

    return run


def _routed(space: Space, ranges: Ranges):
    """Anchors once for each shard that the annulus of one of their windows reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                anchors = _vectors(part.column("data").to_pylist(), space.dimensions)
                low, high = (part.column(c).to_pylist() for c in ("low", "high"))
                at = np.repeat(np.arange(len(low)), [len(x) for x in low])
                flat = [np.array([x for some in side for x in some], float) / 100 for side in (low, high)]
                squares = (anchors * anchors).sum(axis=1)[at]
                outer, inner = (np.where(np.isinf(x), edge, space.radius(squares, np.where(np.isinf(x), 0.0, x))) for x, edge in zip(flat, (np.inf, 0.0)))
                reached = np.zeros((len(anchors), len(ranges.points)), bool)
                np.logical_or.at(reached, at, ranges.reached(space, anchors[at], inner, outer))
                row, shard = np.nonzero(reached)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns)], ["shard", *part.schema.names])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, window, found): the k best (vec_id, score) of each window, in order."""
    order = Window.partitionBy("query", "window").orderBy(F.col("score").desc(), "vec_id")
    few = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    return few.groupBy("query", "window").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label and vector (of doubles, one length); ``anchors`` is a condition on vec_id. An anchor's positives are the
    first other rows of its label by score (ties: the smaller vec_id); for each one the first rows of other labels whose hundredfold score lies
    between ``low`` and ``high`` times the positive's. Defined cases: rows whose label, vec_id or vector is null, or whose vector is empty or holds a null or
    non-finite component, take no part; equal vectors of one label are one entry of the tree; repeated rows count once; an anchor without
    positives, or a positive without rows in its window, gives no rows, as does an empty table. Other columns are not read.
    """
    spark = rows.sparkSession
    name = F.concat(F.col("vector"), F.array(F.col("label").cast("double")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))).select("vec_id", "label", name.alias("vector"))
    size = F.size("vector") - 1
    vector = F.slice("vector", F.lit(1), size)
    entries = stored(
        classes(good.select("vec_id", "vector"), max(positives + 1, negatives))
        .select("class_id", F.element_at("vector", -1).cast("bigint").alias("label"), "ids", vector.alias("vector")), "entries",
    )
    asked = stored(good.where(anchors).select(F.col("vec_id").alias("anchor_id"), vector_digest("vector").alias("query")).distinct(), "anchors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    shape = entries.agg(F.max(F.size("vector")).alias("d"), F.max(square).alias("reach"), F.count(F.lit(1)).alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score double, negative_score double")
    space = Space(shape["d"], float(shape["reach"]))

    shards = max(1, min(MOST_SHARDS, -(-shape["n"] // SHARD_ROWS)))
    draw = F.xxhash64("class_id", F.lit("sample"))
    share = int(min(1.0, 1.5 * SAMPLE / shape["n"]) * 2**30) + 1
    sample = entries.where(F.pmod(draw, F.lit(2**30)) < share).select("vector", draw.alias("_draw"), "class_id").orderBy("_draw", "class_id").limit(SAMPLE)
    points = split_points(space, space.lifted(np.array([r["vector"] for r in sample.select("vector").collect()], float)), shards, 1)
    dealt = stored(entries.mapInArrow(_dealt(space, points), "shard int, class_id string, label bigint, ids array<bigint>, data binary"), "dealt")
    ranges = Ranges(points, np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf))
    measured = dealt.select("shard", "data").mapInArrow(_measured(space, points), "i int, j int, least double, most double")
    # MOST_SHARDS squared rows at most
    for r in measured.groupBy("i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).toLocalIterator():
        ranges.least[r["i"], r["j"]], ranges.most[r["i"], r["j"]] = r["least"], r["most"]
    blocks = {r["shard"]: -(-r["count"] // BLOCK_ROWS) for r in dealt.groupBy("shard").count().collect()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["query", "label", "data", "windows", "low", "high"]

    def visited(asks: DataFrame, k: int, same: bool, to: str) -> DataFrame:
        """The best rows of each window in the shards that ``asks`` names, unit by unit."""
        asks = stored(asks, f"{to}-asks")
        groups = {r["shard"]: -(-r["count"] // UNIT_ASKS) for r in asks.groupBy("shard").count().collect()}
        table = [(s, blocks[s], g) for s, g in groups.items() if s in blocks]
        sizes = F.broadcast(spark.createDataFrame(table, "shard int, blocks int, groups int"))  # a row for each shard
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt_to = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = dealt.join(sizes, "shard").select("shard", dealt_to("class_id", "blocks").alias("block"), upto("groups").alias("group"), "class_id", "label", "ids", "data")
        right = asks.join(sizes, "shard").select("shard", upto("blocks").alias("block"), dealt_to("query", "groups").alias("group"), *columns)
        unit = ["shard", "block", "group"]
        found = (
            left.repartition(parts, *unit).groupBy(*unit).cogroup(right.repartition(parts, *unit).groupBy(*unit))
            .applyInPandas(_found(space, k, same), "query string, window double, vec_id bigint, score double")
        )
        return stored(found, to)

    # Positives: the home shard bounds the least score, the others are visited where the bound leaves them.
    own = asked.select("query").distinct()
    query = stored(dealt.join(own, dealt["class_id"] == own["query"], "left_semi").select(F.col("class_id").alias("query"), "label", "data", "shard"), "query-classes")
    one = lambda c: F.array(c.cast("double")) if isinstance(c, Column) else F.array(F.lit(float(c)))
    inf = float("inf")
    home = visited(query.select("shard", "query", "label", "data", one(0).alias("windows"), one(-inf).alias("low"), one(inf).alias("high")), positives + 1, True, "home")
    least = _best(home, positives + 1).where(F.size("found") > positives).select("query", F.element_at("found", -1)["score"].alias("least"))
    bounded = query.join(least, "query", "left").withColumn("least", F.coalesce(F.col("least") * 100, F.lit(-inf)))
    travelling = bounded.select("query", "label", "data", one(0).alias("windows"), F.array("least").alias("low"), one(inf).alias("high"), F.col("shard").alias("home"))
    schema = "shard int, query string, label bigint, data binary, windows array<double>, low array<double>, high array<double>"
    away = travelling.mapInArrow(_routed(space, ranges), f"{schema}, home int").where("shard <> home").select("shard", *columns)
    lists = stored(_best(home.unionByName(visited(away, positives + 1, True, "away")), positives + 1).select("query", "found"), "positive-lists")

    anchors_of = asked.groupBy("query").count()
    total = asked.count()
    hot = F.broadcast(stored(anchors_of.where(F.col("count") * HOT > total).select("query"), "hot"))

    def attached(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        """Join of anchors with lists of their class; the lists of the few common classes are broadcast."""
        common = left.join(hot, "query").join(F.broadcast(right.join(hot, "query")), list(on))
        return common.unionByName(left.join(hot, "query", "left_anti").join(right, list(on)))

    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    each = attached(asked, lists, "query").select("anchor_id", "query", F.explode(others).alias("x"))
    pairs = stored(each.select("anchor_id", "query", F.col("x.vec_id").alias("positive_id"), F.col("x.score").alias("window")), "positives")

    # Negatives: the annuli of the distinct positive scores of each class, at most positives + 1 of them.
    scores = pairs.where(F.col("window") * low <= F.col("window") * high).groupBy("query").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    times = lambda n: F.transform("windows", lambda x: x * F.lit(float(n)))
    windowed = query.select("query", "label", "data").join(scores, "query").select("query", "label", "data", "windows", times(low).alias("low"), times(high).alias("high"))
    found = visited(windowed.mapInArrow(_routed(space, ranges), schema), negatives, False, "negatives")
    mined = stored(_best(found, negatives), "negative-lists")
    return attached(pairs, mined, "query", "window").select(
        "anchor_id", "positive_id", F.col("window").alias("positive_score"), F.explode("found").alias("x")
    ).select("anchor_id", "positive_id", F.col("x.at").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
