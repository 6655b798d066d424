"""Correlations, regressions and similarity analyses as aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import numeric as nm
from lexmill.operators.ordering import average_ranks
from lexmill.session import cut_lineage

Pair = tuple[str, str]
Term = str | Pair


def pearson(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Correlation and its p-value for pairs without NULL or NaN."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return df.where(both).groupBy(*keys).agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")
    ).withColumn("p_value", _correlation_p(F.col("r"), F.col("n")))


def _correlation_p(r: Column, n: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def two_sided(rs: pd.Series, ns: pd.Series) -> pd.Series:
        def p(r: float, n: float) -> float:
            if r != r or n < 3:
                return float("nan")
            return 0.0 if abs(r) >= 1 else student_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

        return pd.Series([p(r, n) for r, n in zip(rs, ns)], dtype="float64")

    return two_sided(r.cast("double"), n.cast("double"))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    if t != t or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h / a


def spearman(df: DataFrame, x: str, y: str, buckets: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation with mean ranks for ties, for every value of ``keys`` (temperature, subtask) in one job.

    Pairs are counted first and stored, as several passes read them. Ranks are computed on distinct values and joined back, so the number of
    rows that are sorted and joined is that of distinct values.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    pairs = cut_lineage(
        df.where(both).groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    rx = average_ranks(pairs.select(*keys, "_x", "_w"), "_x", "_rx", buckets, weight="_w", within=keys)
    ry = average_ranks(pairs.select(*keys, "_y", "_w"), "_y", "_ry", buckets, weight="_w", within=keys)
    ranked = pairs.join(rx.select(*keys, "_x", "_rx"), [*keys, "_x"]).join(ry.select(*keys, "_y", "_ry"), [*keys, "_y"])
    return weighted_corr(ranked, "_rx", "_ry", "_w", keys).select(*keys, F.col("r").alias("rho"), "n")


def weighted_corr(df: DataFrame, x: str, y: str, w: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation, for every key, of rows that stand for ``w`` equal pairs each.

    Values are centred on the weighted means before the products are summed.
    """
    means = df.groupBy(*keys).agg(
        (F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("mx"), (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("my")
    )
    if keys:
        centred = df.join(means, list(keys)).select(*keys, (F.col(x) - F.col("mx")).alias("dx"), (F.col(y) - F.col("my")).alias("dy"), F.col(w).alias("w"))
    else:
        centred = df.select(
            (F.col(x) - means.select("mx").scalar()).alias("dx"), (F.col(y) - means.select("my").scalar()).alias("dy"), F.col(w).alias("w")
        )
    sums = centred.groupBy(*keys).agg(
        F.sum(F.col("dx") * F.col("dy") * F.col("w")).alias("xy"),
        F.sum(F.col("dx") * F.col("dx") * F.col("w")).alias("xx"),
        F.sum(F.col("dy") * F.col("dy") * F.col("w")).alias("yy"),
        F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("n"),
    )
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(
        *keys, F.when(spread == 0, F.lit(float("nan"))).otherwise(F.col("xy") / spread).alias("r"), "n"
    )


def correlations_with(df: DataFrame, target: str, others: list[str]) -> DataFrame:
    """Correlation of ``target`` with each column over the pairs without NULL, in one aggregation."""
    row = df.agg(*[F.corr(target, o).alias(o) for o in others])
    return row.unpivot([], others, "variable", "r")


def _design(terms: tuple[Term, ...]) -> list[Column]:
    out = [F.lit(1.0)]
    for term in terms:
        column = F.col(term) if isinstance(term, str) else F.col(term[0]) * F.col(term[1])
        out.append(column.cast("double"))
    return out


def main_and_pairwise(names: tuple[str, ...], *extra: str) -> tuple[Term, ...]:
    """Main effects, all pairwise products, then further main effects."""
    return (*names, *combinations(names, 2), *extra)


def _columns(y: str, terms: tuple[Term, ...]) -> list[str]:
    used = [y]
    for term in terms:
        used += [term] if isinstance(term, str) else list(term)
    return list(dict.fromkeys(used))


def _complete(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        df = df.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    return df


Model = tuple[str, tuple[Term, ...]]


def _moments(df: DataFrame, models: Sequence[Model], keys: tuple[str, ...]) -> list[tuple[dict, list[tuple]]]:
    """Per key: (n, means, centred cross products of terms and y) of every model, from two aggregations for all of them.

    A model's sums run over the rows that are complete for it. Values are centred on the model's means over all keys, and each
    key's own mean is taken out of its sums.
    """
    columns, complete, kept = {}, {}, set(keys)
    for j, (y, terms) in enumerate(models):
        used = _columns(y, terms)
        kept |= set(used)
        complete[j] = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in used])
        columns[j] = [F.when(complete[j], c) for c in (*_design(terms)[1:], F.col(y).cast("double"))]
    rows = df.select(*[F.col(c) for c in df.columns if c in kept])
    first = rows.agg(*[F.avg(c).alias(f"m{j}_{i}") for j, each in columns.items() for i, c in enumerate(each)]).first()
    sums = []
    for j, each in columns.items():
        centred = [c - F.lit(first[f"m{j}_{i}"]) for i, c in enumerate(each)]
        sums.append(F.count_if(complete[j]).alias(f"n{j}"))
        sums += [F.sum(c).alias(f"a{j}_{i}") for i, c in enumerate(centred)]
        sums += [F.sum(centred[i] * centred[k]).alias(f"s{j}_{i}_{k}") for i in range(len(each)) for k in range(i, len(each))]
    out = []
    for r in rows.groupBy(*keys).agg(*sums).collect():  # one row per key
        found = []
        for j, each in columns.items():
            n, k = r[f"n{j}"], len(each)
            if not n:
                found.append((0, np.zeros(k), np.zeros((k, k))))
                continue
            shift = np.array([r[f"a{j}_{i}"] for i in range(k)])
            cross = np.array([[r[f"s{j}_{min(i, m)}_{max(i, m)}"] for m in range(k)] for i in range(k)])
            found.append((n, np.array([first[f"m{j}_{i}"] for i in range(k)]) + shift / n, cross - np.outer(shift, shift) / n))
        out.append(({key: r[key] for key in keys}, found))
    return out


def _solve(terms: tuple[Term, ...], n: int, means: np.ndarray, cross: np.ndarray) -> dict:
    k = len(terms)
    names = [t if isinstance(t, str) else ":".join(t) for t in terms]
    scale = np.sqrt(np.where(np.diag(cross)[:k] > 0, np.diag(cross)[:k], 1.0))
    gram = cross[:k, :k] / np.outer(scale, scale)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    beta = inverse @ (cross[:k, k] / scale) / scale
    total = cross[k, k]
    residual = max(total - beta @ cross[:k, k], 0.0)
    rank = int(np.linalg.matrix_rank(gram, tol=1e-12, hermitian=True)) + 1
    freedom = n - rank
    variance = residual / freedom if freedom > 0 else float("nan")
    errors = np.sqrt(np.maximum(np.diag(inverse), 0) * variance) / scale
    t = np.divide(beta, errors, out=np.full(k, np.nan), where=errors > 0)
    return {
        "n": int(n),
        "r2": float(1 - residual / total) if total > 0 else float("nan"),
        "aic": float(n * math.log(2 * math.pi * residual / n) + n + 2 * rank) if residual > 0 else float("-inf"),
        "intercept": float(means[k] - beta @ means[:k]),
        "coef": dict(zip(names, beta.tolist())),
        "t": dict(zip(names, t.tolist())),
        "p": {name: student_p(value, freedom) for name, value in zip(names, t.tolist())},
    }


def fit_models(df: DataFrame, models: Sequence[Model], keys: tuple[str, ...] = ()) -> list[tuple[dict, list[dict]]]:
    """Least squares with intercept of every model (y, terms), for every value of ``keys``: R², AIC, coefficients, t and p values.

    Two scans serve all models and keys. Spark aggregates the cross products, whose number depends on the terms only; the
    small symmetric systems are solved on the driver, one row per key. Rows with a missing value in a model are left out of it.
    """
    return [(key, [_solve(terms, *m) for (_, terms), m in zip(models, found)]) for key, found in _moments(df, models, keys)]


def fit_ols(df: DataFrame, y: str, terms: tuple[Term, ...]) -> dict:
    """One model over all rows."""
    return fit_models(df, [(y, terms)])[0][1][0]


def _gain(y: str, small: dict, full: dict) -> dict:
    return {
        "dependent": y, "r2_base": small["r2"], "r2_full": full["r2"],
        "gain": (full["r2"] - small["r2"]) / (1 - small["r2"]), "base": small, "full": full,
    }


def r2_gain(df: DataFrame, y: str, base: tuple[str, ...], predictor: str, common_rows: bool = False) -> dict:
    """Share of the base model's unexplained variance that the predictor explains.

    The two fits may use different rows; ``common_rows`` drops rows without predictor from both.
    """
    rows = _complete(df, [predictor]) if common_rows else df
    (_, (small, full)), = fit_models(rows, [(y, main_and_pairwise(base)), (y, main_and_pairwise(base, predictor))])
    return _gain(y, small, full)


def r2_gain_by(df: DataFrame, dependents: Sequence[str], base: tuple[str, ...], predictor: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, variable, r2_base, r2_full, gain) for every key (revision, subtask) and dependent variable, in two scans."""
    models = [m for y in dependents for m in ((y, main_and_pairwise(base)), (y, main_and_pairwise(base, predictor)))]
    rows = []
    for key, fits in fit_models(df, models, keys):
        for y, small, full in zip(dependents, fits[::2], fits[1::2]):
            g = _gain(y, small, full)
            rows.append((*key.values(), y, g["r2_base"], g["r2_full"], g["gain"]))
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    return df.sparkSession.createDataFrame(rows, ", ".join([*kinds, "variable string, r2_base double, r2_full double, gain double"]))


def predictor_report(
    df: DataFrame, dependents: tuple[str, ...], base: tuple[str, ...], predictor: str = "pred"
) -> DataFrame:
    """Per dependent variable: coefficient, t, p, R², its change, AIC and its change."""
    models = [m for y in dependents for m in ((y, main_and_pairwise(base)), (y, main_and_pairwise(base, predictor)))]
    (_, fits), = fit_models(df, models)
    rows = []
    for y, small, full in zip(dependents, fits[::2], fits[1::2]):
        r = _gain(y, small, full)
        rows.append(
            (
                y, r["full"]["coef"][predictor], r["full"]["t"][predictor], r["full"]["p"][predictor],
                r["r2_full"], r["r2_full"] - r["r2_base"], r["full"]["aic"],
                r["full"]["aic"] - r["base"]["aic"], r["gain"],
            )
        )
    schema = (
        "variable string, coefficient double, t_value double, p_value double, r2 double, r2_change double, "
        "aic double, aic_change double, gain double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def reading_scores(df: DataFrame, eye: tuple[str, ...], paced: str, base: tuple[str, ...],
                   spillover: tuple[str, ...], predictor: str = "pred") -> tuple[float, float]:
    """Eye-tracking score (mean gain over its variables) and self-paced score (with spill-over terms)."""
    sides = [(y, base) for y in eye] + [(paced, spillover)]
    (_, fits), = fit_models(df, [m for y, b in sides for m in ((y, main_and_pairwise(b)), (y, main_and_pairwise(b, predictor)))])
    gains = [_gain(y, small, full)["gain"] for (y, _), small, full in zip(sides, fits[::2], fits[1::2])]
    return sum(gains[:-1]) / len(eye), gains[-1]


# Most vectors of a block, and least ones of it when small inputs are spread over the tasks.
BLOCK_ROWS, LEAST_ROWS = 65_536, 128


class _TileVectors:
    """Unit vectors of a tile, sorted by id; ids may repeat. A vector that is NULL or holds a NULL has length -1."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        lists, ids = rows["u"].combine_chunks(), rows["_i"].to_numpy()
        values = lists.flatten()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(len(size)), size)
        units = np.zeros((len(size), size.max(initial=0)))
        units[row, at] = values.to_numpy(zero_copy_only=False)
        missing = lists.is_null().to_numpy(zero_copy_only=False).copy()
        missing[row[values.is_null().to_numpy(zero_copy_only=False)]] = True
        order = np.argsort(ids, kind="stable")
        self.ids, self.units, self.sizes = ids[order], units[order], np.where(missing, -1, size)[order]
        self.repeats = np.searchsorted(self.ids, self.ids, "right") - np.arange(len(ids))

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every id each of its vectors: (position of the id, row of the vector)."""
        first = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        n = np.where(self.ids[first] == ids, self.repeats[first], 0)
        position = np.repeat(np.arange(len(ids)), n)
        return position, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[position]

    def similarities(self, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
        """(positions of the batch, similarity) of the pairs whose ids both have vectors."""
        at, a = self.places(batch["_i"].to_numpy())
        again, b = self.places(batch["_j"].to_numpy()[at])
        a, at = a[again], at[again]
        unknown = (self.sizes[a] != self.sizes[b]) | (self.sizes[a] < 0)
        return at, pa.array(np.einsum("nd,nd->n", self.units[a], self.units[b]), mask=unknown)


def _tile_similarities(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is sorted by tile, the vectors of a tile come before its pairs.
        tile, waiting, known = None, [], None
        for batch in batches:
            tiles, is_pair = batch["_tile"].to_numpy(), batch["_pair"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(is_pair.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(tiles)]):
                part = batch.slice(lo, hi - lo)
                if tiles[lo] != tile:
                    tile, waiting, known = tiles[lo], [], None
                if not is_pair[lo]:
                    waiting.append(part)
                elif waiting or known:
                    if known is None:
                        known, waiting = _TileVectors(waiting), []
                    at, sim = known.similarities(part)
                    kept = part.select(names).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*kept.columns, sim], names=[*names, "sim"])

    return run


def pair_similarities(
    pairs: DataFrame, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cosine similarity for the id pairs (i, j) of a stored table; ids are integers.

    Only wanted pairs are computed. Ids are dealt into blocks, and a pair meets the vectors of its two blocks in one task, so a pair is
    shuffled once and without a vector; a vector is shuffled once for every block. A task holds the vectors of two blocks, pairs pass by.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.count()
    blocks = max(1, -(-rows // block_rows), min(-(-rows // LEAST_ROWS), math.isqrt(8 * tasks)))

    def block(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def tile(a: Column, b: Column) -> Column:
        return (F.least(a, b) * blocks + F.greatest(a, b)).cast("bigint").alias("_tile")

    key, names = F.col(vec_id).cast("bigint"), ["j", "i", *[c for c in pairs.columns if c not in ("i", "j")]]
    units = vectors.where(key.isNotNull()).select(key.alias("_i"), nm.unit(nm.as_doubles(F.col(vector))).alias("u"), block(key).alias("_own"))
    placed = units.select("_i", "u", "_own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")).select(
        tile(F.col("_own"), F.col("_other")), F.lit(False).alias("_pair"), "_i", "u"
    )
    i, j = F.col("i").cast("bigint"), F.col("j").cast("bigint")
    wanted = pairs.where("i is not null and j is not null").select(
        tile(block(i), block(j)), F.lit(True).alias("_pair"), i.alias("_i"), j.alias("_j"), *names
    )
    schema = T.StructType([*[T.StructField(c, pairs.schema[c].dataType) for c in names], T.StructField("sim", T.DoubleType())])
    both = placed.unionByName(wanted, allowMissingColumns=True)
    return both.repartition(tasks, "_tile").sortWithinPartitions("_tile", "_pair").mapInArrow(_tile_similarities(names), schema)


def rsa(pairs: DataFrame, a: str, b: str, method: str = "spearman") -> DataFrame:
    """Correlation of two similarity columns over pairs i > j."""
    if method not in ("spearman", "pearson"):
        raise ValueError("Unsupported method. Use 'spearman' or 'pearson'.")
    lower = pairs.where("i > j")
    if method == "spearman":
        return spearman(lower, a, b)
    return lower.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"))


def _partial_sums(batches):
    """Per partition: cells of U'V, U'U, V'V and the sums of U and V."""
    sums = None
    for batch in batches:
        if batch.empty:
            continue
        u, v = np.stack(batch["u"].to_numpy()), np.stack(batch["v"].to_numpy())
        parts = {
            "uv": u.T @ v, "uu": u.T @ u, "vv": v.T @ v,
            "u": u.sum(axis=0)[None, :], "v": v.sum(axis=0)[None, :],
        }
        sums = parts if sums is None else {k: sums[k] + parts[k] for k in parts}
    for kind, m in (sums or {}).items():
        r, c = np.indices(m.shape)
        yield pd.DataFrame({"kind": kind, "r": r.ravel(), "c": c.ravel(), "x": m.ravel()})


def rsa_pearson_vectors(a: DataFrame, b: DataFrame, on: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pearson correlation of the two full lower triangles of cosine similarities, without pairs.

    With unit rows u, v the sums over all pairs follow from matrices whose size is that of a vector:
    sum s*t = (|U'V|^2 - n) / 2 and sum s = (|sum u|^2 - n) / 2, squares as cell-wise squares.
    Every task reduces its rows to such matrices; only their cells are shuffled.
    """
    left = a.select(on, nm.unit(nm.as_doubles(F.col(vector))).alias("u"))
    right = b.select(on, nm.unit(nm.as_doubles(F.col(vector))).alias("v"))
    joined = left.join(right, on)
    cells = (
        joined.select("u", "v").mapInPandas(_partial_sums, "kind string, r int, c int, x double")
        .groupBy("kind", "r", "c").agg(F.sum("x").alias("x"))
    )

    def square(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("x") * F.col("x")))

    rows = left.join(right.select(on), on).agg(F.count(F.lit(1)).cast("double").alias("n"))
    squares = cells.agg(*[square(k).alias(k) for k in ("uv", "uu", "vv", "u", "v")])
    c, n = F.col, F.col("n")
    # The diagonal of each similarity matrix is 1, so it contributes n to every sum.
    parts = squares.withColumn("n", rows.scalar()).select(
        (n * (n - 1) / 2).alias("m"), *[((c(k) - n) / 2).alias(k) for k in ("uv", "uu", "vv", "u", "v")]
    )
    return parts.select(
        ((c("m") * c("uv") - c("u") * c("v"))
         / F.sqrt((c("m") * c("uu") - c("u") * c("u")) * (c("m") * c("vv") - c("v") * c("v")))).alias("r"),
        c("m").cast("bigint").alias("n_pairs"),
    )


def single_row(spark: SparkSession, values: dict) -> DataFrame:
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)
