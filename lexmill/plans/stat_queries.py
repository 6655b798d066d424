"""Queries for correlations, regressions, trials, similarity and age of acquisition."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.operators import acquisition, metrics, pair_ranks, stats, trials
from lexmill.plans.registry import query, table

BETAS = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0]


@query(
    "spearman",
    """WITH r AS (SELECT RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
      RANK() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
    SELECT ROUND(CORR(a, b), 6) AS rho, COUNT(*) AS n FROM r""",
)
def spearman(spark, sf):
    return stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query(
    "average_ranks",
    """SELECT DISTINCT l_discount, COUNT(*) OVER (PARTITION BY l_discount) AS n,
    RANK() OVER (ORDER BY l_discount) + (COUNT(*) OVER (PARTITION BY l_discount) - 1) / 2 AS avg_rank FROM lineitem""",
)
def average_ranks(spark, sf):
    from lexmill.operators.ordering import average_ranks as ranks

    return ranks(table(spark, sf, "lineitem").select("l_discount"), "l_discount")


@query(
    "pearson",
    """SELECT l_returnflag, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r, COUNT(*) AS n
    FROM lineitem GROUP BY 1""",
)
def pearson(spark, sf):
    out = stats.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ("l_returnflag",))
    return out.select("l_returnflag", F.round("r", 6).alias("r"), "n")


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variable, ROUND(CORR(l_extendedprice, {v}), 6) AS r FROM lineitem"
        for v in ("l_quantity", "l_discount", "l_tax")
    ),
)
def correlations(spark, sf):
    out = stats.correlations_with(
        table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]
    )
    return out.withColumn("r", F.round("r", 6))


@query(
    "classification_metrics",
    """WITH c AS (SELECT quality AS y, CAST(n_chars > 1500 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)),
    t AS (SELECT COUNT(*) AS total, CAST(COUNT(*) FILTER (y = 1 AND p = 1) AS DOUBLE) AS tp, CAST(COUNT(*) FILTER (y = 0 AND p = 1) AS DOUBLE) AS fp,
      CAST(COUNT(*) FILTER (y = 1 AND p = 0) AS DOUBLE) AS fn, CAST(COUNT(*) FILTER (y = 0 AND p = 0) AS DOUBLE) AS tn FROM c)
    SELECT total, ROUND((tp + tn) / total, 6) AS accuracy, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1,
    ROUND((tp * tn - fp * fn) / SQRT((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM t""",
)
def classification_metrics(spark, sf):
    out = metrics.classification_metrics(_labelled(spark, sf), "quality", "pred")
    return out.select("total", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "mcc")])


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("pred"), "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id")


@query(
    "multiclass_mcc",
    """WITH c AS (SELECT quality + toxic AS y, CAST(n_chars % 3 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)),
    m AS (SELECT k, SUM(t) AS t, SUM(p) AS p FROM (SELECT y AS k, 1.0::DOUBLE AS t, 0.0::DOUBLE AS p FROM c
      UNION ALL SELECT p, 0, 1 FROM c) GROUP BY k),
    x AS (SELECT SUM(t * p) AS tp, SUM(t * t) AS tt, SUM(p * p) AS pp FROM m),
    s AS (SELECT COUNT(*) AS n, CAST(COUNT(*) FILTER (y = p) AS DOUBLE) AS ok FROM c)
    SELECT n AS total, ROUND(ok / n, 6) AS accuracy,
    ROUND((ok * n - tp) / SQRT((CAST(n AS DOUBLE) * n - pp) * (CAST(n AS DOUBLE) * n - tt)), 6) AS mcc FROM s, x""",
)
def multiclass_mcc(spark, sf):
    df = _labelled(spark, sf).select(
        (F.col("quality") + F.col("toxic")).alias("y"), (F.col("n_chars") % 3).cast("int").alias("p")
    )
    out = metrics.accuracy_and_mcc(df, "y", "p")
    return out.select("total", F.round("accuracy", 6).alias("accuracy"), F.round("mcc", 6).alias("mcc"))


@query(
    "best_checkpoint",
    """WITH h AS (SELECT user_id AS model, CAST(day(ts) AS INTEGER) AS epoch, AVG(value) AS metric FROM events GROUP BY ALL)
    SELECT model, arg_max(epoch, ROW(ROUND(metric, 9), -epoch)) AS epoch, ROUND(MAX(metric), 6) AS metric FROM h GROUP BY model""",
)
def best_checkpoint(spark, sf):
    history = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("model"), F.dayofmonth("ts").alias("epoch")
    ).agg(F.avg("value").alias("metric"))
    return metrics.best_checkpoint(history, "metric", ("model",)).withColumn("metric", F.round("metric", 6))


# ---- regressions ---------------------------------------------------------------------------------

_LINE = """(SELECT *, l_quantity * 3 + l_extendedprice / 1000 + l_discount * 200 AS y FROM lineitem)"""


def _line(spark, sf):
    mixed = F.col("l_quantity") * 3 + F.col("l_extendedprice") / 1000 + F.col("l_discount") * 200
    return table(spark, sf, "lineitem").withColumn("y", mixed)


@query(
    "simple_ols",
    f"""SELECT ROUND(REGR_R2(y, l_quantity), 6) AS r2, ROUND(REGR_SLOPE(y, l_quantity), 4) AS slope,
    ROUND(REGR_INTERCEPT(y, l_quantity), 3) AS intercept, COUNT(*) AS n FROM {_LINE}""",
)
def simple_ols(spark, sf):
    fit = stats.fit_ols(_line(spark, sf), "y", ("l_quantity",))
    row = {"r2": fit["r2"], "slope": fit["coef"]["l_quantity"], "intercept": fit["intercept"], "n": fit["n"]}
    return stats.single_row(spark, row).select(
        F.round("r2", 6).alias("r2"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n"
    )


@query(
    "ols_gain",
    # Adding a second predictor z to y ~ x: R2 = r_yx^2 + (partial correlation)^2 * (1 - r_yx^2).
    f"""WITH c AS (SELECT CORR(y, l_quantity) AS yx, CORR(y, l_extendedprice) AS yz,
      CORR(l_quantity, l_extendedprice) AS xz FROM {_LINE}),
    p AS (SELECT yx * yx AS base, (yz - yx * xz) * (yz - yx * xz) / (1 - xz * xz) AS added FROM c)
    SELECT ROUND(base, 6) AS r2_base, ROUND(base + added, 6) AS r2_full, ROUND(added / (1 - base), 6) AS gain FROM p""",
)
def ols_gain(spark, sf):
    gain = stats.r2_gain(_line(spark, sf), "y", ("l_quantity",), "l_extendedprice")
    row = {k: gain[k] for k in ("r2_base", "r2_full", "gain")}
    return stats.single_row(spark, row).select(*[F.round(k, 6).alias(k) for k in row])


@query(
    "spearman_by_key",
    """WITH r AS (SELECT l_returnflag, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
      RANK() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
    SELECT l_returnflag, ROUND(CORR(a, b), 6) AS rho, COUNT(*) AS n FROM r GROUP BY l_returnflag""",
)
def spearman_by_key(spark, sf):
    rows = stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", keys=("l_returnflag",))
    return rows.withColumn("rho", F.round("rho", 6))


@query(
    "ols_gain_by_key",
    f"""WITH c AS (SELECT l_returnflag, CORR(y, l_quantity) AS yx, CORR(y, l_extendedprice) AS yz,
      CORR(l_quantity, l_extendedprice) AS xz FROM {_LINE} GROUP BY l_returnflag),
    p AS (SELECT l_returnflag, yx * yx AS base, (yz - yx * xz) * (yz - yx * xz) / (1 - xz * xz) AS added FROM c)
    SELECT l_returnflag, 'y' AS variable, ROUND(base, 6) AS r2_base, ROUND(base + added, 6) AS r2_full, ROUND(added / (1 - base), 6) AS gain FROM p""",
)
def ols_gain_by_key(spark, sf):
    rows = stats.r2_gain_by(_line(spark, sf), ("y",), ("l_quantity",), "l_extendedprice", ("l_returnflag",))
    return rows.select("l_returnflag", "variable", *[F.round(k, 6).alias(k) for k in ("r2_base", "r2_full", "gain")])


@query("predictor_report")
def predictor_report(spark, sf):
    """Three dependent variables with a base of three predictors and their products."""
    line = _line(spark, sf).withColumn("pred", F.log("l_extendedprice"))
    return stats.predictor_report(
        line, ("y", "l_discount", "l_tax"), ("l_quantity", "l_linenumber", "l_suppkey")
    )


# ---- trials: four dimensions per vector as four images -------------------------------------------

# A trial is one of the 16 groups of four dimensions of a vector. The model's values of a trial are those of the vector before, so
# the trials of the first vector have no partner.
_GROUPS = 16
_VALUES = "list_transform(a.embedding[4 * g + 1:4 * g + 4], lambda x: x::DOUBLE * 10)"
_LOGITS = "list_transform(b.embedding[4 * g + 1:4 * g + 4], lambda x: x::DOUBLE)"
_EACH = f"(SELECT unnest(range({_GROUPS})) AS g)"


def _softmax_sql(xs: str, beta: str) -> str:
    e = f"list_transform({xs}, lambda v: exp({beta} * (v - list_max({xs}))))"
    return f"list_transform({e}, lambda w: w / list_sum({e}))"


def _groups(spark, sf):
    """(vec_id, label, g, four): all groups of four dimensions."""
    e = nm.as_doubles(F.col("embedding"))
    fours = F.transform(F.sequence(F.lit(0), F.lit(_GROUPS - 1)), lambda g: F.slice("e", g * 4 + 1, F.lit(4)))
    return table(spark, sf, "embeddings").select("vec_id", "label", e.alias("e")).select("vec_id", "label", F.posexplode(fours).alias("g", "four"))


def _trials(spark, sf):
    groups = _groups(spark, sf)
    trial = lambda v: (v * _GROUPS + F.col("g")).alias("trial")
    human = groups.select(trial(F.col("vec_id")), "label", F.transform("four", lambda x: x * 10).alias("values"))
    logits = groups.select(trial(F.col("vec_id") + 1), F.col("four").alias("values"))
    return trials.softmax_images(human), logits


_KL = f"""(SELECT label, beta, list_sum(list_transform(p, lambda a, i: greatest(a, 1e-10::DOUBLE) *
    ln(greatest(a, 1e-10::DOUBLE) / greatest(q[i], 1e-10::DOUBLE)))) AS kl
  FROM (SELECT a.label, beta, {_softmax_sql(_VALUES, '1.0::DOUBLE')} AS p, {_softmax_sql(_LOGITS, 'beta')} AS q
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1, {_EACH}, (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BETAS)}]) AS beta)))"""


@query(
    "trial_accuracy",
    f"""SELECT label, COUNT(*) AS n_trials, ROUND(AVG(CASE WHEN v[1] > v[2] AND v[1] > v[3]
      AND v[1] > v[4] THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
    FROM (SELECT label, embedding[4 * g + 1:4 * g + 4] AS v FROM embeddings, {_EACH}) GROUP BY label""",
)
def trial_accuracy(spark, sf):
    rows = _groups(spark, sf).select("label", F.col("four").alias("values"))
    return trials.trial_accuracy(rows, ("label",)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "softmax_images",
    f"""SELECT vec_id * {_GROUPS} + g AS trial, ROUND(p[1], 6) AS p1, ROUND(p[4], 6) AS p4
    FROM (SELECT vec_id, g, {_softmax_sql(_VALUES, '1.0::DOUBLE')} AS p FROM embeddings a, {_EACH})""",
)
def softmax_images(spark, sf):
    human, _ = _trials(spark, sf)
    return human.select(
        "trial", F.round(F.get("values", F.lit(0)), 6).alias("p1"), F.round(F.get("values", F.lit(3)), 6).alias("p4")
    )


@query("mean_kl", f"SELECT ROUND(AVG(kl), 6) AS mean_kl FROM {_KL} WHERE beta = 1.0")
def mean_kl(spark, sf):
    human, logits = _trials(spark, sf)
    return trials.mean_kl(human, trials.softmax_images(logits, 1.0)).withColumn("mean_kl", F.round("mean_kl", 6))


@query("kl_by_beta", f"SELECT beta, ROUND(AVG(kl), 6) AS mean_kl FROM {_KL} GROUP BY beta")
def kl_by_beta(spark, sf):
    human, logits = _trials(spark, sf)
    return trials.kl_by_beta(human, logits, BETAS).withColumn("mean_kl", F.round("mean_kl", 6))


@query(
    "best_grid_beta_by_group",
    f"""SELECT label, arg_min(beta, ROW(ROUND(m, 9), beta)) AS beta, ROUND(MIN(m), 6) AS mean_kl FROM
    (SELECT label, beta, AVG(kl) AS m FROM {_KL} GROUP BY ALL) GROUP BY label""",
)
def best_grid_beta_by_group(spark, sf):
    human, logits = _trials(spark, sf)
    by_beta = trials.kl_by_beta(human, logits, BETAS, ("label",))
    return trials.best_of_grid(by_beta, ("label",)).withColumn("mean_kl", F.round("mean_kl", 6))


# Narrowing grids: each level has 33 betas around the best one so far, spaced by a power of 1.26 that shrinks 16 times.
def _narrowed_sql(key: str, levels: int = 5) -> str:
    values = f"""v0 AS MATERIALIZED (SELECT {key} AS label, {_softmax_sql(_VALUES, '1.0::DOUBLE')} AS p, {_LOGITS} AS x
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1, {_EACH})"""
    parts, around = [values], "(SELECT DISTINCT label, 1.0::DOUBLE AS beta FROM v0)"
    for level in range(levels):
        step = f"pow(1600.0::DOUBLE, 1.0::DOUBLE / {32 * 16**level})"
        grid = f"least(greatest(beta * pow({step}, k - 16), 0.025::DOUBLE), 40.0::DOUBLE)"
        parts.append(f"""g{level} AS (SELECT DISTINCT label, {grid} AS beta FROM {around}, (SELECT unnest(range(33)) AS k)),
    q{level} AS (SELECT label, beta, AVG(list_sum(list_transform(p, lambda a, i: greatest(a, 1e-10::DOUBLE) *
      ln(greatest(a, 1e-10::DOUBLE) / greatest(q[i], 1e-10::DOUBLE))))) AS kl
      FROM (SELECT label, beta, p, {_softmax_sql('x', 'beta')} AS q FROM v0 JOIN g{level} USING (label)) GROUP BY ALL),
    b{level} AS (SELECT label, arg_min(beta, ROW(kl, beta)) AS beta, MIN(kl) AS kl FROM q{level} GROUP BY label)""")
        around = f"b{level}"
    return "WITH " + ",\n    ".join(parts)


@query("best_beta", f"{_narrowed_sql('0')} SELECT ROUND(beta, 2) AS beta, ROUND(kl, 6) AS mean_kl, 1e-9::DOUBLE AS error FROM b4")
def best_beta(spark, sf):
    return trials.certified_beta(*_trials(spark, sf)).select(F.round("beta", 2).alias("beta"), F.round("mean_kl", 6).alias("mean_kl"), "error")


@query("best_beta_by_group", f"{_narrowed_sql('a.label')} SELECT label, ROUND(beta, 2) AS beta, ROUND(kl, 6) AS mean_kl, 1e-9::DOUBLE AS error FROM b4")
def best_beta_by_group(spark, sf):
    return trials.best_beta_by_group(*_trials(spark, sf), "label").select(
        "label", F.round("beta", 2).alias("beta"), F.round("mean_kl", 6).alias("mean_kl"), "error"
    )


# ---- similarity ----------------------------------------------------------------------------------

# Rated pairs: part and supplier of every line item as two of the vectors, the mean quantity as rating.
_PAIRS = """(SELECT greatest(a, b) AS i, least(a, b) AS j, AVG(l_quantity) AS rating FROM (SELECT l_partkey % n AS a,
  (l_suppkey * 7) % n AS b, l_quantity FROM lineitem, (SELECT MAX(vec_id) + 1 AS n FROM embeddings)) WHERE a <> b GROUP BY ALL)"""
_SIMS = f"""(SELECT i, j, rating, list_sum(list_transform(x.embedding, lambda v, k: v::DOUBLE * y.embedding[k])) /
    SQRT(list_sum(list_transform(x.embedding, lambda v: v::DOUBLE * v)) * list_sum(list_transform(y.embedding, lambda v: v::DOUBLE * v))) AS sim
  FROM {_PAIRS} p JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j)"""


def _rated_pairs(spark, sf):
    n = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).scalar()
    a, b = F.col("l_partkey") % n, (F.col("l_suppkey") * 7) % n
    pairs = table(spark, sf, "lineitem").select(
        F.greatest(a, b).alias("i"), F.least(a, b).alias("j"), "l_quantity"
    ).where("i <> j").groupBy("i", "j").agg(F.avg("l_quantity").alias("rating"))
    return stats.pair_similarities(pairs, table(spark, sf, "embeddings"))


@query("pair_similarities", f"SELECT i, j, ROUND(rating, 6) AS rating, ROUND(sim, 6) AS sim FROM {_SIMS}")
def pair_similarities(spark, sf):
    return _rated_pairs(spark, sf).select("i", "j", F.round("rating", 6).alias("rating"), F.round("sim", 6).alias("sim"))


@query(
    "rsa_spearman",
    f"""WITH s AS (SELECT ROUND(rating, 9) AS rating, ROUND(sim, 9) AS sim FROM {_SIMS}),
    r AS (SELECT RANK() OVER (ORDER BY rating) + (COUNT(*) OVER (PARTITION BY rating) - 1) / 2 AS a,
      RANK() OVER (ORDER BY sim) + (COUNT(*) OVER (PARTITION BY sim) - 1) / 2 AS b FROM s)
    SELECT ROUND(CORR(a, b), 6) AS rho, COUNT(*) AS n FROM r""",
)
def rsa_spearman(spark, sf):
    pairs = _rated_pairs(spark, sf).withColumns({"rating": F.round("rating", 9), "sim": F.round("sim", 9)})
    return stats.rsa(pairs, "rating", "sim").withColumn("rho", F.round("rho", 6))


@query(
    "rsa_pearson",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / SQRT(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v)))) AS e,
      list_transform(embedding[1:32], lambda x: x::DOUBLE / SQRT(list_sum(list_transform(embedding[1:32], lambda v: v::DOUBLE * v)))) AS h FROM embeddings),
    p AS (SELECT list_dot_product(a.e, b.e) AS s, list_dot_product(a.h, b.h) AS t FROM u a JOIN u b ON a.vec_id > b.vec_id)
    SELECT ROUND(CORR(s, t), 6) AS r, COUNT(*) AS n_pairs FROM p""",
)
def rsa_pearson(spark, sf):
    """All pairs of vectors against all pairs of their first halves, without building a pair."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    halves = vectors.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    return stats.rsa_pearson_vectors(vectors, halves).withColumn("r", F.round("r", 6))


@query(
    "rsa_spearman_all_pairs",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / SQRT(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v)))) AS e,
      list_transform(embedding[1:32], lambda x: x::DOUBLE / SQRT(list_sum(list_transform(embedding[1:32], lambda v: v::DOUBLE * v)))) AS h FROM embeddings),
    p AS (SELECT ROUND(list_dot_product(a.e, b.e), 6) AS s, ROUND(list_dot_product(a.h, b.h), 6) AS t FROM u a JOIN u b ON a.vec_id > b.vec_id),
    r AS (SELECT RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2 AS a,
      RANK() OVER (ORDER BY t) + (COUNT(*) OVER (PARTITION BY t) - 1) / 2 AS b FROM p)
    SELECT ROUND(CORR(a, b), 6) AS rho, COUNT(*) AS n_pairs FROM r""",
)
def rsa_spearman_all_pairs(spark, sf):
    """All pairs of vectors against all pairs of their first halves: ranks of pairs of which none becomes a row."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    halves = vectors.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    return pair_ranks.rsa_spearman_vectors(vectors, halves).select(F.round("rho", 6).alias("rho"), "n_pairs")


# ---- age of acquisition --------------------------------------------------------------------------

# Words are users; "16".."30" are the share of clicks and views per hour of the day (24 hours on 15 ages).
_HOURS = range(16, 31)


def _cdi(spark, sf):
    hour = (F.hour("ts") % 15 + 16).alias("hour")
    known = F.col("event_type").isin("click", "view").cast("double")
    return (
        table(spark, sf, "events").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("word"), hour, known.alias("known"))
        .groupBy("word").pivot("hour", list(_HOURS)).agg(F.round(F.avg("known"), 6))
    )


_LONG = """(SELECT 'w' || user_id AS word, CAST(hour(ts) % 15 + 16 AS INTEGER) AS age,
  ROUND(AVG(CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0 END), 6) AS proportion
  FROM events GROUP BY ALL)"""


@query("cdi_unpivot", f"SELECT word, age, proportion FROM {_LONG}")
def cdi_unpivot(spark, sf):
    return acquisition.cdi_to_long(_cdi(spark, sf))


@query(
    "monthly_means",
    f"""WITH m AS (SELECT age, AVG(proportion) AS s FROM {_LONG} GROUP BY age)
    SELECT age, ROUND(s, 6) AS mean_score FROM m UNION ALL SELECT NULL, ROUND(AVG(s), 6) FROM m""",
)
def monthly_means(spark, sf):
    return acquisition.monthly_means(_cdi(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


@query(
    "parse_step",
    r"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ROUND(CAST(value AS DOUBLE), 2) *
      ([1.0::DOUBLE, 1e3, 1e6, 1e9])[event_id % 4 + 1] END AS step_num FROM events""",
)
def parse_step(spark, sf):
    number = F.format_string("%.2f", F.col("value"))
    unit = F.get(F.array(*[F.lit(u) for u in ("", "k", " M", "B")]), (F.col("event_id") % 4).cast("int"))
    step = F.when(F.col("event_id") % 11 == 0, F.lit("main")).otherwise(F.concat(F.lit("chck_"), number, unit))
    return table(spark, sf, "events").select("event_id", nm.parse_step(step).alias("step_num"))


def _surprisal(spark, sf):
    """Learning curves: the value of an event, lowered with the day, is the surprisal at that step."""
    day = F.dayofmonth("ts")
    return acquisition.with_step_number(
        table(spark, sf, "events").select(
            F.format_string("chck_%dM", day).alias("step"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("target_word"),
            (F.lit(16.0) - 10.0 / (1.0 + F.exp(-(F.log10(day * 1e6) - 6.7) * 4)) + F.col("value") / 1000).alias("surprisal"),
        )
    )


@query(
    "step_statistics",
    """SELECT 'w' || user_id AS target_word, day(ts) * 1e6::DOUBLE AS step_num, COUNT(*) AS n,
    ROUND(AVG(16.0::DOUBLE - 10.0::DOUBLE / (1 + EXP(-(LOG10(day(ts) * 1e6::DOUBLE) - 6.7::DOUBLE) * 4)) + value / 1000), 6) AS mean_y
    FROM events GROUP BY ALL""",
)
def step_statistics(spark, sf):
    return acquisition.step_statistics(_surprisal(spark, sf)).select(
        "target_word", "step_num", "n", F.round("mean_y", 6).alias("mean_y")
    )


@query("aoa_curves")
def aoa_curves(spark, sf):
    child = acquisition.child_aoa(acquisition.cdi_to_long(_cdi(spark, sf)))
    model = acquisition.model_aoa(_surprisal(spark, sf))
    return child.join(model, "word")


@query("curve_fitness")
def curve_fitness(spark, sf):
    child = acquisition.child_aoa(acquisition.cdi_to_long(_cdi(spark, sf)))
    return acquisition.curve_fitness(child, acquisition.model_aoa(_surprisal(spark, sf)))
