"""URL filter: allow and block rules, and logistic regression on hashed character n-grams of host and path for the rest.

The classifier is fitted on a small labelled URL table: at most ``max_labels`` of the given labels and of the URLs that the rules decide
(chosen by a hash), so it extends the rules to URLs that none fits. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numeric import let
from lexmill.llm.ngramhash import codes, hashed_ngrams

BITS = 14
ORDERS = (3, 4)
HOST_MARK, PATH_MARK = 0x110000, 0x110001  # beyond all code points, so that host and path n-grams differ
STEPS = 300


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct<size, host_size, action, text>, or null; of equal length the one with the longer host, then block.

    Rules are looked up by the suffixes of the host at dots, in a map that holds them all: their list is a parameter and
    lives on the driver.
    """
    kind = "array<struct<size:int,host_size:int,action:string,text:string,path:string>>"
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        if r.action not in ("allow", "block"):
            raise ValueError(f"unknown action {r.action}")
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<size:int,host_size:int,action:string,text:string>")
    items: list[Column] = []
    for name, own in by_host.items():
        fields = [F.struct(F.lit(len(r.text)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.action).alias("action"), F.lit(r.text).alias("text"), F.lit(r.path).alias("path")) for r in own]
        items += [F.lit(name), F.array(*fields).cast(kind)]
    table = F.create_map(*items)
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(kind))))
    fitting = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["host_size"], r["action"], r["text"])))


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path, each with its marks at both ends."""
    parts = []
    for mark, s in ((HOST_MARK, host), (PATH_MARK, path)):
        p = np.concatenate([[np.uint32(mark)], codes(s), [np.uint32(mark)]]).astype(np.uint32)
        parts.append(hashed_ngrams(p, ORDERS, BITS))
        if mark == HOST_MARK:  # the labels of the host as a whole, so that short ones are seen
            parts.append(hashed_ngrams(np.concatenate([[np.uint32(mark)], codes("." + s.rpartition(".")[2])]).astype(np.uint32), (2, 3), BITS))
    return np.unique(np.concatenate(parts))


def fit(examples: list[tuple[str, str, bool]], l2: float = 1.0, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the bias) of the probability that a URL is to be blocked, by accelerated gradient descent.

    Classes weigh equally. Without examples of both classes all weights are zero, which allows everything.
    """
    size = (1 << BITS) + 1
    w = np.zeros(size)
    y = np.array([b for _, _, b in examples], float)
    if not len(y) or y.min() == y.max():
        w[-1] = -1.0
        return w
    rows = [grams(h, p) for h, p, _ in examples]
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = 1.0 / np.sqrt(np.bincount(owner))[owner]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(owner, weights=value * v[flat], minlength=len(y)) + v[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(flat, weights=value * error[owner], minlength=size)
        g[-1] = error.sum()
        g += l2 / len(y) * np.append(v[:-1], 0)
        after = v - 2.0 * g
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = after + (t - 1) / t_after * (after - w)
        w, t = after, t_after
    return w


def probability(host: str, path: str, w: np.ndarray) -> float:
    at = grams(host, path)
    z = w[at].sum() / np.sqrt(max(len(at), 1)) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, max_labels: int = 4000, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score (of the classifier).

    ``labelled``: url and label (allow or block). Defined cases: a null URL or one without ``://`` has empty host and path and is
    judged by the classifier like any other; the URL's other columns are not read; equal URLs get equal verdicts; an
    empty table gives no rows; without labels of both kinds the classifier allows.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    known = ruled.where("_rule is not null").select("host", "path", F.col("_rule.action").alias("label"))
    if labelled is not None:
        given = labelled.where("label in ('allow', 'block')").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
        known = known.unionByName(given)
    # half of the bound for each label, by a hash of the URL: at most max_labels rows reach the driver
    picked = []
    for label in ("allow", "block"):
        each = known.where(F.col("label") == label).select("host", "path").distinct()
        picked += [(r["host"], r["path"], label == "block") for r in each.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labels // 2).collect()]
    w = fit(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [probability(h, p, w) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            verdict = [a or ("block" if s >= threshold else "allow") for a, s in zip(batch.column("action").to_pylist(), score)]
            names = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], [*names, "verdict", "block_score"])

    flat = ruled.select(F.col("page_id").cast("bigint").alias("page_id"), "host", "path", F.col("_rule.text").alias("rule"), F.col("_rule.action").alias("action"))
    return flat.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, block_score double")
