"""Shards, mix and searches: laws and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import hnsw, mixing, sharding, vafile
from lexmill.llm.hnsw import Graph

SF = "/root/testdata/sf0.01"


# ---- shards -----------------------------------------------------------------------------------------

def placed(df, shards):
    got = sharding.assign_shards(df, shards).collect()
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_shards_are_near_equal_and_keep_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = placed(docs, 40)
    assert len(got) == len(text)
    load, rows, of_text = Counter(), Counter(), defaultdict(set)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        load[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
        of_text[text[r["doc_id"]]].add(r["shard"])
    mean = sum(load.values()) / 40
    assert max(load.values()) < 1.04 * mean and min(load.values()) > 0.96 * mean
    assert max(rows.values()) - min(rows.values()) <= 4
    assert all(len(s) == 1 for s in of_text.values())


def test_shard_edges(spark, documents):
    hot = [(i, "the same text again and again") for i in range(300)]  # over a third of all rows: split
    rows = hot + [(1000 + i, f"text number {i} " * (i % 7)) for i in range(400)] + [(2000, None), (2001, ""), (2002, "x" * 200_000), (2003, "rep"), (2003, "rep"), (None, "rep")]
    got = placed(documents(rows), 8)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"] in (2000, 2001)} == {2000: 16, 2001: 16}
    per = Counter(r["shard"] for r in got if r["doc_id"] is not None and r["doc_id"] < 300)
    assert len(per) > 1
    again = sharding.assign_shards(documents(rows), 8).collect()
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.assign_shards(documents([]), 8).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(documents([]), 0)


# ---- mix --------------------------------------------------------------------------------------------

def brute_mix(rows):
    """taken per row, in order of ``rows``: water filling, then documents in order of their hashes."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(size))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = [0] * len(rows)
    for s in sources:
        if not total[s]:
            continue
        times = int(target[s] // total[s])
        budget = target[s] - times * total[s]
        own = defaultdict(list)
        for i, (d, t, x) in enumerate(rows):
            if x == s:
                taken[i] = times * size[i]
                own[int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)].append(i)
        at = 0
        for h in sorted(own):
            n = sum(size[i] for i in own[h])
            if at + n >= budget and not at + n - budget < budget - at:
                break
            for i in own[h]:
                taken[i] += size[i]
            at += n
            if at >= budget:
                break
    return size, target, taken


@pytest.mark.parametrize("case", ["given", "odd", "small sources"])
def test_mix_equals_brute_force(spark, documents, case):
    if case == "given":
        rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    elif case == "odd":
        rows = [(i, "w " * (i % 9), ["a", "b", None, "ü", "z"][i % 5]) for i in range(200)]
        rows += [(900, None, "a"), (901, "", "empty"), (902, "x y", "b"), (902, "x y", "b"), (None, "q r s", None), (903, "long " * 50_000, "b")]
    else:
        rows = [(i, "w " * 10, "big") for i in range(100)] + [(500 + i, "v w", f"s{i}") for i in range(7)]
    size, target, taken = brute_mix(rows)
    got = mixing.mix(documents([(d, t, None, s) for d, t, s in rows]))
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    key = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    expected = sorted(((d, n, round(target[s], 6), k) for (d, _, s), n, k in zip(rows, size, taken)), key=key)
    found = got.collect()
    assert sorted(((r["doc_id"], r["size"], round(r["target"], 6), r["taken"]) for r in found), key=key) == expected
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    copies = mixing.mixed(documents([(d, t, None, s) for d, t, s in rows]))
    assert copies.count() == sum(r["copies"] for r in found)


def test_empty_mix(spark, documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed(documents([])).collect() == []


# ---- searches ---------------------------------------------------------------------------------------

BAD = [None, [], [float("nan")] * 4, [1.0, None, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0]]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    return df.withColumns({k: F.lit(1) for k in ("class_id", "score", "rank", "ids", "n", "query_id")})


def brute_top(rows, asked, k, nonzero=False):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (not nonzero or any(v)):
            good[i] = np.array(v)
    out = []
    for i, v in rows:
        if i in good and asked(i):
            hits = sorted(((float(good[i] @ w), j) for j, w in good.items() if j != i), key=lambda x: (-x[0], x[1]))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vafile, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-6, 7, 4)]) for i in range(300)]  # many ties
    rows += [(300 + i, [3.0, 3.0, -2.0, 1.0]) for i in range(150)] + [(500 + 10 * i, v) for i, v in enumerate(BAD)] + [(600, [0.0] * 4), (None, [1.0] * 4)]
    got = [tuple(r) for r in vafile.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_exact_search_edges(spark):
    every = F.lit(True)
    assert vafile.top_k(vectors(spark, []), every).collect() == []
    assert vafile.top_k(vectors(spark, [(1, None)]), every).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [0.5, -1.0]), (2, [0.5, -1.0]), (3, [1.0, 2.0])]
    got = {tuple(r) for r in vafile.top_k(vectors(spark, rows), every, 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == set(brute_top(rows, lambda i: True, 5))


def test_graph_search_recall_and_form(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows += [(10_000 + i, rows[7][1]) for i in range(100)] + [(20_000 + 20 * i, v) for i, v in enumerate(BAD)] + [(30_000, [0.0] * 64)]
    got = defaultdict(list)
    for r in hnsw.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    expected = defaultdict(list)
    for q, rank, v, s in brute_top(rows, lambda i: i % 20 == 0, 20, nonzero=True):
        expected[q].append((rank, v, s))
    assert set(got) == set(expected)
    vector, hits = dict(rows), 0
    for q, each in got.items():
        each.sort()
        assert [r for r, _, _ in each] == list(range(1, 21)) and q not in {v for _, v, _ in each}
        assert all(abs(s - float(np.dot(vector[q], vector[v]))) < 1e-12 for _, v, s in each)
        assert [(-s, v) for _, v, s in each] == sorted((-s, v) for _, v, s in each)
        hits += len({v for _, v, _ in each} & {v for _, v, _ in expected[q]})
    assert hits / (20 * len(expected)) >= 0.95


def test_graph_search_edges(spark):
    every = F.lit(True)
    assert hnsw.nearest(vectors(spark, []), every).collect() == []
    assert hnsw.nearest(vectors(spark, [(1, [0.0, 0.0])]), every).collect() == []
    got = hnsw.nearest(vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0, 0.0])]), every, 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 2, 2.0), (1, 2, 3, 1.0), (2, 1, 1, 2.0), (2, 2, 3, 2.0), (3, 1, 2, 2.0), (3, 2, 1, 1.0)]


def test_graph_is_stored_flat_and_reloads():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8))
    graph = Graph(x).build()
    again = Graph.of(x, graph.flat())
    q = rng.normal(size=(40, 8))
    assert (graph.search(q, 5) == again.search(q, 5)).all()
    exact = np.argsort(((q[:, None, :] - x[None]) ** 2).sum(-1), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(again.search(q, 5), exact)]) > 0.95
