import random
import re

import pytest

from lexmill.llm import minhash


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return out


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def check(spark, documents, rows):
    got = [tuple(r) for r in minhash.near_duplicates(documents(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_edge_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "two one"), (7, "É a b c d"), (8, "é a b c d"),
            (9, "a\u00a0b c d e f"), (9, "a\u00a0b c d e f"), (None, "one two"), (None, "only without id here at all"), (10, "x " * 5000)]
    check(spark, documents, rows)


def test_empty_table(spark, documents):
    assert minhash.near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("block", [512, 16])
def test_near_copies_on_both_sides_of_the_threshold(spark, documents, monkeypatch, block):
    """A large group of near copies whose similarities straddle the threshold, in one block and in many."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    rng = random.Random(5)
    base = words(rng, 220)
    rows = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(90)]
    rows += [(100 + i, " ".join(words(rng, 60))) for i in range(40)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # exact copies
    shared = words(rng, 150)
    rows += [(300 + i, " ".join(shared + words(rng, rng.randrange(10, 60)))) for i in range(30)]
    rng.shuffle(rows)
    check(spark, documents, rows)


def test_every_pair_within_the_distance_has_a_common_key(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (50, minhash.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.SYMBOLS, minhash.MAX_DIFFER, replace=False)] += 1
    def keys(sig):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(sig)), pa.int64()), pa.array([s.tobytes() for s in sig])], ["cid", "sig"])
        out = {}
        for r in minhash._keyed(iter([batch])):
            for k, c in zip(r.column("key").to_pylist(), r.column("cid").to_pylist()):
                out.setdefault(c, set()).add(k)
        return out
    ka, kb = keys(a), keys(b)
    assert all(ka[i] & kb[i] for i in range(50))


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
