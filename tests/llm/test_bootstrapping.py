"""Personal data: patterns that only confirmed identifiers support, and the graph's confident patterns against brute force."""

import math
import random
from collections import defaultdict

from lexmill.llm import pii


def brute_confident(edges):
    """Confident patterns of distinct (pattern, instance, is seed) edges, with plain dictionaries."""
    edges = set(edges)
    n, seeds, free, behind = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(set)
    for p, i, seed in edges:
        n[p] += 1
        seeds[p] += seed
        if not seed:
            free[p].add(i)
            behind[i].add(p)
    score = {p: seeds[p] / (n[p] + 1) for p in n}
    good = {p for p in n if score[p] >= pii.CONFIDENT and seeds[p] >= pii.MIN_SEEDS}
    rounds = 0
    while True:
        confirmed = {i for i in behind if behind[i] & good}
        s = {i: 1.0 if i in confirmed else 1 - math.prod(1 - min(score[p], 0.999) for p in behind[i]) for i in behind}
        score = {p: (seeds[p] + sum(s[i] for i in free[p])) / (n[p] + 1) for p in n}
        more = {p for p in n if score[p] >= pii.CONFIDENT and seeds[p] + len(free[p] & confirmed) >= pii.MIN_SEEDS}
        rounds += 1
        if rounds >= pii.ROUNDS and more <= good:
            return good
        good |= more


def test_confident_patterns_equal_brute_force(spark):
    rng = random.Random(8)
    rows, edges = [], set()
    for chain in range(6):  # each chain of patterns shares most identifiers with the one before it; only the first has seeds
        for step in range(7):
            at = range(step * 3, step * 3 + rng.choice([5, 9, 12]))
            for i in at:
                seed = step == 0 and i < rng.choice([6, 9])
                rows.append((f"c{chain} p{step}:", f"{chain}-{i}{'s' if seed else ''}", seed))
    for k in range(200):
        rows.append((f"noise {rng.randrange(30)}", f"{rng.randrange(6)}-{rng.randrange(25)}", False))
    edges = set(rows)
    span = "array<struct<start:int,end:int,value:string,patterns:array<string>>>"
    table = [([(0, 1, i, [p])] if s else [], [] if s else [(0, 1, i, [p])]) for p, i, s in rows + rows[:20]]
    found = spark.createDataFrame(table, f"_seeds {span}, _tokens {span}")
    expected = brute_confident(edges)
    assert {r["pattern"] for r in pii.confident_patterns(found).collect()} == expected
    assert any(p.endswith("p2:") for p in expected)


def texts(label, count=10):
    rows = [(i, f"Account holder: user{i}@mail{i}.example wrote again") for i in range(30)]
    rows += [(100 + i, f"Account holder: QX-{70000 + 37 * i} wrote again") for i in range(count)]
    rows += [(200 + i, f"{label} QX-{70000 + 37 * i} was here") for i in range(count)]
    rows += [(300, f"{label} QX-99123 was here")]
    rows += [(400 + i, f"Chapter number: {10000 + i} of the story") for i in range(50)]
    return rows


def test_confirmed_identifiers_make_further_patterns(documents):
    got = {r["doc_id"]: r["spans"] for r in pii.extract(documents(texts("Staff badge:"))).collect()}
    assert all("context:" in got[100 + i] and "context:" in got[200 + i] for i in range(10))
    assert "context:" in got[300]  # an identifier that stands behind a pattern without seeds only
    assert all(got[400 + i] == "" for i in range(50))


def test_too_few_confirmed_identifiers_confirm_nothing(documents):
    got = {r["doc_id"]: r["spans"] for r in pii.extract(documents(texts("Staff badge:", count=3))).collect()}
    assert got[300] == ""
