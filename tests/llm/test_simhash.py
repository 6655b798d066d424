"""SimHash: fingerprints, the vantage-point trees and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lexmill.llm import queries, simhash


def brute_print(text):
    """The fingerprint by the definition, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """Label of each print: the index of the first one reachable, by comparing all pairs."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for k in range(i):
            if (int(a) ^ int(prints[k])).bit_count() <= radius:
                x, y = root(i), root(k)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def brute(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    labels = brute_components(prints, radius)
    least = {}
    for (doc_id, _), c in zip(rows, labels):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, labels)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def near_texts(rng, groups, copies):
    rows, at = [], 0
    for _ in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 300))]
        for _ in range(copies):
            edited = list(words)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(edited))] = "Edited"
            rows.append((at, " ".join(edited)))
            at += 1
    return rows


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "A b C d e", "Ä   x\x0by \x1f z w", "same " * 9, "w " * 3000 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


def test_documents_equal_brute_force(documents):
    rng = random.Random(5)
    rows = near_texts(rng, 60, 6) + [(1000, None), (1001, ""), (1002, "  "), (None, "lost words of nobody at all"), (3, "w1 w2"), (3, "w1 w2")]
    assert result(simhash.near_duplicates(documents(rows))) == brute(rows)


def test_empty_table(documents):
    assert result(simhash.near_duplicates(documents([(1, "x")]).where("false"))) == []


def clouds(rng, centres, each, flips):
    """Distinct fingerprints around some centres, as chains of a few flipped bits."""
    out = set()
    for _ in range(centres):
        value = rng.getrandbits(64)
        for _ in range(each):
            for _ in range(rng.randrange(flips + 1)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return np.array(sorted(out), np.uint64)


def joined(n, links):
    label = np.arange(n)
    for a, b in links:
        label[label == label[b]] = label[a]
    return label


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("centres,each,flips", [(400, 1, 1), (4, 150, 3), (1, 600, 1), (40, 15, 6)])
def test_forest_equals_all_pairs(monkeypatch, centres, each, flips):
    monkeypatch.setattr(simhash, "LEAF", 16)
    prints = clouds(random.Random(centres), centres, each, flips)
    rows = np.arange(len(prints))
    found = simhash.forest(prints, rows, rows, 4)
    assert all((int(prints[a]) ^ int(prints[b])).bit_count() <= 4 for a, b in found)
    assert len(found) == len(prints) - len(set(brute_components(prints)))
    assert same_partition(joined(len(prints), found).tolist(), brute_components(prints))


@pytest.mark.parametrize("shape", ["corners", "star"])
def test_forest_ends_where_most_members_are_farthest(monkeypatch, shape):
    monkeypatch.setattr(simhash, "LEAF", 16)
    base = np.uint64(0x0123456789ABCDEF)
    values = {"corners": [base ^ np.uint64(1 << i) for i in range(64)], "star": [base] + [base ^ np.uint64(0b111111 << i) for i in range(58)]}[shape]
    prints = np.unique(np.array(values, np.uint64))
    rows = np.arange(len(prints))
    assert same_partition(joined(len(prints), simhash.forest(prints, rows, rows, 4)).tolist(), brute_components(prints))


def test_shards_lose_no_link(spark, monkeypatch):
    """Many small shards with several units each give the components of all pairs."""
    from lexmill.llm.minhash import components

    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "UNIT_VISITORS", 50)
    prints = clouds(random.Random(9), 90, 10, 4)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print bigint")
    label = {r["node"]: r["label"] for r in components(simhash.links(table), "test-edges").collect()}
    got = [label.get(int(p), int(p)) for p in prints.view(np.int64)]
    assert same_partition(got, brute_components(prints))


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op11_simhash_dedup"](spark, folder)) == brute(rows)
