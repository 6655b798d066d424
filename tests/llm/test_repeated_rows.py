"""Shards of a table in which one row is repeated very often."""

from collections import Counter

from lexmill.llm import sharding


def test_a_group_of_repeated_rows_is_split(spark, documents):
    rows = [(i, f"text number {i} of its own") for i in range(400)]
    rows += [(7000, "the same row again and again")] * 1500 + [(None, "without an id, the same text")] * 1500
    got = sharding.assign_shards(documents(rows), shards=10).collect()
    assert len(got) == len(rows)
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 10 and max(load.values()) <= 1.1 * sum(load.values()) / 10
    for s in load:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
