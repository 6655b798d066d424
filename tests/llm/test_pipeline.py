"""The stages of the pipeline, each on what its predecessor kept."""

from collections import Counter

import pytest

import corpus_pipeline
from lexmill.llm import mixing, secret_scan
from test_near_duplicates import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Rows before and after every stage, over a part of the small table with odd rows added."""
    given = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(250).collect()]
    odd = [(5000, None, None, "src1", None), (5001, "", "en", "src1", 0), (5002, "%%% 123", None, None, 7), (5003, given[3][1], "en", "src2", 1), (5003, given[3][1], "en", "src2", 1),
           (5004, given[5][1] + " api_key = abcdefghij0123456789", None, "src3", 1), (None, given[6][1], "en", "src3", 1)]
    docs = spark.createDataFrame(given + odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, "unused").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_order_and_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secrets", "mix", "pack"]
    for rows in staged[1:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_language_rejects_what_has_none_and_keeps_the_rest(staged):
    before, after = Counter(r["doc_id"] for r in staged[0]), Counter(r["doc_id"] for r in staged[1])
    assert before - after == Counter({5000: 1, 5001: 1, 5002: 1})
    assert all(r["lang"] for r in staged[1])


def test_one_document_of_each_group_stays(staged):
    rows = [(r["doc_id"], r["text"]) for r in staged[1]]
    expected = {d for d, _, _, kept in brute(rows) if kept}
    assert Counter(r["doc_id"] for r in staged[2]) == Counter(expected)


def test_secrets_are_marked(staged):
    before = {r["doc_id"]: r["text"] for r in staged[2]}
    assert {r["doc_id"] for r in staged[3]} == set(before)
    import re

    for r in staged[3]:
        assert r["n_chars"] == len(r["text"])
        for m in re.finditer(secret_scan.ASSIGN.replace("(?i:", "(?i:"), r["text"]):
            assert len(m[2]) < 12 or corpus_pipeline.MARK in m[0]
        assert not re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r["text"])
        if r["text"] == before[r["doc_id"]]:
            assert corpus_pipeline.MARK not in r["text"]
    assert sum(corpus_pipeline.MARK in r["text"] for r in staged[3]) >= 3


def test_mix_repeats_documents(spark, staged):
    docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in staged[3]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    expected = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in staged[4]) == expected


def test_everything_mixed_is_packed(staged):
    first = Counter(r["doc_id"] for r in staged[5] if r["piece"] == 0)
    assert first == Counter(r["doc_id"] for r in staged[4])
    load = Counter()
    for r in staged[5]:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 1024


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert out.collect() == []
