"""Normalisation holds few texts of an Arrow batch as Python strings."""

import unicodedata

import pyarrow as pa

from lexmill.functions import text as tx


def test_large_batches_pass_in_slices():
    texts = [None if i % 7 == 0 else f"é ﬁ {i}" for i in range(1000)]
    out = list(tx._normalizer("NFKD").func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(len(a) for a in out) <= tx.NORMALIZED_ROWS < 1000
    assert [t for a in out for t in a.to_pylist()] == [t and unicodedata.normalize("NFKD", t) for t in texts]


def test_slices_join_their_rows(spark):
    rows = [(i, None if i % 5 == 0 else f"é {i}" if i % 2 else f"plain {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    got = {r["i"]: r["n"] for r in df.select("i", tx.normalize_nfkd(df["t"]).alias("n")).collect()}
    assert got == {i: t and unicodedata.normalize("NFKD", t) for i, t in rows}
