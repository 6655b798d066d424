"""Every stage of the pipeline keeps columns that are named like columns the operators make."""

import corpus_pipeline
from pyspark.sql import functions as F

NAMES = ["_tokens", "_spans", "_assign", "_times", "_copy", "_row", "lang_pred", "score", "_key", "row_key", "_below", "_source", "held_out", "kept", "size"]


def test_stages_keep_clashing_columns(spark):
    words = "the house on the hill was old and nobody had lived there for many years until a family came from the town".split()
    rows = [(i, " ".join(words[i % 7 :] + [f"name{i}"] + words), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in NAMES), name
    assert corpus_pipeline.pack(spark, docs, "").count() >= 40
