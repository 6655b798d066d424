import pytest

# Columns that no operator reads, named like columns the operators make.
CLASHING = {"kept": True, "cid": "x", "n": 7, "key": "k", "group": "g", "shard": 99, "rank": 1, "rule": "r", "host": "h", "spans": "s", "taken": 5, "_key": "z", "_row": 1}


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text[, lang, source]) with the usual columns and many clashing ones."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("bigint"))
        return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})

    return make
