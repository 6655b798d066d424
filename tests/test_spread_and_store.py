"""Tasks of turns that grow, and costly columns that several passes read."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from lexmill.operators import tokens as tk


def test_masked_turns_are_dealt_to_all_partitions(spark):
    for mode in ("mlm", "mntp", "enc_dec_mask"):
        masked = queries()[f"mask_each_position_{mode}"](spark, "/root/testdata/sf0.001")
        assert masked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_random_offset_chunks_compute_tokens_once(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def costly(i):
        asked.add(1)
        return [i] * 10

    docs = spark.range(40).select(F.col("id").alias("doc_id"), costly("id").alias("tokens"))
    found = tk.random_offset_chunks(docs, 8, 1).collect()
    assert len(found) == 49 and {len(r["tokens"]) for r in found} == {8}
    assert asked.value == 40
