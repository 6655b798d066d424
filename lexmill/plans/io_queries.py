"""Readers and writers over the given tables: a table is written below the shared folder and read back.

The SQL states the rows of the table itself, so a reader or writer that loses, doubles or alters rows differs from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import scoring
from lexmill.plans.registry import query, table
from lexmill.session import shared_path
from lexmill.sources import readers, writers


@query("read_text_corpus", "SELECT p_name AS text, COUNT(*) AS n, 0 AS gaps FROM part GROUP BY p_name")
def read_text_corpus(spark, sf):
    """Lines of many files (one folder of files per brand): every line once, numbers dense in each file."""
    path = shared_path(spark, "corpus")
    table(spark, sf, "part").select("p_brand", "p_name").write.partitionBy("p_brand").text(path)
    lines = readers.read_text_corpus(spark, path, "*.txt")
    gaps = lines.groupBy("path").agg((F.max("line_no") + 1 - F.count_distinct("line_no")).alias("g")).agg(F.sum("g")).scalar()
    return lines.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("gaps", gaps.cast("int"))


@query("read_jsonl_items", "SELECT conv_id, turn, role, text FROM conversations")
def read_jsonl_items(spark, sf):
    path = shared_path(spark, "items")
    table(spark, sf, "conversations").write.json(path)
    items = readers.read_jsonl_items(spark, path, "conv_id bigint, turn bigint, role string, text string", "*.json")
    return items.select("conv_id", "turn", "role", "text")


@query("read_labeled_jsonl", "SELECT doc_id, quality, toxic FROM labels")
def read_labeled_jsonl(spark, sf):
    """Written as folders of JSON lines by label, read as one table (the label is in the folder's name)."""
    path = shared_path(spark, "labelled")
    writers.write_partitioned_jsonl(table(spark, sf, "labels"), path, "quality")
    return readers.read_labeled_jsonl(spark, path, "doc_id bigint, toxic int, quality int").select("doc_id", "quality", "toxic")


@query(
    "read_csv",
    """SELECT o_orderkey, ROUND(o_totalprice, 6) AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE o_orderstatus END AS o_orderstatus,
    o_orderpriority FROM orders""",
)
def read_csv(spark, sf):
    """Scores written as CSV; a missing status is read as the text ``None``."""
    path = shared_path(spark, "scores")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", status.alias("o_orderstatus"), "o_orderpriority")
    writers.write_scores_csv(rows, path)
    back = readers.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string", ("o_orderstatus",))
    return back.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("read_word_list", "SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''")
def read_word_list(spark, sf):
    path = shared_path(spark, "words") + ".txt"
    table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).write.text(path)
    return readers.read_word_list(spark, path)


@query("read_vectors", "SELECT vec_id, len(embedding) AS d, ROUND(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def read_vectors(spark, sf):
    path = shared_path(spark, "vectors")
    table(spark, sf, "embeddings").select("vec_id", "embedding").write.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return readers.read_vectors(spark, path).select("vec_id", F.size("embedding").cast("bigint").alias("d"), F.round(total, 6).alias("total"))


@query("write_text", "SELECT printf('%012d', event_id) || ' ' || event_type AS line FROM events")
def write_text(spark, sf):
    """Lines in order; read back as they stand."""
    path = shared_path(spark, "lines")
    rows = table(spark, sf, "events").select("event_id", F.format_string("%012d %s", "event_id", "event_type").alias("line"))
    writers.write_text(rows, path, ["event_id"], "line")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "write_results",
    """SELECT event_type AS model, 'main' AS revision, CAST(month(ts) AS VARCHAR) AS task, COUNT(*) AS n, ROUND(SUM(value), 4) AS total
    FROM events GROUP BY ALL""",
)
def write_results(spark, sf):
    """Stored results in folders by model, revision, backend, task and dataset; an empty revision is ``main``."""
    path = shared_path(spark, "results")
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.lit(None).cast("string").alias("revision"), F.lit("causal").alias("backend"),
        F.month("ts").cast("string").alias("task"), F.lit("d").alias("dataset"), "event_id", "value",
    )
    writers.write_results(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("model", "revision", "task").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("write_jsonl_report", "SELECT c_custkey, c_mktsegment, ROUND(c_acctbal, 6) AS c_acctbal FROM customer")
def write_jsonl_report(spark, sf):
    path = shared_path(spark, "report")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    writers.write_jsonl_report(rows, path)
    return spark.read.schema(rows.schema).json(path).withColumn("c_acctbal", F.round("c_acctbal", 6))


def _length_scorer(batches):
    """A fixed model: every code point of the sentence costs one nat."""
    for batch in batches:
        yield batch.assign(logprob=-batch["sentence"].str.len().astype(float))


@query("score_with", "SELECT conv_id, turn, -CAST(length(text) AS DOUBLE) AS logprob FROM conversations")
def score_with(spark, sf):
    candidates = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("sentence"))
    return scoring.score_with(candidates, _length_scorer).select("conv_id", "turn", "logprob")
