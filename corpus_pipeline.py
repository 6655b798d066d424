"""A corpus pipeline over ``documents``: language, near-duplicates, secrets, mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents. Defined cases: empty tables pass through; null texts have no language and go with
the first stage; columns beside those of documents are kept, whatever their names, by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import langid, minhash, mixing, packing, secret_scan
from lexmill.llm.common import stored, with_keys
from lexmill.llm.queries import tokenizer_path
from lexmill.llm.spans import redacted

# Documents without a letter are rejected, and those of which no language is more likely than this (chance is a quarter for four).
MIN_SCORE = 0.3
MARK = "[SECRET]"
# Percent of common word shingles from which documents are near-duplicates (op1 has a threshold of its own).
NEAR = 80


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with the other columns under names that no operator makes, and under their own ones again behind it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        out = stage(spark, docs.toDF(*[c if c in COLUMNS else f"carried column {i}" for i, c in enumerate(names)]), sf_dir)
        return out.toDF(*names)

    return run_stage


@_own_names
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified (lang becomes the prediction where it was null)."""
    found = langid.identify(docs).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    named = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return named.select(*docs.columns)


@_own_names
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates; documents without words are in no group.

    Decided by row, by a hash of doc_id and text: rows that share their doc_id with other texts stand each for itself, and only rows of
    one group, or equal in doc_id and text, are reduced to one. Rows of a group in which none has a doc_id stay. Only hashes are joined back.
    """
    group = F.xxhash64("doc_id", F.coalesce("label", "row_key"))
    rows = stored(minhash.near_duplicates(docs, percent=NEAR, by_row=True).select("doc_id", "kept", "row_key", group.alias("group")), "kept")
    named = rows.where("kept and doc_id is not null")
    # several rows with the doc_id that names their group: those with the least hash stay, and one of them
    several = stored(named.groupBy("group").agg(F.min("row_key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    lost = rows.where("not kept").select("row_key")
    repeats = not several.isEmpty()
    if repeats:
        lost = lost.union(with_keys(with_keys(named, several, "group"), several.withColumnRenamed("least", "row_key"), "row_key", without=True).select("row_key"))
    marked = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("bigint"), "text"))
    out = with_keys(marked, stored(lost.select(F.col("row_key").alias("_row")).distinct(), "lost"), "_row", without=True)
    if not repeats:
        return out.select(*docs.columns)
    again = several.select(F.col("least").alias("_row"))
    once = with_keys(out, again, "_row").dropDuplicates(["_row"])
    return with_keys(out, again, "_row", without=True).unionByName(once).select(*docs.columns)


@_own_names
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text. No document goes."""
    found = secret_scan.spans_of(docs)
    return found.withColumn("text", redacted(F.col("text"), F.col("_spans"), MARK)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_own_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; a document that is taken twice stands in it twice."""
    return mixing.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their place in sequences of at most 1024."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path(), limit=1024, added=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]
# Language, near-duplicates of real sizes, secrets and packing are beyond SQL: tested against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
