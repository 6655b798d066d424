"""Readers: text corpora, JSONL items, prediction documents, word lists, articles, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.functions.text import strip
from lexmill.operators.ordering import running_total
from lexmill.session import cut_lineage


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*.train") -> DataFrame:
    """(path, file, line_no, text) of all matching files; ``line_no`` is dense from 0 per path.

    Files of one name in several folders stay apart: ``path`` is the key and ``file`` the name. A big file is cut into blocks
    that are read in parallel. The lines are stored once with their place in the scan, so that counting the lines of
    earlier blocks and numbering see the same cut.
    """
    lines = cut_lineage(_with_blocks(spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)))
    if lines.isEmpty():
        raise ValueError(f"No {glob} files found in {path}")
    numbered = running_total(
        lines, F.lit(1).cast("bigint"), [F.col("_seq")], [("_b", F.col("_block")), ("_s", F.shiftright("_seq", 16))],
        within=["path"], name="line_no",
    )
    return numbered.select("path", "file", "line_no", "text")


def _with_blocks(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("text"),
    )


def read_jsonl_items(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """Raw records with ``path``, ``stem`` (file name without suffix) and ``idx`` (line in the file)."""
    numbered = read_text_corpus(spark, path, glob)
    return numbered.where(strip(F.col("text")) != "").select(
        "path", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), F.col("line_no").alias("idx"),
        F.from_json("text", schema).alias("r"),
    ).select("path", "stem", "idx", "r.*")


def read_labeled_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, none_columns: tuple[str, ...] = ()) -> DataFrame:
    """Table with header; missing values of ``none_columns`` become the text ``None``."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.fillna("None", subset=list(none_columns)) if none_columns else df


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a ``.txt`` (one per line) or ``.csv`` (column ``word``) file."""
    if path.endswith(".txt"):
        words = spark.read.text(path).select(strip(F.col("value")).alias("word")).where("word <> ''")
    elif path.endswith(".csv"):
        table = spark.read.option("header", True).csv(path)
        if "word" not in table.columns:
            raise ValueError("CSV word lists need a column 'word'")
        words = table.select("word")
    else:
        raise ValueError(f"unsupported word list: {path}")
    return words.distinct()


def read_article_json(spark: SparkSession, path: str) -> DataFrame:
    """Articles, one JSON object per file, with path and name; bad files keep ``_corrupt_record``."""
    return (
        spark.read.schema(schemas.ARTICLE).option("multiLine", True).option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
        .select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(subtask, idx, id, pred, prob, prev_pred) of nested prediction documents."""
    documents = spark.read.text(path, wholetext=True).select(
        F.from_json("value", schemas.PREDICTIONS_DOCUMENT, {"allowNonNumericNumbers": "true"}).alias("d")
    )
    return (
        documents.select(F.explode("d").alias("subtask", "v"))
        .select("subtask", F.posexplode("v.predictions").alias("idx", "p"))
        .select("subtask", F.col("idx").cast("bigint").alias("idx"), "p.*")
    )


def read_word_contexts(spark: SparkSession, path: str, min_context: int = 0) -> DataFrame:
    """(word, context_id, context) of ``{word: [{"context": ...}]}`` documents."""
    schema = "map<string,array<struct<context:string>>>"
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("word", "contexts"))
    return lists.where((F.length("word") > 1) & (F.size("contexts") >= min_context)).select(
        "word", F.posexplode("contexts").alias("context_id", "c")
    ).select("word", "context_id", "c.context")


def read_surprisal(spark: SparkSession, path: str) -> DataFrame:
    """Records of a surprisal document ``{"metadata": ..., "results": [...]}``."""
    schema = f"struct<results:array<struct<{', '.join(f.replace(' ', ':') for f in schemas.SURPRISAL.split(', '))}>>>"
    return spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", schema, {"allowNonNumericNumbers": "true"})["results"]).alias("r")
    ).select("r.*")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding array<float>) from Parquet."""
    return spark.read.parquet(path).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
