"""Ordering, sampling by budget and train/validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators.ordering import dense_positions, hash_groups, id_groups, running_total


def split_articles(df: DataFrame, text: str = "text") -> DataFrame:
    """Articles separated by a blank line; each stripped, empty ones dropped, order kept."""
    parts = F.posexplode_outer(F.split(text, "\n\n")).alias("part", "article")
    return (
        df.select(*[c for c in df.columns if c != text], parts)
        .withColumn("article", tx.strip(F.col("article")))
        .where("article <> ''")
    )


def strip_nonempty_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.strip(F.col(text))).where(F.col(text) != "")


def corpus_stats(lines: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Lines, words and bytes per file, and a total row whose file is NULL."""
    return lines.rollup(file).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(tx.count_words(F.col(text)).cast("bigint")).alias("n_words"),
        F.sum((F.octet_length(text) + 1).cast("bigint")).alias("n_bytes"),
    )


def sample_by_word_budget(
    docs: DataFrame, target: int, seed: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Draw documents in seeded random order until the word count reaches ``target``.

    The document that crosses the budget is included. Only hash groups that start below the budget
    are ordered, so the sort covers the sample and not the corpus. Returns (key, n_words, before).
    """
    narrow = docs.select(
        key,
        tx.count_words(F.col(text)).cast("bigint").alias("n_words"),
        tx.seeded_key(seed, F.col(key)).alias("_digest"),
    ).withColumn("_hex", F.substring("_digest", 1, 3))
    totals = narrow.groupBy("_hex").agg(F.sum("n_words").alias("n_words"))
    # At most 16**3 rows, whatever the corpus.
    starts = (
        running_total(totals, F.col("n_words"), [F.col("_hex")], [], name="_start")
        .where(F.col("_start") < target)
        .select("_hex", "_start")
    )
    window = (
        Window.partitionBy("_hex").orderBy("_digest", key).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        narrow.join(F.broadcast(starts), "_hex")
        .withColumn("before", F.col("_start") + F.coalesce(F.sum("n_words").over(window), F.lit(0)))
        .where(F.col("before") < target)
        .select(key, "n_words", "before")
    )


def exclude_selected(
    docs: DataFrame, selected: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents whose text is not among the selected ones, so copies cannot leak.

    ``selected`` holds keys of ``docs``. Texts are compared by SHA-256 digest; the selected digests
    are made distinct first, so many copies of one text are one row on that side.
    """
    digest = F.sha2(text, 256)
    taken = (
        docs.select(key, digest.alias("_digest"))
        .join(selected.select(key), key, "left_semi")
        .select("_digest")
        .distinct()
    )
    return (
        docs.withColumn("_digest", digest)
        .join(taken, "_digest", "left_anti")
        .drop("_digest")
    )


def split_report(docs: DataFrame, train: DataFrame, val: DataFrame, text: str = "text") -> DataFrame:
    """Words and share of the corpus per split, and of the unused rest."""
    total = docs.agg(F.sum(tx.count_words(F.col(text)).cast("bigint")).alias("total"))

    def words(split: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words")).select(
            F.lit(split).alias("split"), "n_words"
        )

    parts = words("train", train).unionByName(words("val", val))
    used = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("used"))
    unused = total.select(
        F.lit("unused").alias("split"), (F.col("total") - used.scalar()).alias("n_words")
    )
    return parts.unionByName(unused).select(
        "split", "n_words", (F.lit(100.0) * F.col("n_words") / total.scalar()).alias("percent")
    )


def check_budget(total_words: int, train_words: int, val_words: int) -> None:
    if train_words + val_words > total_words:
        raise ValueError(
            f"requested {train_words + val_words} words but the corpus has only {total_words}"
        )


def train_val_split(
    docs: DataFrame, train_words: int, val_words: int, seed: int, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(train, val) samples of the given sizes without a common text; refused if the corpus has fewer words.

    The word count of the corpus, one number, is taken first.
    """
    total = docs.agg(F.coalesce(F.sum(tx.count_words(F.col(text)).cast("bigint")), F.lit(0))).first()[0]
    check_budget(total, train_words, val_words)
    val = sample_by_word_budget(docs, val_words, seed, key, text)
    return sample_by_word_budget(exclude_selected(docs, val, key, text), train_words, seed + 1, key, text), val


def merge_files_in_order(
    lines: DataFrame, seed: int | None, file: str = "file", line_no: str = "line_no"
) -> DataFrame:
    """Files in seeded order (by name without a seed), lines in order inside each file.

    ``line_no`` may have gaps. Adds ``pos``, dense from 0 over the merged corpus.
    """
    numbered = dense_positions(
        lines, [F.col(line_no)], id_groups(F.col(line_no)), within=[file], name="_in_file"
    )
    order = F.col(file) if seed is None else tx.seeded_key(seed, F.col(file))
    counts = lines.groupBy(file).agg(F.count(F.lit(1)).alias("n")).withColumn("_order", order)
    starts = running_total(
        counts, F.col("n"), [F.col("_order"), F.col(file)],
        [] if seed is None else hash_groups(F.col("_order")), name="_start",
    )
    return (
        numbered.join(starts.select(file, "_start"), file)
        .withColumn("pos", F.col("_start") + F.col("_in_file"))
        .drop("_start", "_in_file")
    )


def shuffled_positions(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Full seeded shuffle: dense position ``pos`` in the order of a hash over the row key."""
    cols = [F.col(k) for k in keys]
    digest = df.withColumn("_digest", tx.seeded_key(seed, *cols))
    return dense_positions(
        digest, [F.col("_digest"), *cols], hash_groups(F.col("_digest")), name="pos"
    ).drop("_digest")


def head_ratio_split(positioned: DataFrame, ratio: float) -> DataFrame:
    """Mark the first ``int(n * ratio)`` rows as validation, the rest as training."""
    size = positioned.agg(F.floor(F.count(F.lit(1)) * F.lit(float(ratio))).alias("size"))
    return positioned.withColumn(
        "split", F.when(F.col("pos") < size.scalar(), F.lit("val")).otherwise(F.lit("train"))
    )


def fixed_eval_subset(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same for every caller with this seed."""
    return df.orderBy(tx.seeded_key(seed, F.col(key)), key).limit(n)


def shuffled_epoch(df: DataFrame, batch_size: int, seed: int, *keys: str) -> DataFrame:
    """Shuffled batches of equal size; the incomplete last batch is dropped."""
    positioned = shuffled_positions(df, seed, *keys)
    batches = df.agg((F.count(F.lit(1)) / F.lit(batch_size)).cast("bigint").alias("n"))
    batch = F.floor(F.col("pos") / F.lit(batch_size))
    return positioned.withColumn("batch_id", batch).where(F.col("batch_id") < batches.scalar())


def path_order(df: DataFrame, volume: str, part: str, name: str) -> DataFrame:
    """Volumes, then parts, by the number in their names, then file name (a range-partitioned sort)."""
    return df.withColumns(
        {"volume_no": tx.first_number(F.col(volume)), "part_no": tx.first_number(F.col(part))}
    ).orderBy("volume_no", "part_no", name)


def join_articles(df: DataFrame, text: str = "text") -> DataFrame:
    """Every article followed by a blank line; rows stay rows, the sink concatenates them."""
    return df.withColumn(text, F.concat(F.col(text), F.lit("\n\n")))


def marked_stream(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.add_document_markers(F.col(text)))
