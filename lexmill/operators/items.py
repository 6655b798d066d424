"""Projection of raw task records to ranking items, and formatting of classification inputs.

A decoder takes raw rows with ``stem`` (file name without suffix) and ``idx`` and returns the
canonical item columns. The first candidate is always the right one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.schemas import CLASSIFICATION_FIELDS

Decoder = Callable[..., DataFrame]
NO_TEXT = "string"


def _nulls(n: int) -> Column:
    return F.array(*[F.lit(None).cast(NO_TEXT)] * n)


def _map(**facets: Column) -> Column:
    return F.create_map(*[x for k, v in facets.items() for x in (F.lit(k), v)])


def _items(
    raw: DataFrame, task: str, uid: Column, sentences: Column, prefixes: Column, completions: Column,
    facets: dict[str, Column] | None = None, ratio: Column | None = None, extra: tuple[str, ...] = (),
) -> DataFrame:
    return raw.select(
        F.lit(task).alias("task"), uid.alias("uid"), "idx", sentences.alias("sentences"),
        prefixes.alias("prefixes"), completions.alias("completions"), F.lit(0).alias("label"),
        (F.lit(None).cast("double") if ratio is None else ratio.cast("double")).alias("ratio"),
        _map(UID=uid, **(facets or {})).alias("facets"), *extra,
    )


def decode_minimal_pairs(raw: DataFrame, task: str = "blimp", **_) -> DataFrame:
    """Good and bad sentence; records without ``field`` belong to the supplement set."""
    for column in ("field", "UID", "linguistics_term"):
        if column not in raw.columns:
            raw = raw.withColumn(column, F.lit(None).cast("string"))
    plain = F.col("field").isNotNull()
    supplement = F.lit("supplement")
    field = (
        F.when(F.col("field") == "syntax_semantics", F.lit("syntax/semantics"))
        .when(plain, F.col("field")).otherwise(supplement)
    )
    pair = F.array("sentence_good", "sentence_bad")
    return _items(
        raw, task, F.when(plain, F.col("UID")).otherwise(F.col("stem")), pair, _nulls(2), pair,
        {"field": field, "linguistics_term": F.when(plain, F.col("linguistics_term")).otherwise(supplement)},
    )


def decode_context_targets(raw: DataFrame, task: str = "ewok", full_sentence_scores: bool = False, **_) -> DataFrame:
    full = F.array(
        F.concat_ws(" ", "Context1", "Target1"), F.concat_ws(" ", "Context1", "Target2")
    )
    short = F.array(F.concat(F.lit(" "), "Target1"), F.concat(F.lit(" "), "Target2"))
    return _items(
        raw, task, F.col("Domain"), full, F.array("Context1", "Context2"), full if full_sentence_scores else short,
        {
            "context_type": F.col("ContextType"), "context_contrast": F.col("ContextDiff"),
            "target_contrast": F.col("TargetDiff"),
        },
    )


def decode_nonce_words(raw: DataFrame, task: str = "wug", **_) -> DataFrame:
    """Two or three candidates separated by tabs, with a human ratio for the first one."""
    candidates = F.split("sentences", "\t")
    prefixes = F.array_repeat(F.lit(None).cast("string"), F.size(candidates))
    return _items(raw, task, F.lit(task), candidates, prefixes, candidates, ratio=F.col("ratio"))


def decode_entity_tracking(raw: DataFrame, task: str = "entity_tracking", **_) -> DataFrame:
    uid = F.concat(F.col("stem"), F.lit("_"), F.col("numops").cast("string"), F.lit("_ops"))
    return _items(
        raw, task, uid,
        F.transform("options", lambda o: F.concat(F.col("input_prefix"), o)),
        F.transform("options", lambda o: F.col("input_prefix")),
        F.col("options"),
    )


def decode_property_pairs(raw: DataFrame, task: str = "comps", **_) -> DataFrame:
    uid = (
        F.when(F.col("stem") == "comps_base", F.lit("base"))
        .when(F.col("stem") == "comps_wugs", F.lit("wugs"))
        .when(F.col("stem") == "comps_wugs_dist-before", F.lit("wugs_dist_before"))
        .otherwise(F.lit("wugs_dist_in_between"))
    )
    prefixes = F.array("prefix_acceptable", "prefix_unacceptable")
    return _items(
        raw, task, uid, F.transform(prefixes, lambda p: F.concat_ws(" ", p, F.col("property_phrase"))),
        prefixes, F.array("property_phrase", "property_phrase"),
    )


def decode_question_answers(raw: DataFrame, task: str = "vqa", **_) -> DataFrame:
    answers = F.concat(F.array("target_ans"), F.col("distractors"))
    return _items(
        raw, task, F.lit("vqa"),
        F.transform(answers, lambda a: F.concat_ws(" ", F.col("question"), a)),
        F.transform(answers, lambda a: F.col("question")),
        F.transform(answers, lambda a: F.concat(F.lit(" "), a)),
        extra=("idx_in_hf_dataset",),
    )


def decode_captions(raw: DataFrame, task: str = "winoground", **_) -> DataFrame:
    captions = F.array("caption_0", "caption_1")
    return _items(
        raw, task, F.lit("winoground"), captions, _nulls(2), captions,
        {
            "Type": F.col("collapsed_tag"), "Linguistic Feature": F.col("tag"),
            "Linguistic Sub-Feature": F.concat_ws(" ", "tag", "secondary_tag"),
        },
        extra=("image_idx", "image_key"),
    )


DECODERS: dict[str, Decoder] = {
    "blimp": decode_minimal_pairs,
    "ewok": decode_context_targets,
    "entity_tracking": decode_entity_tracking,
    "comps": decode_property_pairs,
    "vqa": decode_question_answers,
    "winoground": decode_captions,
}


def register_decoder(task: str, decoder: Decoder) -> None:
    """Make a user-defined task known to ``decode``."""
    DECODERS[task] = decoder


def decode(raw: DataFrame, task: str, **options) -> DataFrame:
    if task in DECODERS:
        return DECODERS[task](raw, task=task, **options)
    if "wug" in task:
        return decode_nonce_words(raw, task=task, **options)
    raise NotImplementedError(f"task {task} is not known; known: {sorted(DECODERS)} and wug*")


def candidates(items: DataFrame) -> DataFrame:
    """One row per (item, candidate)."""
    zipped = F.arrays_zip("sentences", "prefixes", "completions")
    return items.select(
        "task", "uid", "idx", "label", "ratio", "facets", F.posexplode(zipped).alias("cand", "c")
    ).select(
        "task", "uid", "idx", "label", "ratio", "facets", "cand", F.col("c.sentences").alias("sentence"),
        F.col("c.prefixes").alias("prefix"), F.col("c.completions").alias("completion"),
    )


def attach_image_ref(items: DataFrame, images: DataFrame, on: list[str]) -> DataFrame:
    """Left join with an image table by row number (and key); items without an image stay."""
    return items.join(images, on, "left")


def format_classification(raw: DataFrame, task: str) -> DataFrame:
    """Add ``text_a`` and ``text_b`` (NULL for single-sentence tasks) of a classification task."""
    if task == "multirc":
        first = F.format_string("Question: %s Answer: %s", "question", "answer")
        second = F.col("paragraph")
    elif task == "wsc":
        first = F.format_string('Does "%s" refer to "%s" in this passage?', "span2_text", "span1_text")
        second = F.col("text")
    elif task in CLASSIFICATION_FIELDS:
        fields = CLASSIFICATION_FIELDS[task]
        first = F.col(fields[0])
        second = F.col(fields[1]) if len(fields) > 1 else F.lit(None).cast("string")
    else:
        raise NotImplementedError(f"classification task {task} is not known")
    return raw.withColumns({"text_a": first, "text_b": second})


def register_classification(task: str, *fields: str) -> None:
    """Make a user-defined classification task of one or two text fields known."""
    CLASSIFICATION_FIELDS[task] = fields


def vocab_filter(
    items: DataFrame, vocab: DataFrame, fields: list[str], key: str, token_pattern: str = r"(\w+)"
) -> DataFrame:
    """Items all of whose lower-cased tokens of all ``fields`` are in ``vocab`` (column ``word``).

    Distinct tokens are looked up, and the items of unknown ones are removed by an anti join.
    """
    text = F.lower(F.concat_ws(" ", *fields))
    tokens = items.select(
        key, F.explode_outer(F.array_distinct(F.regexp_extract_all(text, F.lit(token_pattern), F.lit(1)))).alias("word")
    ).where("word is not null")
    known = vocab.select("word").distinct()
    bad = tokens.join(known, "word", "left_anti").select(key).distinct()
    return items.join(bad, key, "left_anti")


def with_swapped_copy(items: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each item followed by a copy in which the two columns of every pair change places."""
    swap = {**dict(pairs), **{b: a for a, b in pairs}}
    columns = items.columns
    original = F.struct(F.lit(0).alias("copy"), *[F.col(c).alias(c) for c in columns])
    swapped = F.struct(F.lit(1).alias("copy"), *[F.col(swap.get(c, c)).alias(c) for c in columns])
    return items.select(F.inline(F.array(original, swapped)))


def manifest_to_long(manifest: DataFrame, trial: str = "trial") -> DataFrame:
    """(trial, kind, idx, value) from the columns image1.. and text1.. of a trial manifest."""
    wide = [c for c in manifest.columns if c.rstrip("0123456789") in ("image", "text") and c[-1:].isdigit()]
    return manifest.unpivot([trial], wide, "_column", "value").select(
        trial,
        F.regexp_extract("_column", "^(image|text)", 1).alias("kind"),
        F.regexp_extract("_column", r"(\d+)$", 1).cast("int").alias("idx"),
        "value",
    )
