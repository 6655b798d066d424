"""Text cleaning as composable column functions. Only NFKD/NFKC leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Python's str.strip()/str.split() treat as white space.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
# The characters inside a word, as a Unicode word boundary sees them.
WORD = r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
ZERO_WIDTH_SPACE = "\u200b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def words(c: Column) -> Column:
    """White-space separated tokens, in order."""
    return F.regexp_extract_all(c, F.lit(rf"([^{SPACE}]+)"), F.lit(1))


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^{SPACE}]+"))


def remove_header(c: Column) -> Column:
    """Drop everything before the first zero-width space, then strip."""
    at = F.instr(c, ZERO_WIDTH_SPACE)
    return strip(F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(c))


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def first_number(c: Column) -> Column:
    """Integer after the first underscore that is followed by digits; 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"_(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


# Rows whose texts are Python strings at the same time; what a worker holds does not grow with the rows of an Arrow batch.
NORMALIZED_ROWS = 256


def _normalizer(form: str):
    @F.arrow_udf(T.StringType())
    def normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, len(batch), NORMALIZED_ROWS):
                some = batch.slice(start, NORMALIZED_ROWS).to_pylist()
                yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in some], batch.type)

    return normalize


def _normalize(c: Column, form: str) -> Column:
    # ASCII text is already normalised, so only the other rows travel to Python.
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_normalizer(form)(foreign), c)


def normalize_nfkd(c: Column) -> Column:
    return _normalize(c, "NFKD")


def normalize_nfkc(c: Column) -> Column:
    return _normalize(c, "NFKC")


def titlecase_caps(c: Column) -> Column:
    """Words of two or more capitals become Title Case. The text is cut at such words only."""
    caps = rf"(?<![{WORD}])\p{{Lu}}{{2,}}(?![{WORD}])"
    titled = F.transform(
        F.regexp_extract_all(c, F.lit(caps), F.lit(0)),
        lambda x: F.concat(F.substring(x, 1, 1), F.lower(F.substring(x, 2, 1 << 30))),
    )
    joined = F.zip_with(F.split(c, caps, -1), titled, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    return F.when(c.rlike(caps), F.array_join(joined, "")).otherwise(c)


def drop_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\p{Z}\p{P}\p{S}\n]", "")


def unify_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{200B}-\x{200F}\x{FEFF}\p{Z}]", " ")


# Marks and what they become.
QUOTES, CURLY_QUOTES = "‹›«»", "“”"
APOSTROPHES, CURLY_APOSTROPHES = "`′´", "‘’"
DASHES = "‒–—―"


def unify_quotes(c: Column, curly: bool = False) -> Column:
    """Guillemets become straight quotes; ``curly`` adds the curly double quotes."""
    marks = QUOTES + (CURLY_QUOTES if curly else "")
    return F.translate(c, marks, '"' * len(marks))


def unify_apostrophes(c: Column, curly: bool = False) -> Column:
    """Backtick, prime and acute become apostrophes; ``curly`` adds the curly single quotes."""
    marks = APOSTROPHES + (CURLY_APOSTROPHES if curly else "")
    return F.translate(c, marks, "'" * len(marks))


def _marks(curly: bool) -> str:
    return QUOTES + APOSTROPHES + DASHES + (CURLY_QUOTES + CURLY_APOSTROPHES if curly else "")


def _straight(curly: bool) -> str:
    quotes, apostrophes = '"' * len(QUOTES), "'" * len(APOSTROPHES)
    return quotes + apostrophes + "-" * len(DASHES) + ("\"\"''" if curly else "")


def drop_references(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*(?:q\.v\.|cf\.)[^)]*\)", "")


def unify_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def tighten_punct(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*([,.!?:;)])", "$1")


def tighten_parens(c: Column) -> Column:
    return F.regexp_replace(c, r"(\()\s*|\s*(\))", "$1$2")


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^ +| +$|[^\S\n]+", " ")


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_patterns(c: Column, curly: bool = False) -> Column:
    """All replacement rules in their fixed order, without the Unicode decomposition."""
    c = titlecase_caps(c)
    c = drop_special_chars(c)
    c = unify_spaces(c)
    # quotes, apostrophes and dashes at once: none of them takes part in the rule for references
    c = F.translate(c, _marks(curly), _straight(curly))
    c = drop_references(c)
    c = tighten_punct(c)
    c = tighten_parens(c)
    c = squeeze_spaces(c)
    c = squeeze_newlines(c)
    return strip(c)


def clean_text(c: Column, curly: bool = False) -> Column:
    return clean_patterns(normalize_nfkd(c), curly)


def add_document_markers(c: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    return F.concat(F.lit(bos + " "), c, F.lit(" " + eos))


def safe_title(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""), rf"[{SPACE}]+\z", ""
    )


def seeded_key(seed: int, *keys: Column) -> Column:
    """Deterministic pseudo-random order: md5 over seed and row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
