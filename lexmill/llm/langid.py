"""Language of whole texts by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training texts. The classifier is fitted on a bounded sample (``per_language`` labelled
documents of each language, chosen by a hash of the id), of which every fifth is kept back to calibrate the temperature.
Prediction reads whole texts in one pass: the term frequency is relative, so a text's logits are the mean, over its n-grams,
of idf times weight, and one lookup per n-gram gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.ngramhash import Ftrl, codes, hashed_ngrams, softmax, temperature

ORDERS = (1, 2, 3)
BITS = 16
BUCKETS = 1 << BITS
SCALE = 30.0  # of the relative frequencies, so that a text's features are of the order of one
EPOCHS = 3
UNKNOWN = "und"
# n-grams of a text are looked up in pieces of so many characters
PIECE = 200_000


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Per code point of the basic plane, itself if it is a letter and else a blank; made once in each process."""
    if not _LETTERS:
        _LETTERS.append(np.array([i if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32))
    return _LETTERS[0]


def _points(text: str) -> np.ndarray:
    """Lower-cased code points; what is no letter counts as a blank (higher planes count as letters), blanks are merged."""
    p = codes(" " + text.lower() + " ")
    table = _letter_table()
    p = table[p] if p.max() < (1 << 16) else np.where(p < (1 << 16), table[np.minimum(p, (1 << 16) - 1)], p)
    blank = p == 32
    return p[~(blank & np.concatenate([[False], blank[:-1]]))]


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, in pieces; an n-gram belongs to the piece in which it begins."""
    for i in range(0, len(points), PIECE):
        for n in ORDERS:
            yield hashed_ngrams(points[i : i + PIECE + n - 1], (n,), BITS)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for g in _grams(_points(text)):
        total += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: in how many texts each bucket occurs; the last row (bucket -1) has the number of texts."""
    df, texts, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py()
            if has_letter(text):
                texts += 1
                for g in _grams(_points(text)):
                    seen[g] = True
                df += seen
                seen[:] = False
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], texts))], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("_order"), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in rows], pa.binary())],
            ["lang", "order", "at", "n"],
        )


@dataclass
class Model:
    """Languages, and per bucket idf times weight for each; its size is fixed by BUCKETS."""

    languages: list[str]
    table: np.ndarray
    divisor: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for g in _grams(_points(text)):
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return SCALE * total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.divisor)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(labelled: DataFrame, per_language: int = 600) -> Model:
    """Fit on (doc_id, text, lang); rows without text, letters or lang are left out.

    At most ``per_language`` documents of a language reach the driver, as bucket counts. Without any the model has no
    languages and predicts ``und``.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = known.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, texts = np.zeros(BUCKETS), 0
    for r in rows.toLocalIterator():
        if r.bucket < 0:
            texts = r.n
        else:
            df[r.bucket] = r.n
    # The sample: the smallest hashes of each language. Counts, one row per language like the model itself, bound the hashes that
    # are ranked, and the ranks bound the documents whose texts are read; no text is shuffled to be chosen.
    order = F.xxhash64("doc_id", "text", F.lit("langid"))
    with_order = known.where(F.col("text").rlike(r"\p{L}")).withColumn("_order", order)
    sizes = with_order.groupBy("lang").count().collect()
    spark = labelled.sparkSession
    first = [(r["lang"], min(2**63 - 1, -(2**63) + 4 * per_language * 2**64 // r["count"])) for r in sizes]
    bound = F.broadcast(spark.createDataFrame(first, "lang string, _first bigint"))
    ranked = with_order.join(bound, "lang").where("_order <= _first").select("lang", "_order")
    window = Window.partitionBy("lang").orderBy("_order")
    last = ranked.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= per_language).groupBy("lang").agg(F.max("_order").alias("_most"))
    most = F.broadcast(spark.createDataFrame([(r["lang"], r["_most"]) for r in last.collect()], "lang string, _most bigint"))
    sample = with_order.join(most, "lang").where("_order <= _most").dropDuplicates(["lang", "_order"])
    found = sample.select("text", "lang", "_order").mapInArrow(_features, "lang string, order bigint, at binary, n binary")
    examples = found.collect()  # per_language of each language
    return fit([(r.lang, r.order, np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)) for r in examples], df, texts)


def fit(examples: list[tuple[str, int, np.ndarray, np.ndarray]], df: np.ndarray, texts: int) -> Model:
    """FTRL over the examples in a fixed random order, then the temperature on every fifth.

    The hashes have chosen the sample language by language, so their own order would put the rarer languages last.
    """
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0)
    idf = np.log((1.0 + texts) / (1.0 + df)) + 1.0
    examples = sorted(examples, key=lambda e: (e[1], e[0], e[2].tobytes(), e[3].tobytes()))
    examples = [examples[i] for i in np.random.default_rng(7).permutation(len(examples))]
    values = [SCALE * n * idf[at] / max(n.sum(), 1) for _, _, at, n in examples]
    labels = [languages.index(e[0]) for e in examples]
    held = [i for i in range(len(examples)) if i % 5 == 4]
    model = Ftrl(BUCKETS, len(languages))
    for _ in range(EPOCHS):
        for i in range(len(examples)):
            if i % 5 != 4:
                model.learn(examples[i][2], values[i], labels[i])
    w = model.weights()
    logits = np.array([values[i] @ w[examples[i][2]] for i in held]).reshape(-1, len(languages))
    divisor = temperature(logits, np.array([labels[i] for i in held], np.int64))
    return Model(languages, (w * idf[:, None]).astype(np.float32), divisor)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but a former prediction, with lang_pred and score; the model travels with the tasks."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 1 modulo 3; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_language: int = 600) -> DataFrame:
    """All columns of ``docs`` with held_out, lang_pred and score (the calibrated probability of lang_pred).

    The model learns from text and non-null lang of documents that are not held out. Defined cases: a null text or one without
    a letter is ``und`` with score 0; an empty table gives no rows; without labelled rows all are ``und``; repeated rows
    get equal results; columns named like the results are replaced.
    """
    rest = docs.drop("held_out", "lang_pred", "score")
    model = train(rest.where(~held_out()), per_language)
    return predict(rest.withColumn("held_out", held_out()), model)
