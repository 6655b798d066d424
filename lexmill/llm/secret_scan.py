"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control. Column functions only.

Long tokens are candidates. The encoding inferred from a token's characters gives its alphabet. Three tests take the token for a
uniform random string: chi-squared of the letter counts (with the exact variance for short strings), Wald-Wolfowitz runs
around the middle of the alphabet, and serial correlation. Fisher's method combines their p-values. Prose, names and numbers
fail these tests. The Benjamini-Hochberg procedure, for each encoding and class of length on its own, rejects the structured
tokens at level Q, with counts by p-value bins over the whole corpus. A token that is not rejected and long enough for the tests to
have power is a secret of kind ``random``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numeric import let
from lexmill.llm.common import stored
from lexmill.llm.spans import SPAN, find, joined, labelled, outside

# A random token has a uniform p-value and is lost below the cut, which nears Q where most tokens are structured (slugs, paths); the
# p-values of structured tokens are mostly below 1e-6, so a low level keeps the secrets and still rejects them.
Q = 0.001
# The patterns of the three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# name, what a token looks like, alphabet, least length at which prose of that alphabet is rejected
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6], 20),
    ("upper hex", "^[0-9A-F]+$", DIGITS + LOWER[:6].upper(), 20),
    ("base32", "^[A-Z2-7]+$", LOWER.upper() + "234567", 20),
    ("upper base36", "^[0-9A-Z]+$", DIGITS + LOWER.upper(), 20),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER, 24),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + LOWER + LOWER.upper(), 24),
    ("base64", "^[0-9A-Za-z+/]+$", LOWER.upper() + LOWER + DIGITS + "+/", 32),
    ("base64url", "^[0-9A-Za-z_+/-]+$", LOWER.upper() + LOWER + DIGITS + "-_+/", 32),
]
LENGTHS = (24, 32, 48, 96)  # where classes of length begin
BINS = 240  # p-value bins of a twentieth of a decade


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, for z >= 0 (polynomial with error below 1e-7, public formula)."""
    t = 1.0 / (1.0 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _one_sided(z: Column) -> Column:
    return let(z, lambda v: F.greatest(F.lit(1e-12), F.when(v >= 0, _upper_tail(v)).otherwise(1 - _upper_tail(-v))))


def _two_sided(z: Column) -> Column:
    return let(F.abs(z), lambda v: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), 2 * _upper_tail(v))))


def battery(values: Column, size: int) -> Column:
    """Combined p-value of the three tests for an array of letter numbers (0 to size - 1), under a uniform random string."""

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda s, c: s + F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = (squares * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        high = F.transform(v, lambda x: x * 2 >= size)
        ups = F.size(F.filter(high, lambda h: h)).cast("double")
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= size) != (p["b"] * 2 >= size))).cast("double") + 1
        mean = 2 * ups * (n - ups) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when(spread > 0, (turns - mean) / F.sqrt(spread)).otherwise(F.lit(8.0))
        middle, variance = (size - 1) / 2.0, (size * size - 1) / 12.0
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle)) / variance / F.sqrt(n - 1)
        half = -(F.log(_one_sided(chi)) + F.log(_two_sided(runs)) + F.log(_two_sided(serial)))
        return let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))  # chi-squared with six degrees of freedom

    return let(values, tests)


def judged(token: Column) -> Column:
    """struct<encoding, long_enough, p> of a token."""
    numbers = lambda alphabet: F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    out = F.lit(None)
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    for k, (_, looks, alphabet, least) in reversed(list(enumerate(ENCODINGS))):
        each = F.struct(F.lit(k).alias("encoding"), (mixed & (F.length(token) >= least)).alias("enough"), battery(numbers(alphabet), len(alphabet)).alias("p"))
        out = F.when(token.rlike(looks), each).otherwise(out)
    return out


def length_class(n: Column) -> Column:
    return sum(((n >= at).cast("int") for at in LENGTHS[1:]), (n >= LENGTHS[0]).cast("int"))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with _assign, _access, _hex (spans) and _tokens (candidate spans with encoding, length class and p-value)."""
    text = F.col("text")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    tokens = F.transform(find(text, CANDIDATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), length_class(F.length(s["value"])).alias("length"), judged(s["value"]).alias("test")))
    return docs.withColumns({
        "_assign": find(text, ASSIGN, value), "_access": find(text, ACCESS, lambda m: F.length(m) >= 18),
        "_hex": find(text, HEX), "_tokens": tokens,
    })


def cut_offs(found: DataFrame, q: float = Q) -> dict[tuple[int, int], float]:
    """Benjamini-Hochberg cut for each (encoding, length class) from the _tokens of the whole corpus.

    Counts come by p-value bins (a bin's tokens count at its upper edge), so at most 8 * 5 * (BINS + 1) numbers reach the driver.
    """
    bin_ = F.least(F.lit(BINS), F.floor(-20 * F.log10(F.greatest(F.col("t.test.p"), F.lit(1e-12))))).cast("int")
    rows = (
        found.select(F.explode("_tokens").alias("t"))
        .groupBy(F.col("t.test.encoding").alias("e"), F.col("t.length").alias("n"), bin_.alias("bin")).count().collect()
    )
    counts: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        counts.setdefault((r["e"], r["n"]), [0] * (BINS + 1))[r["bin"]] += r["count"]
    out = {}
    for key, each in counts.items():
        total, below = sum(each), sum(each)
        out[key] = 0.0
        for b in range(BINS + 1):  # edges from 1 downwards; the first that holds is the largest
            if b and 10 ** (-b / 20) <= q * below / total:
                out[key] = 10 ** (-b / 20)
                break
            below -= each[b]
    return out


def random_spans(cuts: dict[tuple[int, int], float]) -> Column:
    """Tokens that their tests do not reject and that are long enough, as spans outside the base spans."""
    items = [x for (e, n), p in sorted(cuts.items()) for x in (F.lit(e * 10 + n), F.lit(float(p)))]
    if not items:
        return F.array().cast(SPAN)
    table = F.create_map(*items)
    kept = F.filter("_tokens", lambda t: t["test"]["enough"] & (t["test"]["p"] > F.try_element_at(table, t["test"]["encoding"] * 10 + t["length"])))
    spans = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("").alias("value")))
    return outside(spans, F.concat("_assign", "_access", "_hex"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Only doc_id and text are read. Defined cases: a null text counts as empty (no spans, the digest of the empty string);
    repeated rows give equal results; an empty table gives no rows.
    """
    found = stored(scanned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text"), "secrets")
    base = labelled([(k, F.col(f"_{k}")) for k in ("assign", "access", "hex")], by_start=True)
    with_random = found.withColumn("_random", random_spans(cut_offs(found)))
    every = labelled([(k, F.col(f"_{k}")) for k in ("assign", "access", "hex", "random")], by_start=True)
    return with_random.select(
        "doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
    )


def spans_of(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_spans``: all spans of secrets, base and random ones (two passes over the texts)."""
    cuts = cut_offs(scanned(docs.select("text")))
    found = scanned(docs).withColumn("_random", random_spans(cuts))
    return found.withColumn("_spans", F.concat("_assign", "_access", "_hex", "_random")).drop("_assign", "_access", "_hex", "_random", "_tokens")
