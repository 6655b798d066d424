"""Array arithmetic for logits, probabilities and losses, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda an outer expression would be computed again for every array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def log_sum_exp(logits: Column) -> Column:
    """log(sum(exp(x))), shifted by the maximum."""
    return let(
        logits,
        lambda xs: let(
            F.array_max(xs), lambda top: top + F.log(total(F.transform(xs, lambda x: F.exp(x - top))))
        ),
    )


def scaled(logits: Column, temperature: Column | float) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return let(t, lambda t: F.transform(logits, lambda x: x / t))


def log_softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    return let(
        scaled(logits, temperature),
        lambda xs: let(log_sum_exp(xs), lambda norm: F.transform(xs, lambda v: v - norm)),
    )


def target_logprob(logits: Column, target: Column, temperature: Column | float = 1.0) -> Column:
    """Log-probability of one target id, without building the whole log-softmax array."""
    return let(
        scaled(logits, temperature),
        lambda xs: F.element_at(xs, target.cast("int") + 1) - log_sum_exp(xs),
    )


def softmax(logits: Column, beta: Column | float = 1.0) -> Column:
    def weights(xs: Column, b: Column) -> Column:
        return let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(b * (x - top))))

    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    weighted = let(b, lambda b: let(logits, lambda xs: weights(xs, b)))
    return let(weighted, lambda ws: let(total(ws), lambda norm: F.transform(ws, lambda w: w / norm)))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def kl_clipped(p: Column, q: Column, floor: float = 1e-10) -> Column:
    """KL(p || q) with both distributions clipped to [floor, 1]."""
    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(floor)), F.lit(1.0))

    return total(F.zip_with(p, q, lambda a, b: clip(a) * F.log(clip(a) / clip(b))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def unit(v: Column) -> Column:
    return let(v, lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: x / norm)))


def parse_step(c: Column) -> Column:
    """First number with an optional K, M or B suffix as a double; NULL without a number."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*([KMB]?)"
    number = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("double")
    suffix = F.upper(F.regexp_extract(c, pattern, 2))
    factor = (
        F.when(suffix == "K", F.lit(1e3)).when(suffix == "M", F.lit(1e6)).when(suffix == "B", F.lit(1e9))
        .otherwise(F.lit(1.0))
    )
    return number * factor
