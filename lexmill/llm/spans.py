"""Spans of pattern matches in whole texts, by column functions only.

A span is struct<start, end, value>: code points from 0, end exclusive. Matches are leftmost and do not overlap; what the filter
rejects has still used up its characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.numeric import let

_STEP = 64
SPAN = "array<struct<start:int,end:int,value:string>>"


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an integer array: sums of blocks first, so the work is n * 64 rather than n squared."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def with_blocks(c: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / _STEP).cast("int")), lambda b: total(F.slice(c, b * _STEP + 1, F.lit(_STEP))))

        def sums(starts: Column) -> Column:
            return F.transform(c, lambda x, i: F.element_at(starts, F.floor(i / _STEP).cast("int") + 1) + total(F.slice(c, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP + 1)))

        return let(blocks, lambda s: let(F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))), sums))

    return F.when(F.size(values) > 0, let(values, with_blocks)).otherwise(F.array().cast("array<int>"))


def find(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """All spans of ``pattern`` whose value passes ``keep``; none for a null text."""
    none = F.array().cast(SPAN)

    def located(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.length(p))
        before = F.transform(found, lambda m, i: F.when(i > 0, F.length(F.element_at(found, F.when(i > 0, i).otherwise(1)))).otherwise(0))
        starts = running_sums(F.zip_with(steps, before, lambda a, b: a + b))
        spans = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
        return F.filter(spans, lambda s: keep(s["value"])) if keep else spans

    matches = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    return F.coalesce(let(matches, lambda found: F.when(F.size(found) > 0, located(found)).otherwise(none)), none)


def labelled(kinds: Sequence[tuple[str, Column]], by_start: bool) -> Column:
    """One array of struct<a, b, kind, start, end> of several span arrays, sorted by start then kind (as listed), or by kind first."""
    def part(k: int, name: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            (s["start"] if by_start else F.lit(k)).alias("a"), (F.lit(k) if by_start else s["start"]).alias("b"),
            F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        ))

    return F.array_sort(F.concat(*[part(k, name, spans) for k, (name, spans) in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of labelled spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def outside(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span (struct with start and end) replaced by ``mark``; overlapping spans give one mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    ended = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, ended).otherwise(text)
