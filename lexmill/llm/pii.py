"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction. Column functions only.

The labels and content words before a seed are lexical patterns. Other tokens with a digit and at least LEAST letters and digits, of
any case and with inner signs or blanks between groups of digits, are instances that patterns may introduce. In the graph of patterns and instances scores go back and forth, ROUNDS times at least: a pattern's score is the mean score
of what it introduces, shrunk by one unseen instance of score 0; an instance's score is the noisy-or over its patterns; seeds
keep score 1. A pattern of at least CONFIDENT whose support is MIN_SEEDS distinct seeds or confirmed instances is confident, and what it
introduces is confirmed: it has score 1 from then on and supports the other patterns before it, so the rounds reach patterns that no seed
stands behind. They go on until none is added. Tokens behind a confident pattern are identifiers of kind ``context``. Edges are distinct (pattern, instance) pairs, so copies of a document do not add weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numeric import let
from lexmill.llm.common import stored
from lexmill.llm.spans import find, joined, labelled, outside

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four base kinds. A start is tried only where a run begins or a former match ended, and runs
# are possessive, which finds the same spans in linear time and without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Instances: maximal runs with a digit, of letters, digits and . / _ @ -, and groups of digits behind them that single blanks join.
# Signs at the ends do not belong to an instance.
SIGNS = "./_@-"
TOKEN = r"(?<![\p{L}0-9./_@-])(?=[\p{L}./_@-]*+[0-9])[\p{L}0-9./_@-]++(?:(?<=[0-9])\x20[0-9]++(?![\p{L}/_@-]|\.[\p{L}0-9]))*+"
LEAST = 5  # letters and digits of an instance; shorter ones (ages, years, 12 34) are no identifiers
BEFORE = 60  # code points before a token in which its words are looked for
ROUNDS = 3  # at least; more as long as they add patterns
CONFIDENT = 0.75
MIN_SEEDS = 4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""

    def weigh(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda s, x: s + x) % 10 == 0


def _is_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))


def _is_ip(value: Column) -> Column:
    plain = lambda part: F.ltrim(part, F.lit("0"))
    return F.forall(F.split(value, r"\."), lambda part: (F.length(plain(part)) <= 3) & (F.coalesce(F.try_to_number(F.substring(F.concat(F.lit("0"), plain(part)), 1, 4), F.lit("9999")).cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": find(text, EMAIL),
        "ip": find(text, IP, _is_ip),
        "card": find(text, CARD, _is_card),
        "phone": find(text, PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    }


def _patterns(text: Column, start: Column) -> Column:
    """Lexical patterns that end at a position, lower-cased; words are runs of letters.

    If a label mark (``:``, ``=``, ``#``) stands between, the last word and the last two words with the mark; else the last two
    words if both are content words by their length, as function words stand before anything.
    """
    from_ = F.greatest(start - BEFORE, F.lit(0))

    def of(before: Column) -> Column:
        mark = F.regexp_extract(before, r"([:=#])[^\p{L}:=#]{0,4}\z", 1)
        words = F.regexp_extract_all(before, F.lit(r"\p{L}+"), F.lit(0))
        one = lambda w: F.try_element_at(w, F.lit(-1))
        two = lambda w: F.array_join(F.slice(w, -2, 2), " ")
        long_ = lambda w: (F.size(w) >= 2) & (F.length(F.try_element_at(w, F.lit(-1))) >= 4) & (F.length(F.try_element_at(w, F.lit(-2))) >= 4) & (F.length(two(w)) >= 10)
        return let(words, lambda w: F.filter(F.array(
            F.when((mark != "") & (F.size(w) >= 1), F.concat(one(w), mark)),
            F.when((mark != "") & (F.size(w) >= 2), F.concat(two(w), mark)),
            F.when((mark == "") & long_(w), two(w)),
        ), lambda p: p.isNotNull()))

    return let(F.lower(F.substring(text, from_ + 1, start - from_)), of)


def _trimmed(spans: Column) -> Column:
    """Spans without the signs at their ends."""
    ends = lambda value: F.length(value) - F.length(F.rtrim(value, F.lit(SIGNS)))
    starts = lambda value: F.length(value) - F.length(F.ltrim(value, F.lit(SIGNS)))
    return F.transform(spans, lambda s: F.struct(
        (s["start"] + starts(s["value"])).alias("start"), (s["end"] - ends(s["value"])).alias("end"),
        F.rtrim(F.ltrim(s["value"], F.lit(SIGNS)), F.lit(SIGNS)).alias("value"),
    ))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and text's spans of the four kinds, _seeds and _tokens (spans with instance and patterns)."""
    text = F.col("text")
    found = docs.withColumns({f"_{k}": spans for k, spans in base_spans(text).items()})
    tokens = outside(_trimmed(find(text, TOKEN, lambda m: F.length(F.regexp_replace(m, r"[^\p{L}0-9]", "")) >= LEAST)), F.concat(*[F.col(f"_{k}") for k in KINDS]))
    found = found.withColumn("_free", tokens)
    marked = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _patterns(text, s["start"]).alias("patterns")))
    return found.withColumns({"_seeds": marked(F.concat(*[F.col(f"_{k}") for k in KINDS])), "_tokens": marked(F.col("_free"))})


def confident_patterns(found: DataFrame) -> DataFrame:
    """(pattern): those whose score and support become high enough; once confident, a pattern stays so."""

    def edges(column: str, seed: bool) -> DataFrame:
        each = found.select(F.explode(column).alias("x")).select(F.explode("x.patterns").alias("pattern"), F.col("x.value").alias("instance"))
        return each.distinct().withColumn("seed", F.lit(seed))

    graph = stored(edges("_seeds", True).union(edges("_tokens", False)), "graph")
    enough = (F.col("score") >= CONFIDENT) & (F.col("support") >= MIN_SEEDS)
    counted = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds"))
    first = counted.withColumns({"score": F.col("seeds") / (F.col("n") + 1.0), "support": F.col("seeds")})
    scores = stored(first.select("pattern", "n", "seeds", "score", enough.alias("confident")), "scores")
    free = graph.where("not seed").select("pattern", "instance")
    known, rounds = scores.where("confident").count(), 0
    while True:
        either = 1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))
        instances = (
            free.join(scores.select("pattern", "score", "confident"), "pattern").groupBy("instance").agg(F.max("confident").alias("confirmed"), either.alias("either"))
            .select("instance", F.col("confirmed").cast("int").alias("confirmed"), F.when(F.col("confirmed"), F.lit(1.0)).otherwise(F.col("either")).alias("s"))
        )
        gained = free.join(instances, "instance").groupBy("pattern").agg(F.sum("s").alias("gained"), F.sum("confirmed").alias("more"))
        after = scores.drop("score").join(gained, "pattern", "left").withColumns({
            "score": (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + 1.0), "support": F.col("seeds") + F.coalesce("more", F.lit(0)),
        })
        scores = stored(after.select("pattern", "n", "seeds", "score", (F.col("confident") | enough).alias("confident")), "scores")
        before, known, rounds = known, scores.where("confident").count(), rounds + 1
        if rounds >= ROUNDS and known == before:
            return scores.where("confident").select("pattern")


def extract(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Only doc_id and text are read. Defined cases: a null text counts as empty; repeated rows give equal results; an empty table
    gives no rows; seeds without words before them induce no pattern.
    """
    rows = scanned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text", "_free")
    found = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "personal")
    good = confident_patterns(found)
    free = found.where(F.size("_tokens") > 0).select("_row", F.explode("_tokens").alias("x"))
    each = free.select("_row", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    hits = each.join(good, "pattern", "left_semi").select("_row", "start", "end").distinct()
    spans = hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.col("start"), F.col("end"), F.lit("").alias("value")))).alias("_context"))
    with_context = found.join(spans, "_row", "left").withColumn("_context", F.coalesce("_context", F.array().cast("array<struct<start:int,end:int,value:string>>")))
    base = labelled([(k, F.col(f"_{k}")) for k in KINDS], by_start=False)
    every = labelled([(k, F.col(f"_{k}")) for k in (*KINDS, "context")], by_start=False)
    return with_context.select(
        "doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
    )
