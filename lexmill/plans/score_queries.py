"""Queries over task items, candidate scores, temperatures, predictions and losses."""

from __future__ import annotations



from pyspark.sql import functions as F

from lexmill.functions import numeric as nm
from lexmill.functions import text as tx
from lexmill.operators import distill, items, metrics, ngrams, scoring, stats, validation
from lexmill.plans import sqlparts as sq
from lexmill.plans.registry import query, table
from lexmill.sources import writers

GRID = scoring.temperatures(0.5, 1.5, 0.25)
FLOOR = -20.0
TEACHERS = 3


# ---- task decoding: every table row becomes one raw record -------------------------------------

def _flat(df):
    """Items with arrays joined, so that rows compare as text."""
    def joined(name):
        return F.array_join(name, "|", "<null>").alias(name)

    facets = F.array_join(
        F.transform(F.array_sort(F.map_entries("facets")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return df.select(
        "task", "uid", "idx", joined("sentences"), joined("prefixes"), joined("completions"), "label", "ratio",
        facets.alias("facets"),
    )


def _item_sql(task, uid, sentences, prefixes, completions, facets="", ratio="CAST(NULL AS DOUBLE)", source="documents", idx="doc_id"):
    return f"""SELECT '{task}' AS task, {uid} AS uid, {idx} AS idx, {sentences} AS sentences, {prefixes} AS prefixes,
    {completions} AS completions, CAST(0 AS INTEGER) AS label, {ratio} AS ratio, 'UID=' || {uid} || {facets or "''"} AS facets
    FROM {source}"""


def _documents(spark, sf):
    return table(spark, sf, "documents").withColumn("idx", F.col("doc_id"))


@query(
    "decode_minimal_pairs",
    _item_sql(
        "blimp", "CASE WHEN lang = 'en' THEN lang ELSE source END", "text || '|' || reverse(text)",
        "'<null>|<null>'", "text || '|' || reverse(text)",
        """';field=' || CASE WHEN lang = 'en' THEN 'syntax/semantics' ELSE 'supplement' END ||
        ';linguistics_term=' || CASE WHEN lang = 'en' THEN source ELSE 'supplement' END""",
    ),
)
def decode_minimal_pairs(spark, sf):
    english = F.col("lang") == "en"
    raw = _documents(spark, sf).select(
        "idx", F.col("text").alias("sentence_good"), F.reverse("text").alias("sentence_bad"),
        F.when(english, F.lit("syntax_semantics")).alias("field"), F.when(english, F.col("lang")).alias("UID"),
        F.when(english, F.col("source")).alias("linguistics_term"), F.col("source").alias("stem"),
    )
    return _flat(items.decode(raw, "blimp"))


@query(
    "decode_context_targets",
    _item_sql(
        "ewok", "p_type", "p_name || ' ' || p_brand || '|' || p_name || ' ' || p_type",
        "p_name || '|' || reverse(p_name)", "' ' || p_brand || '| ' || p_type",
        """';context_contrast=' || p_brand || ';context_type=' || p_size || ';target_contrast=' || p_name""",
        source="part", idx="p_partkey",
    ),
)
def decode_context_targets(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_type").alias("Domain"), F.col("p_size").cast("string").alias("ContextType"),
        F.col("p_brand").alias("ContextDiff"), F.col("p_name").alias("TargetDiff"), F.col("p_name").alias("Context1"),
        F.reverse("p_name").alias("Context2"), F.col("p_brand").alias("Target1"), F.col("p_type").alias("Target2"),
    )
    return _flat(items.decode(raw, "ewok"))


@query(
    "decode_nonce_words",
    _item_sql(
        "wug_adj", "'wug_adj'", "p_name || '|' || p_brand || '|' || p_type", "'<null>|<null>|<null>'",
        "p_name || '|' || p_brand || '|' || p_type", ratio="p_retailprice", source="part", idx="p_partkey",
    ),
)
def decode_nonce_words(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), F.concat_ws("\t", "p_name", "p_brand", "p_type").alias("sentences"),
        F.col("p_retailprice").alias("ratio"),
    )
    return _flat(items.decode(raw, "wug_adj"))


@query(
    "decode_entity_tracking",
    _item_sql(
        "entity_tracking", "p_brand || '_' || p_size || '_ops'", "p_name || p_brand || '|' || p_name || p_type",
        "p_name || '|' || p_name", "p_brand || '|' || p_type", source="part", idx="p_partkey",
    ),
)
def decode_entity_tracking(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_brand").alias("stem"), F.col("p_size").alias("numops"),
        F.col("p_name").alias("input_prefix"), F.array("p_brand", "p_type").alias("options"),
    )
    return _flat(items.decode(raw, "entity_tracking"))


_COMPS = """(SELECT *, (['comps_base', 'comps_wugs', 'comps_wugs_dist-before', 'comps_wugs_dist-in-between'])[p_size % 4 + 1]
  AS stem FROM part)"""


@query(
    "decode_property_pairs",
    _item_sql(
        "comps",
        "(['base', 'wugs', 'wugs_dist_before', 'wugs_dist_in_between'])[p_size % 4 + 1]",
        "p_name || ' ' || p_type || '|' || p_brand || ' ' || p_type", "p_name || '|' || p_brand",
        "p_type || '|' || p_type", source="part", idx="p_partkey",
    ),
)
def decode_property_pairs(spark, sf):
    stems = F.array(*[F.lit(s) for s in ("comps_base", "comps_wugs", "comps_wugs_dist-before", "comps_wugs_dist-in-between")])
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), F.get(stems, F.col("p_size") % 4).alias("stem"),
        F.col("p_name").alias("prefix_acceptable"), F.col("p_brand").alias("prefix_unacceptable"),
        F.col("p_type").alias("property_phrase"),
    )
    return _flat(items.decode(raw, "comps"))


@query(
    "decode_question_answers",
    _item_sql(
        "vqa", "'vqa'", "p_name || ' ' || p_brand || '|' || p_name || ' ' || p_type || '|' || p_name || ' ' || p_size",
        "p_name || '|' || p_name || '|' || p_name", "' ' || p_brand || '| ' || p_type || '| ' || p_size",
        source="part", idx="p_partkey",
    ),
)
def decode_question_answers(spark, sf):
    return _flat(items.decode(_questions(spark, sf), "vqa"))


def _questions(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_name").alias("question"), F.col("p_brand").alias("target_ans"),
        F.array(F.col("p_type"), F.col("p_size").cast("string")).alias("distractors"),
        F.col("p_partkey").cast("int").alias("idx_in_hf_dataset"),
    )


@query(
    "decode_captions",
    _item_sql(
        "winoground", "'winoground'", "text || '|' || reverse(text)", "'<null>|<null>'", "text || '|' || reverse(text)",
        """';Linguistic Feature=' || role || ';Linguistic Sub-Feature=' || role || ' ' || turn || ';Type=' || role""",
        source="conversations", idx="conv_id * 1000 + turn",
    ).replace("'UID=' || 'winoground' || ';Linguistic", "';Linguistic").replace(
        "';Type=' || role AS facets", "';Type=' || role || ';UID=winoground' AS facets"
    ).replace("';Linguistic Feature='", "'Linguistic Feature='"),
)
def decode_captions(spark, sf):
    raw = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("caption_0"),
        F.reverse("text").alias("caption_1"), F.col("role").alias("collapsed_tag"), F.col("role").alias("tag"),
        F.col("turn").cast("string").alias("secondary_tag"), F.lit(0).alias("image_idx"), F.lit("image_0").alias("image_key"),
    )
    return _flat(items.decode(raw, "winoground"))


@query(
    "attach_image_ref",
    """SELECT p_partkey AS idx, url AS image FROM part LEFT JOIN pages ON p_partkey = page_id""",
)
def attach_image_ref(spark, sf):
    decoded = items.decode(_questions(spark, sf), "vqa")
    images = table(spark, sf, "pages").select(F.col("page_id").cast("int").alias("idx_in_hf_dataset"), F.col("url").alias("image"))
    return items.attach_image_ref(decoded, images, ["idx_in_hf_dataset"]).select("idx", "image")


_CLASSIFICATION = {
    "boolq": ("text", "role"), "mnli": ("text", "role"), "mrpc": ("text", "role"), "rte": ("text", "role"),
    "qnli": ("text", "role"), "qqp": ("text", "role"), "cola": ("text", "NULL"), "sst2": ("text", "NULL"),
    "multirc": ("'Question: ' || text || ' Answer: ' || role", "text"),
    "wsc": ("""'Does "' || role || '" refer to "' || text || '" in this passage?'""", "text"),
}


@query(
    "classification_inputs",
    " UNION ALL ".join(
        f"SELECT conv_id, turn, '{t}' AS task, {a} AS text_a, CAST({b} AS VARCHAR) AS text_b FROM conversations"
        for t, (a, b) in _CLASSIFICATION.items()
    ),
)
def classification_inputs(spark, sf):
    turns = table(spark, sf, "conversations")
    left = ("question", "premise", "sentence1", "question1", "sentence")
    right = ("passage", "hypothesis", "sentence2", "question2")
    parts = []
    for task in _CLASSIFICATION:
        names = {c: F.col("text") for c in left} | {c: F.col("role") for c in right}
        if task == "qnli":
            names["sentence"] = F.col("role")
        names |= {"answer": F.col("role"), "paragraph": F.col("text"), "span1_text": F.col("text"), "span2_text": F.col("role")}
        raw = turns.withColumns(names)
        parts.append(items.format_classification(raw, task).select("conv_id", "turn", F.lit(task).alias("task"), "text_a", "text_b"))
    return validation.collate_predictions(parts)


_VOCAB = f"(SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}]+'))) AS word FROM documents)"


@query(
    "vocab_filter",
    f"""SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM
      (SELECT unnest(regexp_extract_all(lower(c.text), '[\\p{{L}}]+')) AS w) WHERE w NOT IN
      (SELECT word FROM {_VOCAB}))""",
)
def vocab_filter(spark, sf):
    vocab = table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("word")
    )
    turns = table(spark, sf, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return items.vocab_filter(turns, vocab, ["text"], "key", r"([\p{L}]+)").select("conv_id", "turn")


@query(
    "swapped_copy",
    """SELECT 0 AS copy, p_partkey, p_name, p_brand, p_type FROM part
    UNION ALL SELECT 1, p_partkey, p_brand, p_name, p_type FROM part""",
)
def swapped_copy(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return items.with_swapped_copy(part, [("p_name", "p_brand")])


@query(
    "manifest_to_long",
    """SELECT p_partkey AS trial, 'image' AS kind, 1 AS idx, p_name AS value FROM part
    UNION ALL SELECT p_partkey, 'image', 2, p_brand FROM part UNION ALL SELECT p_partkey, 'text', 1, p_type FROM part""",
)
def manifest_to_long(spark, sf):
    manifest = table(spark, sf, "part").select(
        F.col("p_partkey").alias("trial"), F.col("p_name").alias("image1"), F.col("p_brand").alias("image2"),
        F.col("p_type").alias("text1"), F.col("p_size").cast("string").alias("other"),
    )
    return items.manifest_to_long(manifest)


# ---- temperatures: embeddings as logits over 64 classes, label as target ------------------------

_LOGITS = "list_transform(embedding, lambda x: x::DOUBLE * 20)"


def _lse(xs: str) -> str:
    return f"(list_max({xs}) + ln(list_sum(list_transform({xs}, lambda v: exp(v - list_max({xs}))))))"


_TEMPS = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in GRID) + "]) AS temperature)"
_TOKENS = f"""(SELECT vec_id, label, temperature, x[label + 1] - {_lse('x')} AS logprob, x FROM (
  SELECT vec_id, label, temperature, list_transform({_LOGITS}, lambda v: v / temperature) AS x FROM embeddings, {_TEMPS}))"""


def _logits(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform(nm.as_doubles(F.col("embedding")), lambda x: x * 20).alias("logits"),
        F.col("label").alias("target"),
    )


@query(
    "temperature_sweep",
    f"SELECT vec_id, temperature, ROUND(logprob, 6) AS logprob FROM {_TOKENS}",
)
def temperature_sweep(spark, sf):
    scored = scoring.token_logprobs(_logits(spark, sf), GRID)
    return scored.select("vec_id", "temperature", F.round("logprob", 6).alias("logprob"))


@query(
    "completion_logprob",
    f"""SELECT label, temperature, ROUND(SUM(CASE WHEN vec_id % 4 < 3 THEN logprob ELSE 0 END), 4) AS logprob
    FROM {_TOKENS} GROUP BY ALL""",
)
def completion_logprob(spark, sf):
    tokens = scoring.token_logprobs(_logits(spark, sf).withColumn("mask", (F.col("vec_id") % 4 < 3).cast("int")), GRID)
    return scoring.completion_logprob(tokens, ["label", "temperature"], "mask").withColumn("logprob", F.round("logprob", 4))


@query(
    "word_surprisal",
    f"SELECT vec_id // 4 AS word_id, ROUND(-SUM(logprob), 6) AS surprisal FROM {_TOKENS} WHERE temperature = 1.0 GROUP BY ALL",
)
def word_surprisal(spark, sf):
    tokens = scoring.token_logprobs(_logits(spark, sf), [1.0]).withColumn("word_id", F.floor(F.col("vec_id") / 4))
    return scoring.word_surprisal(tokens, ["word_id"]).withColumn("surprisal", F.round("surprisal", 6))


@query(
    "word_and_prev_surprisal",
    f"""WITH p AS (SELECT vec_id // 3 AS word_id, EXP(SUM(logprob)) AS prob, COUNT(*) > 1 AS multi_token
      FROM {_TOKENS} WHERE temperature = 1.0 GROUP BY ALL)
    SELECT a.word_id, a.multi_token, ROUND(-LN(a.prob), 6) AS pred, ROUND(-LN(b.prob), 6) AS prev_pred
    FROM p a LEFT JOIN p b ON b.word_id = a.word_id - 1 AND a.word_id % 5 <> 0""",
)
def word_and_prev_surprisal(spark, sf):
    tokens = scoring.token_logprobs(_logits(spark, sf), [1.0]).withColumn("word_id", F.floor(F.col("vec_id") / 3))
    probs = scoring.chained_word_prob(tokens, ["word_id"])
    prev = probs.select((F.col("word_id") + 1).alias("word_id"), F.col("prob").alias("prev_prob"), F.lit("item").alias("prev_item"))
    rows = probs.join(prev.where("word_id % 5 <> 0"), "word_id", "left")
    out = scoring.word_and_prev_surprisal(rows)
    return out.select("word_id", "multi_token", F.round("pred", 6).alias("pred"), F.round("prev_pred", 6).alias("prev_pred"))


@query(
    "argmax_class",
    f"SELECT vec_id, CAST(list_position({_LOGITS}, list_max({_LOGITS})) - 1 AS INTEGER) AS pred FROM embeddings",
)
def argmax_class(spark, sf):
    return scoring.argmax_class(_logits(spark, sf)).select("vec_id", "pred")


# ---- ranking: four vectors of one group are the candidates of an item ---------------------------

# Items: one per group of four vectors. Facets: remainder classes.
_SCORES = f"""(SELECT vec_id // 4 AS idx, CAST(vec_id % 4 AS INTEGER) AS cand, 'u' || ((vec_id // 4) % 6) AS uid, temperature, logprob
  FROM {_TOKENS})"""
_RANKED = f"""(SELECT uid, idx, temperature, arg_max(cand, ROW(logprob, -cand)) AS chosen FROM {_SCORES} GROUP BY ALL)"""


def _scores(spark, sf):
    idx = F.floor(F.col("vec_id") / 4)
    return scoring.token_logprobs(_logits(spark, sf), GRID).select(
        F.lit("ranking").alias("task"), F.concat(F.lit("u"), (idx % 6).cast("string")).alias("uid"), idx.alias("idx"),
        (F.col("vec_id") % 4).cast("int").alias("cand"), "temperature", "logprob",
    )


def _ranking_items(spark, sf):
    idx = F.floor(F.col("vec_id") / 4)
    return table(spark, sf, "embeddings").select(idx.alias("_i")).distinct().select(
        F.lit("ranking").alias("task"), F.concat(F.lit("u"), (F.col("_i") % 6).cast("string")).alias("uid"),
        F.col("_i").alias("idx"), F.lit(0).alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.concat_ws("-", F.col("_i").cast("string"), c.cast("string"))).alias("completions"),
    ).withColumn("sentences", F.col("completions")).withColumn(
        "facets", F.create_map(F.lit("UID"), F.col("uid"), F.lit("parity"), (F.col("idx") % 2).cast("string"))
    )


@query("rank_candidates", f"SELECT uid, idx, temperature, chosen FROM {_RANKED}")
def rank_candidates(spark, sf):
    return scoring.rank_candidates(_scores(spark, sf)).select("uid", "idx", "temperature", "chosen")


@query(
    "build_predictions",
    f"""SELECT uid, idx, temperature, uid || '_' || (DENSE_RANK() OVER (PARTITION BY uid, temperature ORDER BY idx) - 1) AS id,
    idx || '-' || chosen AS pred, chosen, chosen = 0 AS is_correct FROM {_RANKED}""",
)
def build_predictions(spark, sf):
    ranked = scoring.rank_candidates(_scores(spark, sf))
    return scoring.build_predictions(ranked, _ranking_items(spark, sf)).drop("task")


_FACETS = f"""(SELECT temperature, facet, value, COUNT(*) AS total, COUNT(*) FILTER (ok) AS correct,
  100.0::DOUBLE * COUNT(*) FILTER (ok) / COUNT(*) AS accuracy FROM (
  SELECT temperature, chosen = 0 AS ok, 'UID' AS facet, uid AS value FROM {_RANKED}
  UNION ALL SELECT temperature, chosen = 0, 'parity', CAST(idx % 2 AS VARCHAR) FROM {_RANKED}) GROUP BY ALL)"""


def _facets(spark, sf):
    ranked = scoring.rank_candidates(_scores(spark, sf))
    with_facets = ranked.join(_ranking_items(spark, sf).select("task", "uid", "idx", "label", "facets"), ["task", "uid", "idx"])
    return metrics.facet_accuracy(with_facets.withColumn("is_correct", F.col("chosen") == F.col("label")))


@query("facet_accuracy", f"SELECT temperature, facet, value, total, correct, ROUND(accuracy, 6) AS accuracy FROM {_FACETS}")
def facet_accuracy(spark, sf):
    return _facets(spark, sf).drop("task").withColumn("accuracy", F.round("accuracy", 6))


_MACRO = f"(SELECT temperature, AVG(accuracy) AS accuracy FROM {_FACETS} WHERE facet = 'UID' GROUP BY temperature)"


@query("macro_accuracy", f"SELECT temperature, ROUND(accuracy, 6) AS accuracy FROM {_MACRO}")
def macro_accuracy(spark, sf):
    return metrics.macro_accuracy(_facets(spark, sf)).drop("task").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "prefix_macro_accuracy",
    f"""SELECT temperature, ROUND(AVG(a), 6) AS accuracy FROM (SELECT temperature, left(value, 2) AS split, AVG(accuracy) AS a
    FROM {_FACETS} WHERE facet = 'UID' AND value IN ('u0', 'u1', 'u3') GROUP BY ALL) GROUP BY temperature""",
)
def prefix_macro_accuracy(spark, sf):
    out = metrics.prefix_macro_accuracy(_facets(spark, sf), ("u0", "u1", "u3", "absent"))
    return out.drop("task").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "best_temperature",
    f"SELECT arg_max(temperature, ROW(ROUND(accuracy, 9), -temperature)) AS temperature, ROUND(MAX(accuracy), 6) AS accuracy FROM {_MACRO}",
)
def best_temperature(spark, sf):
    best = metrics.best_temperature(metrics.macro_accuracy(_facets(spark, sf)))
    return best.select("temperature", F.round("accuracy", 6).alias("accuracy"))


@query(
    "accuracy_report",
    f"""SELECT temperature, line FROM (
      SELECT temperature, printf('TEMPERATURE: %.2f', temperature) AS line FROM {_MACRO}
      UNION ALL SELECT temperature, '' FROM {_MACRO}
      UNION ALL SELECT DISTINCT temperature, '### ' || upper(facet) || ' ACCURACY' FROM {_FACETS}
      UNION ALL SELECT temperature, value || ': ' || printf('%.2f', ROUND(accuracy, 6)) FROM {_FACETS}
      UNION ALL SELECT temperature, '' FROM (SELECT DISTINCT temperature, facet FROM {_FACETS})
      UNION ALL SELECT temperature, '### AVERAGE ACCURACY' FROM {_MACRO}
      UNION ALL SELECT temperature, printf('%.2f', ROUND(accuracy, 6)) FROM {_MACRO}
      UNION ALL SELECT temperature, '' FROM {_MACRO})""",
)
def accuracy_report(spark, sf):
    facets = _facets(spark, sf)
    return validation.format_report(facets, metrics.macro_accuracy(facets)).select("temperature", "line")


@query(
    "first_candidate_spearman",
    f"""WITH p AS (SELECT idx, EXP(MAX(CASE WHEN cand = 0 THEN logprob END) - MAX(logprob)) / SUM(EXP(logprob - m)) AS prob
      FROM (SELECT *, MAX(logprob) OVER (PARTITION BY idx) AS m FROM {_SCORES} WHERE temperature = 1.0) GROUP BY idx),
    j AS (SELECT ROUND(prob, 9) AS prob, ratio FROM p JOIN (SELECT vec_id // 4 AS idx, CAST(SUM(label) AS DOUBLE) AS ratio FROM embeddings GROUP BY 1) USING (idx)),
    r AS (SELECT RANK() OVER (ORDER BY prob) + (COUNT(*) OVER (PARTITION BY prob) - 1) / 2 AS a,
      RANK() OVER (ORDER BY ratio) + (COUNT(*) OVER (PARTITION BY ratio) - 1) / 2 AS b FROM j)
    SELECT ROUND(CORR(a, b), 6) AS rho, COUNT(*) AS n FROM r""",
)
def first_candidate_spearman(spark, sf):
    probs = scoring.first_candidate_prob(_scores(spark, sf).where("temperature = 1.0"))
    ratios = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("idx")).agg(
        F.sum("label").cast("double").alias("ratio")
    )
    both = probs.join(ratios, "idx").withColumn("prob", F.round("prob", 9))
    return stats.spearman(both, "prob", "ratio").withColumn("rho", F.round("rho", 6))


@query(
    "prediction_document",
    f"""WITH r AS (SELECT uid, idx, chosen FROM {_RANKED} WHERE temperature = 1.0)
    SELECT uid AS subtask, 1 AS part, idx, (CASE WHEN idx = MIN(idx) OVER (PARTITION BY uid) THEN '' ELSE ',' END) ||
      '{{"id":"' || uid || '_' || (ROW_NUMBER() OVER (PARTITION BY uid ORDER BY idx) - 1) || '","pred":"' || idx || '-' || chosen || '"}}' AS line FROM r
    UNION ALL SELECT DISTINCT uid, 0, -1, CASE WHEN uid = (SELECT MIN(uid) FROM r) THEN '{{' ELSE ',' END || '"' || uid || '": {{"predictions": [' FROM r
    UNION ALL SELECT DISTINCT uid, 2, -1, CASE WHEN uid = (SELECT MAX(uid) FROM r) THEN ']}}}}' ELSE ']}}' END FROM r""",
)
def prediction_document(spark, sf):
    ranked = scoring.rank_candidates(_scores(spark, sf))
    predictions = scoring.build_predictions(ranked, _ranking_items(spark, sf)).withColumnRenamed("uid", "subtask")
    return writers.prediction_document_lines(predictions.select("subtask", "idx", "temperature", "id", "pred"), 1.0)


# ---- n-gram scorer: every turn against its reversed word order -----------------------------------

_NGRAM = f"""WITH w AS ({sq.windows(1)}),
pairs AS (SELECT context, next, LN(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY context)) AS lp FROM w GROUP BY context, next),
wordp AS (SELECT next, LN(COUNT(*) / (SELECT COUNT(*) FROM w)) AS lp FROM w GROUP BY next),
c AS (SELECT conv_id, turn, 0 AS cand, {sq.words('text')} AS t FROM conversations
  UNION ALL SELECT conv_id, turn, 1, list_reverse({sq.words('text')}) FROM conversations),
s AS (SELECT conv_id, turn, cand, t[i] AS context, t[i + 1] AS next FROM (SELECT *, unnest(range(1, len(t))) AS i FROM c)),
l AS (SELECT conv_id, turn, c.cand, COALESCE(SUM(CASE WHEN s.next IS NOT NULL THEN COALESCE(p.lp, q.lp, {FLOOR}::DOUBLE) END), 0) AS logprob
  FROM c LEFT JOIN s USING (conv_id, turn, cand) LEFT JOIN pairs p USING (context, next) LEFT JOIN wordp q ON s.next = q.next GROUP BY ALL)
"""


def _ngram_scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    windows = ngrams.prefix_windows(ngrams.sentences(docs), 1)
    words = tx.words(F.col("text"))
    turns = table(spark, sf, "conversations")
    candidates = turns.select("conv_id", "turn", F.lit(0).alias("cand"), F.array_join(words, " ").alias("sentence")).unionByName(
        turns.select("conv_id", "turn", F.lit(1).alias("cand"), F.array_join(F.reverse(words), " ").alias("sentence"))
    )
    # pairs, words and totals come from the same shuffled windows; they are counted again for each, as the pairs take more disk than the text
    pairs = ngrams.next_word_stats(windows, packed=True)
    return scoring.ngram_score(candidates, pairs, ngrams.word_stats_of_pairs(pairs), ["conv_id", "turn", "cand"], FLOOR)


@query("ngram_score", _NGRAM + "SELECT conv_id, turn, cand, ROUND(logprob, 4) AS logprob FROM l")
def ngram_score(spark, sf):
    return _ngram_scored(spark, sf).withColumn("logprob", F.round("logprob", 4))


@query(
    "ngram_ranking",
    _NGRAM + """, r AS (SELECT conv_id, turn, arg_max(cand, ROW(ROUND(logprob, 6), -cand)) AS chosen FROM l GROUP BY ALL)
    SELECT role, COUNT(*) AS total, COUNT(*) FILTER (chosen = 0) AS correct FROM r JOIN conversations USING (conv_id, turn) GROUP BY role""",
)
def ngram_ranking(spark, sf):
    scored = _ngram_scored(spark, sf).withColumn("logprob", F.round("logprob", 6))
    ranked = scoring.rank_candidates(scored, ["conv_id", "turn"])
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    with_facets = ranked.join(turns, ["conv_id", "turn"]).select(
        F.create_map(F.lit("role"), F.col("role")).alias("facets"), (F.col("chosen") == 0).alias("is_correct")
    )
    return metrics.facet_accuracy(with_facets, keys=()).select(F.col("value").alias("role"), "total", "correct")


# ---- losses from logits --------------------------------------------------------------------------

def _student(spark, sf):
    return table(spark, sf, "embeddings").select(
        (F.floor(F.col("vec_id") / 80)).alias("batch"), F.floor(F.col("vec_id") / 8).alias("seq"),
        (F.col("vec_id") % 8).alias("pos"),
        F.when(F.col("vec_id") % 9 == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
        F.transform(nm.as_doubles(F.col("embedding")), lambda x: x * 20).alias("logits"),
    )


def _teachers(spark, sf):
    shift = F.explode(F.sequence(F.lit(1), F.lit(TEACHERS))).alias("teacher")
    base = table(spark, sf, "embeddings").select("vec_id", nm.as_doubles(F.col("embedding")).alias("e"), shift)
    return base.select(
        "teacher", F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("pos"),
        F.transform("e", lambda x: x * 10 * F.col("teacher")).alias("logits"),
    )


@query(
    "ensemble_mean_logits",
    """SELECT vec_id // 8 AS seq, vec_id % 8 AS pos, ROUND(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 20)), 6) AS total
    FROM embeddings""",
)
def ensemble_mean_logits(spark, sf):
    mean = distill.ensemble_mean_logits(_teachers(spark, sf))
    return mean.select("seq", "pos", F.round(nm.total(F.col("logits")), 6).alias("total"))


def _log_softmax_sql(xs: str) -> str:
    return f"list_transform({xs}, lambda v: v - {_lse(xs)})"


@query(
    "distillation_loss",
    f"""WITH r AS (SELECT vec_id // 80 AS batch, vec_id // 8 AS seq, CASE WHEN vec_id % 9 = 0 THEN -100 ELSE label END AS label,
      {_LOGITS} AS s, list_transform({_LOGITS}, lambda x: x * 1.0) AS t FROM embeddings),
    h AS (SELECT batch, seq, label, s, list_transform(s, lambda x: x / 2) AS s2, list_transform(t, lambda x: x / 2 + 0.0) AS t2 FROM r),
    n AS (SELECT batch, seq, label, s, {_lse('s')} AS ls, s2, t2, {_lse('s2')} AS ls2, {_lse('t2')} AS lt2 FROM h),
    k AS (SELECT batch, seq, CASE WHEN label <> -100 THEN ls - s[label + 1] END AS ce,
      list_sum(list_transform(t2, lambda v, i: exp(v - lt2) * ((v - lt2) - (s2[i] - ls2)))) AS kl FROM n)
    SELECT batch, ROUND(SUM(ce) / COUNT(ce), 6) AS ce, ROUND(SUM(kl) / COUNT(DISTINCT seq) * 4, 6) AS kl,
    ROUND(0.5 * SUM(ce) / COUNT(ce) + 0.5 * SUM(kl) / COUNT(DISTINCT seq) * 4, 6) AS loss FROM k GROUP BY batch""".replace(
        "lambda x: x * 1.0)", "lambda x: x * 0.75)"
    ),
)
def distillation_loss(spark, sf):
    # Teachers of factor 10, 20 and 15 average to 15, three quarters of the student's logits.
    teachers = _teachers(spark, sf).withColumn(
        "logits", F.when(F.col("teacher") == 3, F.transform("logits", lambda x: x / 2)).otherwise(F.col("logits"))
    )
    loss = distill.distillation_loss(_student(spark, sf), distill.ensemble_mean_logits(teachers))
    return loss.select("batch", *[F.round(c, 6).alias(c) for c in ("ce", "kl", "loss")])


_LOSSES = """(SELECT event_type AS model, SUM(value * (user_id % 7)) / SUM(user_id % 7) / 20 AS loss FROM events GROUP BY 1)"""


def _losses(spark, sf):
    batches = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), (F.col("value") / 20).alias("loss"), (F.col("user_id") % 7).alias("n_valid")
    )
    return distill.token_weighted_loss(batches, ("model",))


@query("perplexity", f"SELECT model, ROUND(loss, 6) AS loss, ROUND(EXP(loss), 4) AS perplexity FROM {_LOSSES}")
def perplexity(spark, sf):
    return _losses(spark, sf).select("model", F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


@query(
    "compare_models",
    f"""WITH l AS (SELECT MAX(loss) FILTER (model = 'view') AS a, MAX(loss) FILTER (model = 'click') AS b FROM {_LOSSES})
    SELECT ROUND(a, 6) AS base_loss, ROUND(b, 6) AS other_loss, ROUND(b - a, 6) AS loss_diff,
    ROUND(EXP(b) - EXP(a), 4) AS ppl_diff,
    CASE WHEN EXP(b) < EXP(a) THEN ROUND(ABS((EXP(b) - EXP(a)) / EXP(a) * 100), 4) END AS ppl_improvement FROM l""",
)
def compare_models(spark, sf):
    out = distill.compare_models(_losses(spark, sf), "view", "click")
    return out.select(
        *[F.round(c, 6).alias(c) for c in ("base_loss", "other_loss", "loss_diff")],
        *[F.round(c, 4).alias(c) for c in ("ppl_diff", "ppl_improvement")],
    )


