"""Queries over pre-tokens, learned vocabularies and token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import tokens as tk
from lexmill.plans import sqlparts as sq
from lexmill.plans.registry import query, table
from lexmill.session import cut_lineage, python_partitions

VOCAB, LENGTH, OFFSET, SEED = tk.VOCAB_SIZE, 128, 7, 42
MASK, BOS, EOS, CLS = 1, 2, 3, 4


def _texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query(
    "pretoken_counts",
    r"""SELECT pretoken, COUNT(*) AS count FROM (SELECT unnest(regexp_extract_all(' ' || nfc_normalize(text),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x{85}\p{Z}\p{L}\p{N}]+|[\t-\r\x{85}\p{Z}]+')) AS pretoken
    FROM documents) GROUP BY 1""",
)
def pretoken_counts(spark, sf):
    return tk.pretoken_counts(_texts(spark, sf))


def _vocabulary(spark, sf):
    counts = tk.pretoken_counts(_texts(spark, sf))
    return tk.train_bpe(counts, vocab_size=VOCAB)


@query("bpe_vocabulary")
def bpe_vocabulary(spark, sf):
    """Vocabulary learned from all documents with the number of uses of every token."""
    counts = cut_lineage(tk.pretoken_counts(_texts(spark, sf)))
    vocabulary = tk.train_bpe(counts, vocab_size=VOCAB)
    used = tk.pretoken_frequencies(counts, vocabulary)
    return tk.vocabulary_table(vocabulary, spark).join(used, "id", "left").na.fill(0, ["freq"])


@query("bpe_roundtrip", "SELECT COUNT(*) AS n_docs, COUNT(*) AS n_equal FROM documents")
def bpe_roundtrip(spark, sf):
    vocabulary = _vocabulary(spark, sf)
    return tk.roundtrip_check(tk.encode_docs(_texts(spark, sf), vocabulary), vocabulary)


def _hashed(spark, sf, name="documents", key="doc_id"):
    """White-space tokens as ids: the first 7 digits of their MD5, so that SQL can compute the same."""
    ids = F.transform(
        tx.words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int")
    )
    return table(spark, sf, name).select(key, ids.alias("tokens"))


def _ids(expr: str) -> str:
    return f"list_transform({sq.words(expr)}, lambda w: CAST(('0x' || left(md5(w), 7)) AS INTEGER))"


_STREAM = f"""WITH t AS (SELECT doc_id, unnest({_ids('text')}) AS tok, generate_subscripts({sq.words('text')}, 1) AS i
  FROM documents),
s AS (SELECT tok, ROW_NUMBER() OVER (ORDER BY doc_id, i) - 1 AS pos FROM t)
"""


@query(
    "pack_sequences",
    _STREAM + f"""SELECT CAST((pos - {OFFSET}) // {LENGTH} AS BIGINT) AS chunk_id,
    string_agg(tok, ' ' ORDER BY pos) AS tokens FROM s WHERE pos >= {OFFSET}
    GROUP BY 1 HAVING COUNT(*) = {LENGTH}""",
)
def pack_sequences(spark, sf):
    return _joined(tk.pack_sequences(_hashed(spark, sf), LENGTH, OFFSET), "chunk_id", "tokens")


def _joined(df, *columns):
    return df.select(
        *[F.array_join(F.col(c), " ").alias(c) if "array" in df.schema[c].dataType.simpleString() else F.col(c) for c in columns]
    )


@query(
    "random_offset_chunks",
    _STREAM + f""", c AS (SELECT i AS chunk_id, i * {LENGTH}
      + CAST(('0x' || left(md5('{SEED}|0|' || i), 8)) AS BIGINT) % {LENGTH} AS start
      FROM range((SELECT COUNT(*) // {LENGTH} - 1 FROM s)) r(i))
    SELECT chunk_id, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM s, c
    WHERE pos >= start AND pos < start + {LENGTH} GROUP BY chunk_id""",
)
def random_offset_chunks(spark, sf):
    return _joined(tk.random_offset_chunks(_hashed(spark, sf), LENGTH, SEED), "chunk_id", "tokens")


@query(
    "next_token_pairs",
    f"""SELECT doc_id, array_to_string(t[1:len(t) - 1], ' ') AS inputs, array_to_string(t[2:], ' ') AS targets
    FROM (SELECT doc_id, {_ids('text')} AS t FROM documents)""",
)
def next_token_pairs(spark, sf):
    return _joined(tk.next_token_pairs(_hashed(spark, sf)), "doc_id", "inputs", "targets")


# A turn is a prefix of its first five words and a completion of the others.
@query(
    "completion_positions",
    rf"""WITH w AS (SELECT conv_id, turn, {sq.words('text')} AS ws FROM conversations),
    p AS (SELECT conv_id, turn, ws, array_to_string(ws, ' ') AS sentence, array_to_string(ws[6:], ' ') AS completion FROM w)
    SELECT conv_id, turn, array_to_string(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN
      length(array_to_string(ws[1:i], ' ')) > length(sentence) - length(completion) THEN 1 ELSE 0 END), ' ') AS phrase_mask
    FROM p WHERE length(sentence) > 0""",
)
def completion_positions(spark, sf):
    return _joined(_turns(spark, sf), "conv_id", "turn", "phrase_mask")


def _turns(spark, sf):
    words = F.col("words")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda i: F.length(F.array_join(F.slice(words, F.lit(1), i), " "))
    )
    offsets = F.zip_with(
        ends, words, lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("end"))
    )
    return (
        table(spark, sf, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("sentence", F.array_join("words", " "))
        .withColumn("completion", F.array_join(F.expr("slice(words, 6, size(words))"), " "))
        .withColumn("offsets", offsets)
        .withColumn("phrase_mask", tk.completion_positions(F.col("offsets"), F.col("sentence"), F.col("completion")))
        .withColumn("tokens", F.transform("words", lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int")))
    )


def _masked_sql(at: str) -> str:
    return f"""WITH w AS (SELECT conv_id, turn, {_ids('text')} AS t FROM conversations)
    SELECT conv_id, turn, CAST(p AS INTEGER) AS position, CAST({at} AS INTEGER) AS predict_at, t[p + 1] AS target,
      array_to_string(list_transform(t, lambda x, j: CASE WHEN j = p + 1 THEN {MASK} ELSE x END), ' ') AS masked
    FROM (SELECT *, unnest(range(5, len(t))) AS p FROM w WHERE len(t) > 0)"""


for _mode, _at in (("mlm", "p"), ("mntp", "p - 1"), ("enc_dec_mask", "1")):

    @query(f"mask_each_position_{_mode}", _masked_sql(_at))
    def mask_each_position(spark, sf, mode=_mode):
        # a turn grows with the square of its length, so turns are dealt to more tasks than the scan has
        turns = python_partitions(_turns(spark, sf).select("conv_id", "turn", "tokens", "phrase_mask"), "conv_id", "turn")
        rows = tk.mask_each_position(turns, mode, MASK)
        return _joined(rows, "conv_id", "turn", "position", "predict_at", "target", "masked")


@query(
    "prefix_target_layout",
    f"""SELECT conv_id, turn,
    array_to_string([{CLS}] || (CASE WHEN turn % 2 = 0 THEN t[1:5] ELSE CAST([] AS INTEGER[]) END) || [{MASK}, {EOS}], ' ') AS encoder,
    array_to_string([{BOS}, {MASK}] || d[1:len(d) - 1], ' ') AS decoder, array_to_string(d, ' ') AS targets
    FROM (SELECT *, t[6:] AS d FROM (SELECT conv_id, turn, {_ids('text')} AS t FROM conversations)) WHERE len(t) > 0""",
)
def prefix_target_layout(spark, sf):
    items = _turns(spark, sf).select(
        "conv_id", "turn",
        F.when(F.col("turn") % 2 == 0, F.slice("tokens", 1, 5)).alias("prefix_tokens"),
        F.expr("slice(tokens, 6, size(tokens))").alias("completion_tokens"),
    )
    laid = tk.prefix_target_layout(items, CLS, MASK, EOS, BOS)
    return _joined(laid, "conv_id", "turn", "encoder", "decoder", "targets")


@query(
    "append_masks",
    f"""SELECT doc_id, array_to_string(t || [{MASK}, {MASK}, {MASK}, {EOS}], ' ') AS with_masks,
    CAST(len(t) - 1 AS INTEGER) AS predict_at FROM (SELECT doc_id, {_ids('text')} AS t FROM documents)""",
)
def append_masks(spark, sf):
    return _joined(tk.append_masks(_hashed(spark, sf), MASK, 3, shifted=True, end_id=EOS), "doc_id", "with_masks", "predict_at")


@query("truncate_tokens", f"SELECT doc_id, array_to_string({_ids('text')}[1:{LENGTH}], ' ') AS tokens FROM documents")
def truncate_tokens(spark, sf):
    cut = _hashed(spark, sf).withColumn("tokens", tk.truncate(F.col("tokens"), LENGTH))
    return _joined(cut, "doc_id", "tokens")
