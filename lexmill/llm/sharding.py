"""Shards of equal size by vector bin packing.

Bytes, words and rows are balanced together. Documents with equal text form a group and share a shard, unless the group is larger than
a shard, when it is split by a hash of the document and its row number. Groups (or parts) of at least ``1 / FINE`` of a shard in any measure are packed one
by one, and the many small ones are packed as cells of groups chosen by a hash of the text. So the packing list has at most
``shards * FINE * 4`` large units and ``shards * FINE`` cells, whatever the corpus; it is packed on the driver, largest first,
each unit to the shard where the dot product of its size and the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, slots, stored

FINE = 256
PARTS = 2  # a group that exceeds a shard's capacity in any measure is split into parts of about 1 / PARTS of it
MEASURES = ("bytes", "words", "rows")
WEIGHTS = (1.0, 0.3, 0.1)  # of the measures in the dot product: bytes must be near equal, the others follow


def pack(units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unit (rows of bytes, words, rows), largest first by its greatest share of a shard's capacity.

    A unit goes to the shard with the largest dot product of its normalised, weighted size and the residual capacity; of equal ones to
    the first. Residuals may become negative, which lowers the product and so the choice.
    """
    capacity = np.maximum(units.sum(axis=0) / shards, 1e-9)
    share = units / capacity
    weighed = share * np.array(WEIGHTS)
    order = np.lexsort((np.arange(len(units)), -share.max(axis=1)))
    residual = np.ones((shards, units.shape[1]))
    out = np.zeros(len(units), np.int32)
    for i in order:
        s = int((residual @ weighed[i]).argmax())
        out[i] = s
        residual[s] -= share[i]
    return out


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the UTF-8 length plus 16, or 16 for a null text. Defined cases: null texts are one group, as are empty ones; repeated
    rows are placed one by one and get slots of their own; an empty table gives no rows. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
            F.when(F.col("text").isNotNull(), F.crc32(F.col("text").cast("binary"))).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
            F.xxhash64("text").alias("group"),
            # the row number tells repeated rows apart; it is written once, here
            F.xxhash64("doc_id", "text", F.lit("part"), F.monotonically_increasing_id()).alias("own"),
        ), "sizes",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return _result(rows.withColumn("shard", F.lit(0)))
    capacity = {m: max(total[m] / shards, 1e-9) for m in MEASURES}
    share = F.greatest(*[F.col(m) / F.lit(capacity[m]) for m in MEASURES])

    groups = stored(rows.groupBy("group").agg(*sums), "groups")
    # At most shards * 3 groups are over the bound: their sizes add up to no more than the corpus in each measure.
    hot = {r["group"]: int(np.ceil(r["share"] * PARTS)) for r in groups.withColumn("share", share).where(F.col("share") > 1).select("group", "share").collect()}
    parts = spark.createDataFrame(list(hot.items()) or [], "group bigint, parts int")
    marked = rows.join(F.broadcast(parts), "group", "left").withColumn("part", F.coalesce(F.pmod("own", F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    hot_rows = marked.join(F.broadcast(parts.select("group")), "group", "left_semi")
    split = hot_rows.groupBy("group", "part").agg(*sums)
    whole = groups.join(F.broadcast(parts.select("group")), "group", "left_anti").withColumn("part", F.lit(0)).select("group", "part", *MEASURES)
    units = whole.unionByName(split.select("group", "part", *MEASURES)).withColumn("large", share >= 1 / FINE)

    cells = shards * FINE
    cell = F.pmod(F.xxhash64("group", F.lit("cell")), F.lit(cells)).cast("int")
    # Bounded by the number of cells and by 1 / FINE of the capacity that every large unit takes.
    large = units.where("large").select("group", "part", *MEASURES).collect()
    small = units.where("not large").groupBy(cell.alias("cell")).agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()
    large.sort(key=lambda r: (r["group"], r["part"]))
    small.sort(key=lambda r: r["cell"])
    placed = pack(np.array([[r[m] for m in MEASURES] for r in [*large, *small]], float), shards)
    of_large = spark.createDataFrame([(r["group"], r["part"], int(s)) for r, s in zip(large, placed)], "group bigint, part int, s1 int")
    of_cell = spark.createDataFrame([(r["cell"], int(s)) for r, s in zip(small, placed[len(large) :])], "cell int, s2 int")
    found = (
        marked.join(F.broadcast(of_large), ["group", "part"], "left").withColumn("cell", cell)
        .join(F.broadcast(of_cell), "cell", "left").withColumn("shard", F.coalesce("s1", "s2"))
    )
    return _result(found)


def _result(rows: DataFrame) -> DataFrame:
    numbered = slots(rows, "shard", F.xxhash64("own", F.lit("slot")))
    return numbered.select(
        "doc_id", "size", F.coalesce("text_crc32", F.lit(0)).cast("bigint").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
