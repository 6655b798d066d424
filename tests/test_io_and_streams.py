"""Readers and writers on small files, checks, and streams over several batches."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexmill import catalogue
from lexmill.operators import items, validation
from lexmill.sources import readers, writers
from lexmill.streaming import incremental


def concatenated(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_corpus_line_numbers_over_many_blocks(spark, tmp_path):
    for name in ("b.train", "a.train"):
        (tmp_path / name).write_text("\n".join(f"{name} {i} {'x' * (i % 50)}" for i in range(5000)) + "\n")
    (tmp_path / "skip.txt").write_text("no\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_text_corpus(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 10000
    assert all(int(r["text"].split()[1]) == r["line_no"] for r in rows)
    with pytest.raises(ValueError):
        readers.read_text_corpus(spark, str(tmp_path), "*.none")


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.train").write_text("".join(f"{folder} {i}\n" for i in range(3)))
    rows = readers.read_text_corpus(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["line_no"], r["text"]) for r in rows) == sorted(("same.train", i, f"{f} {i}") for f in "xy" for i in range(3))
    assert len({r["path"] for r in rows}) == 2


def test_text_sink_keeps_order(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("ord"), F.format_string("line %d", "id").alias("text")).repartition(7)
    writers.write_text(df, str(tmp_path / "out"), ["ord"])
    assert concatenated(tmp_path / "out") == "".join(f"line {i}\n" for i in range(1000))


def test_marked_stream(spark, tmp_path):
    df = spark.createDataFrame([(2, "b c"), (1, "a"), (3, "d")], "ord int, text string").repartition(3)
    writers.write_marked_stream(df, str(tmp_path / "out"), ["ord"])
    assert concatenated(tmp_path / "out") == "<s> a </s> <s> b c </s> <s> d </s> "


def test_prediction_document_roundtrip(spark, tmp_path):
    rows = [(s, i, 1.0, f"{s}_{i}", f'say "{i}" é', 0.5) for s in ("a", 'b"q') for i in range(30)]
    df = spark.createDataFrame(rows, "subtask string, idx bigint, temperature double, id string, pred string, prob double")
    writers.write_predictions(df.unionByName(df.withColumn("temperature", F.lit(2.0))), str(tmp_path / "p"), 1.0)
    document = json.loads(concatenated(tmp_path / "p"))
    assert [p["id"] for p in document['b"q']["predictions"]] == [f'b"q_{i}' for i in range(30)]
    (tmp_path / "one.json").write_text(json.dumps(document))
    back = readers.read_predictions(spark, str(tmp_path / "one.json"))
    assert sorted((r["subtask"], r["idx"], r["id"], r["pred"], r["prob"]) for r in back.collect()) == sorted(
        (s, i, d, p, x) for s, i, _, d, p, x in rows
    )


def test_reading_predictions_with_nan(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"reading": {"predictions": [{"id": 0, "pred": 1.5, "prev_pred": NaN}, {"id": 1, "pred": 2.5, "prev_pred": 1.0}]}}')
    rows = readers.read_predictions(spark, str(tmp_path / "r.json")).orderBy("idx").collect()
    assert [float(r["pred"]) for r in rows] == [1.5, 2.5]
    assert math.isnan(rows[0]["prev_pred"]) and rows[1]["prev_pred"] == 1.0


def test_jsonl_items_and_decoding(spark, tmp_path):
    (tmp_path / "turns.jsonl").write_text(
        "\n".join(json.dumps({"row": i, "sentence_good": f"g{i}", "sentence_bad": f"b{i}"}) for i in range(3)) + "\n"
    )
    (tmp_path / "notes.txt").write_text("x")
    raw = readers.read_jsonl_items(spark, str(tmp_path), "sentence_good string, sentence_bad string, field string, UID string, linguistics_term string")
    rows = items.decode(raw, "blimp").orderBy("idx").collect()
    assert [(r["uid"], r["idx"], r["sentences"], r["label"]) for r in rows] == [("turns", i, [f"g{i}", f"b{i}"], 0) for i in range(3)]
    assert rows[0]["facets"] == {"UID": "turns", "field": "supplement", "linguistics_term": "supplement"}
    assert items.candidates(items.decode(raw, "blimp")).count() == 6
    with pytest.raises(NotImplementedError):
        items.decode(raw, "unknown")


def test_other_readers(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" cat \ndog\n\ncat\n")
    (tmp_path / "w.csv").write_text("word,n\ncat,1\nowl,2\n")
    (tmp_path / "bad.csv").write_text("token\ncat\n")
    assert {r[0] for r in readers.read_word_list(spark, str(tmp_path / "w.txt")).collect()} == {"cat", "dog"}
    assert {r[0] for r in readers.read_word_list(spark, str(tmp_path / "w.csv")).collect()} == {"cat", "owl"}
    for bad in ("bad.csv", "w.json"):
        with pytest.raises(ValueError):
            readers.read_word_list(spark, str(tmp_path / bad))
    (tmp_path / "t.csv").write_text('item,v\n,1.5\n"a, b",2\n')
    rows = readers.read_csv(spark, str(tmp_path / "t.csv"), "item string, v double", ("item",)).collect()
    assert [(r["item"], r["v"]) for r in rows] == [("None", 1.5), ("a, b", 2.0)]
    (tmp_path / "c.json").write_text(json.dumps({"cat": [{"context": "the"}, {"context": "a"}], "x": [{"context": "y"}], "dog": []}))
    rows = readers.read_word_contexts(spark, str(tmp_path / "c.json"), 1).collect()
    assert [(r["word"], r["context_id"], r["context"]) for r in rows] == [("cat", 0, "the"), ("cat", 1, "a")]


def test_article_json(spark, tmp_path):
    folder = tmp_path / "volume_01" / "part_01"
    folder.mkdir(parents=True)
    (folder / "A.json").write_text(json.dumps({"url": "u", "title": "A", "content": "c", "timestamp": "t"}, indent=2))
    (folder / "B.json").write_text("{broken")
    rows = {r["name"]: r for r in readers.read_article_json(spark, str(tmp_path)).collect()}
    assert rows["A.json"]["title"] == "A" and "part_01" in rows["A.json"]["path"]
    assert rows["B.json"]["_corrupt_record"] is not None


def test_surprisal_document(spark, tmp_path):
    record = '{"step": "chck_1M", "word_count": 1000000, "target_word": "w", "context_id": 0, "context": "c", "surprisal": NaN}'
    (tmp_path / "s.json").write_text('{"metadata": {"total_steps": 1}, "results": [' + record + "]}")
    row = readers.read_surprisal(spark, str(tmp_path / "s.json")).first()
    assert row["target_word"] == "w" and math.isnan(row["surprisal"])


def test_results_layout(spark, tmp_path):
    df = spark.createDataFrame([("m", None, "causal", "t", "d", 1)], "model string, revision string, backend string, task string, dataset string, x int")
    writers.write_results(df, str(tmp_path / "r"))
    assert (tmp_path / "r" / "model=m" / "revision=main" / "backend=causal" / "task=t" / "dataset=d").is_dir()
    writers.write_partitioned_jsonl(df, str(tmp_path / "j"), "task")
    assert (tmp_path / "j" / "task=t").is_dir()


def test_catalogue_check(spark):
    rows = [("entity_tracking", "regular_0_ops", i) for i in range(606)] + [("reading", "reading", 0)]
    found = validation.check_sizes(
        spark.createDataFrame(rows, "task string, subtask string, idx int"),
        validation.size_catalogue(spark, {k: catalogue.FAST_SIZES[k] for k in ("entity_tracking", "reading", "wug_past")}),
    ).collect()
    assert {(r["task"], r["subtask"], r["found"]) for r in found} == {
        ("reading", "reading", 1), ("wug_past", None, 0), *{("entity_tracking", f"regular_{i}_ops", 0) for i in range(1, 6)}
    }


def test_schedules(spark):
    assert validation.checkpoint_schedule(spark, "strict-small").count() == 19
    full = validation.checkpoint_schedule(spark, "strict")
    assert full.count() == 28
    assert full.orderBy(F.desc("ord")).first()["step"] == "chck_1000M"


def test_page_stream_skips_seen_urls_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        df = spark.createDataFrame([(f"u{k}", 1000 + 10 * i + k) for k in range(i, i + 3)], "url string, s bigint")
        df.select("url", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = incremental.read_stream(spark, str(source), schema, files_per_trigger=1)
    urls = [r["url"] for r in incremental.drain(incremental.new_pages(stream)).collect()]
    assert sorted(urls) == [f"u{k}" for k in range(5)]


def _append(spark, tmp_path, state, files_per_trigger):
    stream = incremental.read_stream(spark, str(tmp_path / "in"), "step string, v int", files_per_trigger=files_per_trigger)
    incremental.append_new_rows(stream, str(tmp_path / "out"), str(tmp_path / state), ["step", "v"]).awaitTermination()
    return {r["step"]: (r["count"], r["d"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("step").agg(F.count("*").alias("count"), F.countDistinct("v").alias("d")).collect()}


def _add(spark, tmp_path, step, values):
    spark.createDataFrame([(step, v) for v in values], "step string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_resumed_steps_are_not_added_twice(spark, tmp_path):
    _add(spark, tmp_path, "chck_1M", range(4))
    _append(spark, tmp_path, "state", 100)
    _add(spark, tmp_path, "chck_1M", range(4))
    _add(spark, tmp_path, "chck_2M", range(4))
    assert _append(spark, tmp_path, "state", 100) == {"chck_1M": (4, 4), "chck_2M": (4, 4)}


def test_a_step_over_several_batches_keeps_all_rows_also_in_a_replay(spark, tmp_path):
    for i in range(6):
        _add(spark, tmp_path, "chck_1M", range(10 * i, 10 * i + 10))
    assert _append(spark, tmp_path, "state", 2) == {"chck_1M": (60, 60)}
    # a query that lost its state reads everything again, in other batches
    assert _append(spark, tmp_path, "fresh", 4) == {"chck_1M": (60, 60)}
