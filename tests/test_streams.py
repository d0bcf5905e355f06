import json

import pytest
from pyspark.sql import functions as F

from topicflow import schemas
from topicflow.operators import store
from topicflow.sources import messages as src
from topicflow.sources.tables import append_reports, read_table, write_batch
from topicflow.streaming import jobs


def land(spark, path, values, mode="append"):
    rows = [(bytearray(v if isinstance(v, bytes) else json.dumps(v).encode()), 0, i) for i, v in enumerate(values)]
    spark.createDataFrame(rows, schemas.MESSAGES).coalesce(1).write.mode(mode).parquet(path)


def article(ext, **more):
    return {"external_id": ext, "text": f"text of {ext}", "title": f"title {ext}", **more}


def ids_in(spark, tables):
    return sorted(r["external_id"] for r in read_table(spark, tables.incoming_news, schemas.INCOMING_NEWS).collect())


def test_ingest_twice_and_replay(spark, tmp_path):
    tables, landing = jobs.Tables(str(tmp_path / "t")), str(tmp_path / "landing")
    run = lambda: jobs.ingest_stream(src.file_source(spark, landing), tables, str(tmp_path / "cp"), None).awaitTermination()
    land(spark, landing, [article("a"), article("b"), article("a"), b"junk", [1]])
    run()
    assert ids_in(spark, tables) == ["a", "b"]
    rejects = read_table(spark, tables.rejected_messages, schemas.REJECTED)
    assert sorted(r["reason"] for r in rejects.collect()) == ["invalid_json", "not_an_object"]

    run()  # nothing new
    land(spark, landing, [article("b"), article("c")])
    run()
    assert ids_in(spark, tables) == ["a", "b", "c"]

    # the second batch again, as after a crash before its commit
    again = spark.createDataFrame([(bytearray(json.dumps(article(e)).encode()), 0, i) for i, e in enumerate("bc")], schemas.MESSAGES)
    jobs.ingest_batch(again, 1, tables)
    assert ids_in(spark, tables) == ["a", "b", "c"]
    log = read_table(spark, tables.ingest_log, schemas.INGEST_LOG)
    assert {(r["batch_id"], r["outcome"]): r["n"] for r in log.collect()} == {
        (0, "stored"): 2, (0, "duplicate"): 1, (0, "invalid_json"): 1, (0, "not_an_object"): 1,
        (1, "stored"): 1, (1, "duplicate"): 1,
    }
    assert jobs.read_status(spark, tables).where("status = 'new'").count() == 3


def test_a_single_partition_is_parsed_in_parallel(spark, tmp_path, monkeypatch):
    seen, parse = [], jobs.ingest.parse_messages
    monkeypatch.setattr(jobs.ingest, "parse_messages", lambda m: seen.append(m) or parse(m))
    rows = [(bytearray(json.dumps(article(f"e{i}")).encode()), 0, i) for i in range(400)]
    messages = spark.createDataFrame(rows, schemas.MESSAGES).coalesce(1)
    tables = jobs.Tables(str(tmp_path / "t"))
    jobs.ingest_batch(messages, 0, tables)
    held = [n for n in seen[0].rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(held) == 400 and len(held) > 1
    assert len(ids_in(spark, tables)) == 400


def setup_news(spark, tables, titles):
    stamp = F.lit("2024-01-01").cast("timestamp")
    rows = [(f"id{i}", f"e{i}", t, "body") for i, t in enumerate(titles)]
    news = spark.createDataFrame(rows, "id string, external_id string, title string, raw_text string").select(
        "id", "external_id", "title", F.lit("s").alias("source"), stamp.alias("published_at"), "raw_text",
        F.lit("u").alias("url"), F.lit("{}").alias("payload_json"), stamp.alias("created_at"),
    )
    write_batch(news, tables.incoming_news, 0)
    write_batch(store.status_entries(news.select("id"), "new", stamp), tables.status_new, 0)
    return news


def metadata(spark, path, label):
    rows = [(0, label, ["w"], True, None), (1, "hidden", [], False, None)]
    spark.createDataFrame(rows, schemas.TOPIC_METADATA).write.mode("overwrite").parquet(path)


def by_length(df):
    return df.select("id", (F.length("text") % 3).cast("int").alias("cluster"), F.lit(0.6).alias("score"))


def final(spark, tables):
    rows = store.current_status(jobs.read_status(spark, tables)).collect()
    return {r["id"]: (r["status"], r["error_message"]) for r in rows}


def test_scoring(spark, tmp_path):
    tables = jobs.Tables(str(tmp_path / "t"))
    news = setup_news(spark, tables, ["abc", "abcd", None, "abcde"])
    metadata(spark, tables.topic_metadata, "zero")
    for _ in range(2):  # the second run finds nothing to do
        jobs.score_stream(jobs.news_source(spark, tables), tables, by_length, str(tmp_path / "cp"), 0.5, interval=None).awaitTermination()
    reports = read_table(spark, tables.clustering_reports, schemas.CLUSTERING_REPORTS)
    assert {r["news_id"]: (r["cluster_id"], r["cluster_label"], r["score"]) for r in reports.collect()} == {
        "id0": (0, "zero", 0.6), "id1": (None, "unknown", 0.6), "id3": (None, "unknown", 0.6),
    }
    assert final(spark, tables) == {
        "id0": ("processed", None), "id1": ("processed", None), "id2": ("failed", "title is null"), "id3": ("processed", None),
    }
    log = read_table(spark, tables.batch_log, schemas.BATCH_LOG).collect()
    assert [(r["processed"], r["unknown"]) for r in log] == [(3, 2)]

    # the same batch replayed, and the same news in a later batch
    meta = spark.read.parquet(tables.topic_metadata)
    jobs.score_batch(news, 0, tables, by_length, 0.5, meta)
    jobs.score_batch(news, 1, tables, by_length, 0.5, meta)
    assert read_table(spark, tables.clustering_reports, schemas.CLUSTERING_REPORTS).count() == 3


def test_failed_model_and_failed_join(spark, tmp_path):
    tables = jobs.Tables(str(tmp_path / "t"))
    news = setup_news(spark, tables, ["abc"])

    def broken(df):
        raise RuntimeError("no weights " + "x" * 2000)

    metadata(spark, tables.topic_metadata, "zero")
    jobs.score_batch(news, 0, tables, broken, None, spark.read.parquet(tables.topic_metadata))
    status, message = final(spark, tables)["id0"]
    assert status == "failed" and message.startswith("no weights") and len(message) == 1000

    other = jobs.Tables(str(tmp_path / "o"))
    news = setup_news(spark, other, ["abc"])
    jobs.score_batch(news, 0, other, by_length, None, spark.range(1))
    assert final(spark, other)["id0"] == ("failed", "unexpected error during batch processing")


def test_metadata_keeps_the_last_good_copy(spark, tmp_path):
    path, last = str(tmp_path / "meta"), {}
    with pytest.raises(Exception, match="meta"):
        jobs._load_metadata(spark, path, last)
    metadata(spark, path, "zero")
    assert jobs._load_metadata(spark, path, last).count() == 2
    assert jobs._load_metadata(spark, path + "-gone", last) is last["df"]


def test_publish(spark, tmp_path):
    landing = tmp_path / "api"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps({"results": [{"content": "Текст", "link": "http://x", "title": "t"}, {"title": "empty"}]}, indent=1))
    (landing / "b.json").write_text(json.dumps({"status": "error"}))
    (landing / "c.json").write_text("<html>502</html>")
    out = str(tmp_path / "out")
    jobs.publish_stream(
        src.api_responses(spark, str(landing)), lambda df, i: write_batch(df, out, i), str(tmp_path / "cp"), None
    ).awaitTermination()
    sent = [json.loads(bytes(r["value"])) for r in spark.read.parquet(out).collect()]
    assert [(m["external_id"], m["text"]) for m in sent] == [("http://x", "Текст")]


def test_empty_report_append(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.CLUSTERING_REPORTS)
    append_reports(empty, str(tmp_path / "r"))
    assert spark.read.schema(schemas.CLUSTERING_REPORTS).parquet(str(tmp_path / "r")).count() == 0


def test_stream_spikes_late_rows_and_history(spark, tmp_path):
    from datetime import datetime, timedelta

    from topicflow.streaming import spikes

    schema = "ts timestamp, event_type string"
    landing, root = str(tmp_path / "landing"), str(tmp_path / "spikes")
    day = lambda d, h=12: datetime(2024, 1, d, h)

    def land_rows(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)

    # topic a: 2, 2, 3, 2, 2 then 9 events a day; topic b once; a null topic
    counts = {1: 2, 2: 2, 3: 3, 4: 2, 5: 2, 6: 9}
    for d, n in counts.items():
        land_rows([(day(d), "a")] * (n - (1 if d == 4 else 0)) + ([(day(d), "b")] if d == 2 else []) + ([(day(d), None)] if d == 3 else []))
        if d == 5:
            land_rows([(day(4, 1), "a")])  # a day late, within the two days of delay: counted
    land_rows([(day(1, 2), "a")])  # five days late, behind the watermark: dropped
    for extra in (30, 31):
        land_rows([(day(6) + timedelta(days=extra), spikes.END)])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    spikes.run_alerts(source, root, "ts", "event_type", "1 day", "2 days", history=7, sigmas=1.5)
    key = lambda r: (r[0], r[1] or "")
    got = sorted(
        ((r.start.day, r.topic, r.n, r.is_spike, r.sd is None) for r in spark.read.parquet(f"{root}/alerts").collect()), key=key
    )
    # the batch report over the same events, without the row behind the watermark
    from topicflow.operators import analytics

    rows = [(day(d), "a") for d, n in counts.items() for _ in range(n)] + [(day(2), "b"), (day(3), None)]
    batch = analytics.topic_spikes(analytics.topic_dynamics(spark.createDataFrame(rows, schema), "ts", "event_type"), sigmas=1.5)
    want = sorted(((r.start.day, r.topic, r.n, r.is_spike, r.sd is None) for r in batch.collect()), key=key)
    assert got == want
    assert [r[0] for r in got if r[3]] == [3, 6]


def test_status_snapshot_and_tail(spark, tmp_path):
    from topicflow.operators.statuslog import StatusLog

    tables = jobs.Tables(str(tmp_path / "t"))
    news = setup_news(spark, tables, ["abc", "abcd", None, "abcde"])
    stamp = F.lit("2024-01-02").cast("timestamp")
    write_batch(store.status_entries(spark.createDataFrame([("id9",)], "id string"), "new", stamp), tables.status_new, 1)
    metadata(spark, tables.topic_metadata, "zero")
    meta = spark.read.parquet(tables.topic_metadata)
    jobs.score_batch(news.where("id IN ('id0', 'id2')"), 0, tables, by_length, 0.5, meta)
    before = final(spark, tables)
    # scoring batches up to 0 and ingest batches up to 0 go into the snapshot; ingest batch 1 stays in the tail
    assert jobs.snapshot_status(spark, tables, 0) == 1
    log = StatusLog(spark, tables.status_new, tables.status_scored, tables.status_base)
    assert log.pointer() == {"gen": 1, "new_upto": 0, "scored_upto": 0}
    assert final(spark, tables) == before
    # the snapshot holds one row per id; a batch reads only its ids' buckets and the tail
    assert log._base(log.pointer()).groupBy("id").count().where("count > 1").count() == 0
    assert sorted(r["id"] for r in log.entries_for(spark.createDataFrame([("id1",), ("id9",)], "id string")).collect()) == ["id1", "id9"]
    # scoring after the snapshot claims only what is still new; a replay of it changes nothing
    for _ in range(2):
        jobs.score_batch(news, 1, tables, by_length, 0.5, meta)
    assert final(spark, tables) == {
        "id0": ("processed", None), "id1": ("processed", None), "id2": ("failed", "title is null"),
        "id3": ("processed", None), "id9": ("new", None),
    }
    assert read_table(spark, tables.clustering_reports, schemas.CLUSTERING_REPORTS).count() == 3
    # a second snapshot replaces the first; the state stays the same
    assert jobs.snapshot_status(spark, tables, 1) == 2
    assert final(spark, tables)["id3"] == ("processed", None) and log.pointer()["gen"] == 2


def test_landing_by_day_does_not_grow_with_the_input_partitions(spark, tmp_path):
    from topicflow.plans.queries import land_by_day

    rows = spark.range(0, 300, 1, 8).select(F.when(F.col("id") != 7, F.col("id") % 3).alias("day"), "id")
    assert land_by_day(rows, "day", "id", str(tmp_path / "a")) == (3, 1)
    landed = sorted((tmp_path / "a" / "landing").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    # one file a day, in the order of the days: a micro-batch each
    assert [sorted({r["id"] % 3 for r in spark.read.parquet(str(f)).collect()}) for f in landed] == [[0], [1], [2]]
    # a day of more rows than a file holds has more files, and no row is lost
    days, files = land_by_day(rows, "day", "id", str(tmp_path / "b"), file_rows=40)
    assert (days, files) == (3, 3) and len(list((tmp_path / "b" / "landing").glob("part-*.parquet"))) <= 9
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "b" / "landing")).collect()) == [i for i in range(300) if i != 7]
