"""Dates, payloads, ids, vectors and replays that went wrong before."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streams import by_length, final, metadata, setup_news

from topicflow import schemas
from topicflow.operators import analytics, cluster, corpus, dedupe, density, embed, features, lemmas
from topicflow.session import drop_scratch, scratch_path
from topicflow.sources import messages as src
from topicflow.sources.tables import compact_batches, read_table, write_batch
from topicflow.streaming import jobs


@pytest.mark.parametrize(
    "text, day",
    [
        ("2018/12/14", "2018-12-14 00:00:00"),
        ("2018/12/14 10:05:06", "2018-12-14 10:05:06"),
        ("Fri, 14 Dec 2018 10:00:00 +0300", "2018-12-14 07:00:00"),
        ("Fri, 14 Dec 2018 10:00:00 GMT", "2018-12-14 10:00:00"),
        ("14.12.2018", "2018-12-14 00:00:00"),
        ("Dec 14, 2018", "2018-12-14 00:00:00"),
        ("14 December 2018", "2018-12-14 00:00:00"),
        ("20181214", "2018-12-14 00:00:00"),
        ("2018-12-14T10:00:00", "2018-12-14 10:00:00"),
        ("2018-12-14", "2018-12-14 00:00:00"),
        ("2018/13/45", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "d string").select(corpus.parse_date(F.col("d")).cast("string").alias("d")).first()[0]
    assert got == day


def test_slash_dated_corpus_is_kept(spark):
    a = spark.createDataFrame([("u", "t", "x", "y", "z", "2019/05/06")], schemas.CORPUS_A)
    b = spark.createDataFrame([("s", "t", "x", "Mon, 06 May 2019 01:02:03 +0000", "r", "s", "g")], schemas.CORPUS_B)
    rows = corpus.join_corpora(a, b).orderBy("date").collect()
    assert [r["date"] for r in rows] == [datetime(2019, 5, 6), datetime(2019, 5, 6, 1, 2, 3)]


def test_payload_keeps_every_field(spark, tmp_path):
    article = {"content": "Text", "link": "http://x", "title": None, "language": "ru", "keywords": ["a", "b"], "meta": {"n": 1}}
    landing, out = tmp_path / "api", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps({"results": [article, {"title": "no text"}]}))
    tables = jobs.Tables(str(tmp_path / "t"))
    jobs.publish_stream(
        src.api_responses(spark, str(landing)), lambda df, i: write_batch(df, out, i), str(tmp_path / "cp"), None, tables
    ).awaitTermination()
    sent = [json.loads(bytes(r["value"])) for r in spark.read.parquet(out).collect()]
    assert len(sent) == 1 and sent[0]["payload"] == article
    assert set(sent[0]) == {"external_id", "title", "source", "published_at", "text", "url", "payload"} and sent[0]["title"] is None
    log = read_table(spark, tables.publish_log, schemas.PUBLISH_LOG).collect()
    assert [(r["fetched"], r["published"]) for r in log] == [(2, 1)]


def test_repeated_embedding_id_is_refused(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [3.0])], "doc_id int, embedding array<float>")
    with pytest.raises(ValueError, match="repeated or null ids: 1"):
        embed.attach_embeddings(df, vectors, "doc_id")


def test_metadata_copy_outlives_the_file(spark, tmp_path):
    path, last = str(tmp_path / "meta"), {}
    metadata(spark, path, "zero")
    jobs._load_metadata(spark, path, last)
    for part in (tmp_path / "meta").glob("*.parquet"):
        part.write_bytes(b"damaged")
    for part in (tmp_path / "meta").glob(".*.crc"):
        part.unlink()
    kept = jobs._load_metadata(spark, path, last)
    assert sorted(r["label"] for r in kept.collect()) == ["hidden", "zero"]


def test_failed_replay_leaves_no_report(spark, tmp_path):
    tables = jobs.Tables(str(tmp_path / "t"))
    news = setup_news(spark, tables, ["abc", "abcd"])
    metadata(spark, tables.topic_metadata, "zero")
    meta = spark.read.parquet(tables.topic_metadata)
    jobs.score_batch(news, 0, tables, by_length, 0.5, meta)
    assert read_table(spark, tables.clustering_reports, schemas.CLUSTERING_REPORTS).count() == 2

    def broken(df):
        raise RuntimeError("gone")

    jobs.score_batch(news, 0, tables, broken, 0.5, meta)
    assert read_table(spark, tables.clustering_reports, schemas.CLUSTERING_REPORTS).count() == 0
    assert {v[0] for v in final(spark, tables).values()} == {"failed"}
    log = read_table(spark, tables.batch_log, schemas.BATCH_LOG)
    summary = analytics.batch_summary(log).first()
    assert (summary["batches"], summary["rows"]) == (1, 2) and summary["mean_seconds"] > 0


def test_replaced_batch_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1)], schemas.INGEST_LOG)
    write_batch(rows, path, 3)
    write_batch(rows, path, 4)
    write_batch(rows.limit(0), path, 3)
    assert [r["batch_id"] for r in read_table(spark, path, schemas.INGEST_LOG).collect()] == [4]


def test_compaction_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        write_batch(spark.createDataFrame([(f"o{i}", i)], schemas.INGEST_LOG), path, i)
    assert compact_batches(spark, path, schemas.INGEST_LOG, 4) == 4
    got = read_table(spark, path, schemas.INGEST_LOG).collect()
    assert sorted((r["outcome"], r["n"], r["batch_id"]) for r in got) == [(f"o{i}", i, max(i, 3)) for i in range(5)]
    assert compact_batches(spark, path, schemas.INGEST_LOG, 4) == 0


def test_text_ids(spark):
    texts = [("b", "one two three four five"), ("a", "one two three four five"), ("c", "something else entirely here")]
    groups = dedupe.near_duplicate_groups(
        spark.createDataFrame(texts, "id string, text string"), "id", F.split("text", " ")
    ).collect()
    assert {r["id"]: r["group"] for r in groups} == {"a": "a", "b": "a", "c": "c"}
    rows = [(f"k{i}", [float(i // 5), 0.0]) for i in range(10)] + [("far", [50.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    for block_rows in (3, 1024):
        fitted = density.density_clusters(df, "id", "vec", 0.5, 2, 2, block_rows=block_rows)
        got = {r["id"]: r["cluster"] for r in fitted.collect()}
        assert got == {**{f"k{i}": "k0" if i < 5 else "k5" for i in range(10)}, "far": "-1"}
    core = fitted.where("cluster <> '-1'").join(df, "id").select("vec", "cluster")
    near = density.density_assign(spark.createDataFrame([("q", [0.1, 0.0]), ("r", [9.0, 9.0])], df.schema), core, "id", "vec", 0.5)
    assert {r["id"]: r["cluster"] for r in near.collect()} == {"q": "k0", "r": "-1"}


@pytest.mark.parametrize("block", [100, 1])
def test_null_vectors_and_repeated_ids(spark, block):
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "cluster int, centre array<double>")
    df = spark.createDataFrame([(7, [0.9, 1.0]), (7, [0.1, 0.0]), (8, None), (9, [0.5, 0.5])], "id int, vec array<double>")
    got = cluster.nearest_centre(df, "vec", centres, "id", block=block).collect()
    assert sorted((r["id"], r["cluster"] is None, r["cluster"] or 0) for r in got) == [(7, False, 0), (7, False, 1), (8, True, 0), (9, False, 0)]
    empty = cluster.nearest_centre(df, "vec", centres.limit(0), "id").collect()
    assert [r["cluster"] for r in empty] == [None] * 4


def test_terms_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c", None])], "id int, toks array<string>")
    counts = features.term_counts(df, ["id"], F.col("toks"))
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1), (1, "b", 2), (4, "c", 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([(1, [f"t{i % 500}" for i in range(20_000)])], "id int, toks array<string>")
    assert {r["tf"] for r in features.term_counts(long, ["id"], F.col("toks")).collect()} == {40}


def test_lemmas_keep_columns_and_order(spark):
    words = spark.createDataFrame([("cats", "cat"), ("cats", "dog"), ("ran", "run")], "token string, lemma string")
    df = spark.createDataFrame([(1, "cats ran cats home", "x"), (None, "ran", "y")], "id int, text string, other string")
    got = {r["other"]: (r["id"], r["lemmatized"]) for r in lemmas.lemmatize(df, words, "id", "text").collect()}
    assert got == {"x": (1, "cat run cat home"), "y": (None, "run")}


def test_scratch_can_be_dropped(spark, tmp_path):
    path = scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert drop_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_numpy_ids_stay_ordered():
    from topicflow.operators.matrices import star_edges

    edges = star_edges(np.array(["c", "a"]), np.array(["b"]), np.array([[True], [True]]))
    assert sorted(map(tuple, edges.to_numpy())) == [("b", "a"), ("c", "a")]


@pytest.mark.parametrize("crash_after", [0, 1, 3])
def test_compaction_survives_a_crash(spark, tmp_path, monkeypatch, crash_after):
    from topicflow.sources import tables as tb

    path = str(tmp_path / "t")
    for i in range(5):
        write_batch(spark.createDataFrame([(f"o{i}", i)], schemas.INGEST_LOG), path, i)
    real, calls = tb.drop_batch, []

    def dying(spark_, path_, batch_id):
        if len(calls) == crash_after:
            raise RuntimeError("lost the driver")
        calls.append(batch_id)
        real(spark_, path_, batch_id)

    monkeypatch.setattr(tb, "drop_batch", dying)
    with pytest.raises(RuntimeError):
        compact_batches(spark, path, schemas.INGEST_LOG, 4)
    monkeypatch.setattr(tb, "drop_batch", real)
    # the marker was committed, so the next reader finishes the compaction: every row once
    got = read_table(spark, path, schemas.INGEST_LOG).collect()
    assert sorted((r["outcome"], r["n"], r["batch_id"]) for r in got) == [(f"o{i}", i, max(i, 3)) for i in range(5)]
    assert compact_batches(spark, path, schemas.INGEST_LOG, 4) == 0


def test_compaction_crash_before_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        write_batch(spark.createDataFrame([(f"o{i}", i)], schemas.INGEST_LOG), path, i)
    # staged rows without a marker: an attempt that died before its commit changes nothing
    read_table(spark, path, schemas.INGEST_LOG).drop("batch_id").write.parquet(f"{path}-staged-3")
    assert read_table(spark, path, schemas.INGEST_LOG).count() == 3
    assert compact_batches(spark, path, schemas.INGEST_LOG, 3) == 3
    got = read_table(spark, path, schemas.INGEST_LOG).collect()
    assert sorted((r["outcome"], r["batch_id"]) for r in got) == [("o0", 2), ("o1", 2), ("o2", 2)]


def test_long_rows_are_held_in_small_batches(spark):
    rows, size, cached = (
        f"spark.sql.{x}" for x in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "inMemoryColumnarStorage.batchSize")
    )
    before = {k: spark.conf.get(k) for k in (rows, size)}
    df = spark.range(0, 5000, numPartitions=1).select("id", F.array(F.col("id").cast("string")).alias("toks"))
    try:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, "64m")
        assert features.term_counts(df, ["id"], F.col("toks")).count() == 5000
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("1000", "8m")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    batches, held = spark.conf.get(cached), cluster._cached(df)
    try:
        relation = held._jdf.queryExecution().withCachedData()
        assert relation.cacheBuilder().cachedColumnBuffers().count() == 5 and spark.conf.get(cached) == batches
    finally:
        held.unpersist()
