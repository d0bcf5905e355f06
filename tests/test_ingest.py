import hashlib
import json

from pyspark.sql import functions as F

from topicflow import schemas
from topicflow.operators import ingest, store

GOOD = {"text": "body", "title": "t", "source": "s"}
CASES = [
    (b"not json", "invalid_json"),
    (b"\xff\xfe{}", "invalid_json"),
    (b"", "invalid_json"),
    (b"{'text': 'single quotes'}", "invalid_json"),
    (b'{"text": "a"} trailing', "invalid_json"),
    (b'{"text": "a"}{"text": "b"}', "invalid_json"),
    (b'{"text": "a"},', "invalid_json"),
    (b"[1, 2]", "not_an_object"),
    (b'[{"text": "a"}]', "not_an_object"),
    (b"123", "not_an_object"),
    (b'"text"', "not_an_object"),
    (b"null", "not_an_object"),
    (b"{}", "missing_text"),
    (b'{"text": ""}', "missing_text"),
    (b'{"text": 5}', "missing_text"),
    (b'{"text": ["a"]}', "missing_text"),
    (b'{"text": "a", "published_at": "not a date"}', "bad_published_at"),
    (b'{"text": "a", "published_at": " "}', "bad_published_at"),
    (b'{"text": "a", "published_at": ""}', None),
    (b'{"text": "a", "published_at": 5}', None),
    (b'  {"text": "b", "payload": {"k": 1, "k": 2}}  ', None),
    (b'{"text": "first", "text": "last"}', None),
]


def frame(spark, values):
    return spark.createDataFrame([(bytearray(v), 0, i) for i, v in enumerate(values)], schemas.MESSAGES)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_reasons(spark):
    parsed = ingest.parse_messages(frame(spark, [c[0] for c in CASES])).orderBy("offset").collect()
    assert [r["reason"] for r in parsed] == [c[1] for c in CASES]
    assert parsed[-1]["raw_text"] == "last"
    assert parsed[-4]["published_at"] is None and parsed[-3]["published_at"] is None


def test_ids(spark):
    values = [
        {**GOOD, "external_id": ""},
        {**GOOD, "external_id": 123},
        {**GOOD, "external_id": 0},
        {**GOOD, "external_id": True},
        {**GOOD, "title": None, "published_at": "2024-01-02"},
        {**GOOD, "title": 7},
    ]
    rows = ingest.parse_messages(frame(spark, [json.dumps(v).encode() for v in values])).orderBy("offset").collect()
    assert [r["external_id"] for r in rows] == [
        sha("t|s||body"), "123", sha("t|s||body"), "True", sha("|s|2024-01-02|body"), sha("7|s||body"),
    ]


def test_first_wins_and_outcomes(spark):
    values = [{**GOOD, "external_id": e, "text": f"v{i}"} for i, e in enumerate(["a", "b", "a", "c", "b", "b"])]
    parsed = ingest.parse_messages(frame(spark, [json.dumps(v).encode() for v in values] + [b"[]"]))
    stored = spark.createDataFrame([("c",)], "external_id string")
    fresh = ingest.new_news(ingest.split_valid(parsed)[0], stored)
    assert {r["external_id"]: r["raw_text"] for r in fresh.collect()} == {"a": "v0", "b": "v1"}
    outcomes = {r["outcome"]: r["n"] for r in ingest.ingest_outcomes(parsed, stored).collect()}
    assert outcomes == {"stored": 2, "duplicate": 4, "not_an_object": 1}


def test_hot_id_is_reduced_before_the_shuffle(spark):
    parsed = ingest.parse_messages(frame(spark, [json.dumps(GOOD).encode()]))
    plan = ingest.first_per_id(ingest.split_valid(parsed)[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_normalize(spark):
    rows = [
        ("content", "desc", "t", "d", "sid", "s", "http://l"),
        ("", "desc", "t", "d", None, "s", None),
        ("", "", "t", "d", "sid", "s", "http://l"),
        (None, "desc", None, None, "", "s", ""),
    ]
    df = spark.createDataFrame(rows, "content string, description string, title string, pubDate string, source_id string, source string, link string")
    got = [(r["external_id"], r["source"], r["text"]) for r in ingest.normalize_articles(df).collect()]
    assert got == [("http://l", "sid", "content"), (sha("tddesc"), "s", "desc"), (sha("desc"), "s", "desc")]
    encoded = ingest.encode_messages(spark.createDataFrame([("Привет",)], "text string")).first()["value"]
    assert bytes(encoded).decode() == '{"text":"Привет"}'


def test_status_log(spark):
    log = spark.createDataFrame(
        [("a", "new", None, "2024-01-01"), ("a", "processing", None, "2024-01-02"), ("b", "new", None, "2024-01-01"),
         ("c", "new", None, "2024-01-03"), ("c", "processing", None, "2024-01-03"), ("c", "processed", None, "2024-01-03")],
        "id string, status string, error_message string, updated_at string",
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    assert {r["id"]: r["status"] for r in store.current_status(log).collect()} == {"a": "processing", "b": "new", "c": "processed"}
    at = F.lit("2024-02-01").cast("timestamp")
    ids_df = log.select("id").distinct()
    assert [r["id"] for r in store.status_entries(ids_df, "processing", at, log=log).collect()] == ["b"]
    failed = store.status_entries(ids_df, "failed", at, F.repeat(F.lit("e"), 2000)).first()
    assert len(failed["error_message"]) == 1000
    assert store.status_entries(ids_df, "processed", at, F.lit("e")).first()["error_message"] is None


def test_upsert(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    current = spark.createDataFrame([(1, "one", ["a"], False, None), (2, "two", ["b"], True, None)], schemas.TOPIC_METADATA)
    updates = spark.createDataFrame([(1, "uno", ["x"], 1), (1, "ein", ["y"], 2), (3, "three", [], 1)], "cluster_id int, label string, top_words array<string>, seq int")
    rows = {r["cluster_id"]: r for r in store.upsert_metadata(current, updates, now).collect()}
    assert {k: r["label"] for k, r in rows.items()} == {1: "ein", 2: "two", 3: "three"}
    assert rows[1]["is_active"] and rows[1]["updated_at"] is not None and rows[2]["updated_at"] is None
