import pytest
from pyspark.sql import functions as F

from topicflow import schemas
from topicflow.operators import corpus, embed, lemmas
from topicflow.sources import corpus as src


def corpora(spark):
    a = spark.createDataFrame(
        [
            ("u", "old", "t", "x", "g", "2014-12-31"),
            ("u", "kept", 'line one\nline "two"', "x", "g", "2015-01-01"),
            ("u", "bad", "t", "x", "g", "yesterday"),
            ("u", None, "no title", "y", "g", "2016-05-05"),
        ],
        schemas.CORPUS_A,
    )
    b = spark.createDataFrame(
        [("s", "undated", "t", "?", "r", "q", "g"), ("s", "ancient", "t", "2010-01-01", "r", "q", "g")], schemas.CORPUS_B
    )
    return a, b


def test_join_corpora(spark, tmp_path):
    a, b = corpora(spark)
    src.write_csv(a, str(tmp_path / "a"))
    again = src.read_csv(spark, str(tmp_path / "a"), schemas.CORPUS_A)
    assert sorted(map(str, again.collect())) == sorted(map(str, a.collect()))
    joined = corpus.join_corpora(again, b)
    assert joined.columns == ["title", "text", "topic", "date"]
    rows = {r["title"]: r for r in joined.collect()}
    assert set(rows) == {"kept", None, "undated", "ancient"}
    assert rows["undated"]["topic"] is None and rows["undated"]["date"] is None
    assert rows["kept"]["text"] == 'line one\nline "two"'


def test_content_and_filters(spark):
    df = spark.createDataFrame(
        [(1, None, "x" * 20), (2, None, "x" * 21), (3, "a title", None), (4, " ", " " * 30), (5, "t", "abcdefghij 2020 12345")],
        "doc_id int, title string, text string",
    )
    assert [r["doc_id"] for r in corpus.drop_short(df).orderBy("doc_id").collect()] == [2, 5]
    no_title = corpus.with_content(df.drop("title"))
    assert no_title.where("doc_id = 4").first()["content"] == " " * 30
    cleaned = corpus.with_clean_text(corpus.drop_short(df.withColumn("text", F.lit("12345 67890 12345 67890 12"))))
    assert [r["clean_text"] for r in cleaned.collect()] == ["title"]


def test_prepare_frame(spark):
    rows = [(1, "a" * 30, "lemma"), (2, "b" * 30, ""), (3, "c" * 30, None), (4, "short", "lemma")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lemmatized string")
    assert [r["doc_id"] for r in corpus.prepare_frame(df).collect()] == [1]
    with pytest.raises(ValueError, match="lemmatized"):
        corpus.prepare_frame(df.drop("lemmatized"))


def test_lemmatize(spark):
    words = spark.createDataFrame([("столы", "стол"), ("шли", "идти")], "token string, lemma string")
    df = spark.createDataFrame([(1, "шли столы шли дом"), (2, None), (3, "  ")], "doc_id int, text string")
    out = lemmas.lemmatize(df, words, "doc_id", "text")
    assert {r["doc_id"]: r["lemmatized"] for r in out.collect()} == {1: "идти стол идти дом", 2: "", 3: ""}
    job = lemmas.lemmatize_corpus(df, words, "doc_id")
    assert job.where("doc_id = 1").first()["lemmatized"] == "идти стол идти дом"


def test_splits(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = corpus.random_split(df, "doc_id")
    b = corpus.random_split(df.repartition(7), "doc_id")
    assert a.join(b, ["doc_id", "split"]).count() == 4000
    assert 650 < a.where("split = 'test'").count() < 950


def test_embeddings_must_match(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    vectors = embed.embed(df, "doc_id", "text")
    assert embed.attach_embeddings(df, vectors, "doc_id").count() == 2
    with pytest.raises(ValueError, match="without embedding: 1"):
        embed.attach_embeddings(df, vectors.where("doc_id = 1"), "doc_id")


def test_custom_encoder(spark):
    def factory():
        import numpy as np

        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id int, text string")
    out = {r["doc_id"]: r["embedding"] for r in embed.embed(df, "doc_id", "text", factory).collect()}
    assert out == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_text_is_cleaned_once(spark):
    df = spark.createDataFrame([(1, "Some words here"), (2, "12 34")], "id int, content string")
    cleaned = corpus.with_clean_text(df, alphabet="a-z")
    assert [tuple(r) for r in cleaned.collect()] == [(1, "Some words here", "some words here")]
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
