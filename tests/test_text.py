import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicflow.functions import stopwords
from topicflow.functions import text as tx


def clean(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", tx.clean_text(F.col("t"), **options).alias("c")).orderBy("i").collect()
    return [r["c"] for r in rows]


def test_cleaning_samples(spark):
    values = ["Привет-мир http://x.y/ЯЯ 2020", "Это новый Закон", "naïve cafe", "да нет", None, "ёлка\t\n ёлка"]
    assert clean(spark, values) == ["привет мир", "закон", "cafe", "", "", "ёлка ёлка"]
    assert clean(spark, ["Это новый Закон"], needs_lower=False) == ["Это Закон"]


def test_stopword_lists():
    assert len(stopwords.DEFAULT) == 172
    assert sum(len(w) >= 3 for w in stopwords.DEFAULT) == 137


def expected(text):
    """The definition in plain steps: blank URLs and other characters, then filter tokens."""
    text = re.sub(r"(http|www)\S+", " ", text.lower())
    letters = "".join(ch if re.match(r"[a-zа-яё\s]", ch, re.IGNORECASE) else " " for ch in text)
    return " ".join(t for t in letters.split() if len(t) >= 3 and t not in stopwords.DEFAULT)


ALPHABET = st.sampled_from(list("abzABZяЯёЁжи ,.!-0\t\n  \u0085\u001cſKéʼ") + ["http://a", "www.", "это", "закон", "не"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=60))
def test_cleaning_property(spark, values):
    assert clean(spark, values) == [expected(v) for v in values]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Ёж naïve a_b x 12",)], "t string")
    row = df.select(
        tx.word_tokens(F.col("t"), 2).alias("two"),
        tx.word_tokens(F.col("t"), 1).alias("one"),
        tx.ngram_range(tx.word_tokens(F.col("t"), 2), 1, 2).alias("grams"),
        tx.ngram_range(F.array(F.lit("solo")), 1, 2).alias("solo"),
        tx.ngrams(F.split(F.lit("a b c d"), " "), 3).alias("three"),
        tx.space_tokens(F.lit("  a b\n")).alias("space"),
        tx.text_length(F.lit("  ab \n")).alias("n"),
        tx.strip_html(F.lit("<p\nclass='x'>a</p>b")).alias("html"),
    ).first()
    assert row["two"] == ["ёж", "naïve", "a_b", "12"]
    assert row["one"] == ["ёж", "naïve", "a_b", "x", "12"]
    assert row["grams"] == ["ёж", "naïve", "a_b", "12", "ёж naïve", "naïve a_b", "a_b 12"]
    assert row["solo"] == ["solo"]
    assert row["three"] == ["a b c", "b c d"]
    assert row["space"] == ["a", "b"]
    assert row["n"] == 2
    assert row["html"] == " a b"


def test_ngram_range_finds_the_tokens_once(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    grams = df.select(tx.ngram_range(tx.word_tokens(F.col("t"), 1), 1, 2).alias("g"))
    assert [r["g"] for r in grams.collect()] == [["a", "b", "c", "a b", "b c"], [], []]
    assert grams._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_term_counts_of_null_terms_and_rows(spark):
    from topicflow.operators import features

    rows = [(1, "x", ["b", "a", None, "b"]), (2, None, []), (3, "y", None), (None, "z", ["c"]), (1, "x", ["b"])]
    df = spark.createDataFrame(rows, "id bigint, k string, w array<string>").coalesce(1)
    got = features.term_counts(df, ["id", "k"], F.col("w")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x", "a", 1), (1, "x", "b", 2), (None, "z", "c", 1), (1, "x", "b", 1)], key=str)
