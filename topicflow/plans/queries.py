"""Named queries over the shared test tables.

Every query reads whole tables. ``documents`` stands for the corpus (``source``
as title), ``embeddings`` for encoded articles, ``events`` for status changes
and topic counts over time. The SQL twins are in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.functions import ids, vectors
from topicflow.functions import sql as sqlfuncs
from topicflow.functions import text as tx
from topicflow.operators import (
    analytics,
    assign,
    cluster,
    coherence,
    corpus,
    dedupe,
    density,
    embed,
    features,
    ingest,
    lemmas,
    metrics,
    store,
    topics,
)
from topicflow.operators import lemma_rules, pivots, sketches
from topicflow.plans import train
from topicflow.session import cut_lineage, scratch_path, stored_table

# English words the cleaning queries treat as stopwords: the test corpus is not Russian
STOPWORDS = ["the", "and", "that", "with", "for", "from"]
LATIN = "a-zà-öø-ÿœ"
THRESHOLD = 0.375
EPS = 1.1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(col: str = "text", min_len: int = 2):
    return tx.word_tokens(F.col(col), min_len)


# corpus -----------------------------------------------------------------


@query
def corpus_content(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    kept = corpus.drop_short(docs)
    return kept.select("doc_id", F.length("content").alias("n"), F.sha2("content", 256).alias("digest"))


@query
def clean_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.clean_text(F.col("text"), stopwords=STOPWORDS).alias("clean"))


@query
def clean_text_keepcase(spark, sf):
    docs = table(spark, sf, "documents")
    cleaned = tx.clean_text(F.col("text"), needs_lower=False, stopwords=STOPWORDS)
    return docs.select("doc_id", cleaned.alias("clean"))


@query
def clean_text_latin(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.clean_text(F.col("text"), stopwords=STOPWORDS, alphabet=LATIN).alias("clean"))


@query
def sql_functions(spark, sf):
    sqlfuncs.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("topicflow_documents")
    return spark.sql(
        "SELECT doc_id, clean_text(text) AS clean, external_id(NULL, source, lang, NULL, text) AS external_id "
        "FROM topicflow_documents"
    )


@query
def strip_html(spark, sf):
    pages = table(spark, sf, "pages")
    plain = tx.strip(F.regexp_replace(tx.strip_html(F.col("html")), r"\s+", " "))
    return pages.select("page_id", plain.alias("plain"))


def lemma_dictionary(docs: DataFrame) -> DataFrame:
    """Plural forms of the corpus itself: a word in -s whose stem also occurs."""
    vocab = docs.select(F.explode_outer(words(min_len=4)).alias("token")).where(F.col("token").isNotNull()).distinct()
    plural = vocab.where(F.col("token").endswith("s")).withColumn("lemma", F.expr("left(token, length(token) - 1)"))
    return plural.join(vocab.withColumnRenamed("token", "lemma"), "lemma", "left_semi").select("token", "lemma")


@query
def lemmatize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return lemmas.lemmatize(docs, lemma_dictionary(docs), "doc_id", "text").select("doc_id", "lemmatized")


@query
def lemmatize_guess(spark, sf):
    """``lemmatize`` plus lemmas of words outside the dictionary by suffix rules learnt from it."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    out = lemma_rules.lemmatize_with_rules(docs, lemma_dictionary(docs), "doc_id", "text", min_support=2)
    return out.select("doc_id", "lemmatized")


@query
def join_corpora(spark, sf):
    dates = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    )
    docs = table(spark, sf, "documents").join(dates, "doc_id", "left")
    date = F.coalesce("date", F.concat(F.lit("n/a "), F.col("lang")))
    a = docs.where("lang = 'en'").select(
        F.lit("u").alias("url"), F.col("source").alias("title"), "text", F.col("lang").alias("topic"),
        F.lit("t").alias("tags"), date.alias("date"),
    )
    b = docs.where("lang <> 'en'").select(
        "source", F.col("source").alias("title"), "text", date.alias("publication_date"),
        F.lit("r").alias("rubric"), F.lit("s").alias("subrubric"), F.lit("t").alias("tags"),
    )
    joined = corpus.join_corpora(a, b, min_year=1997)
    return joined.select("title", F.sha2("text", 256).alias("digest"), "topic", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query
def dedupe_exact(spark, sf):
    docs = table(spark, sf, "documents")
    kept = corpus.drop_exact_duplicates(docs, F.lower(tx.strip(F.col("text"))), ["doc_id"])
    return kept.select("doc_id")


@query
def dedupe_near(spark, sf):
    """Groups, checked by what holds for any signatures: equal token lists are in one group."""
    docs = table(spark, sf, "documents")
    groups = dedupe.near_duplicate_groups(docs, "doc_id", words(min_len=1))
    lists = docs.select("doc_id", F.sha2(F.array_join(words(min_len=1), " "), 256).alias("digest")).join(groups, "doc_id")
    first = lists.groupBy("digest").agg(F.min("doc_id").alias("first_copy"), F.min("group").alias("first_group"))
    joined = lists.join(first, "digest")
    return joined.select(
        "doc_id",
        "first_copy",
        (F.col("group") == F.col("first_group")).alias("together"),
        (F.col("group") <= F.col("first_copy")).alias("not_above_first"),
    )


def first_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events without repeats of the same payload, type and value."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    same = F.concat_ws("|", "event_type", "props", F.col("value").cast("decimal(20,2)").cast("string"))
    return corpus.drop_exact_duplicates(events, same, ["ts", "event_id"])


@query
def temporal_split(spark, sf):
    return corpus.temporal_split(first_events(spark, sf), "ts", "2024-01-24").select("event_id", "split")


@query
def random_split(spark, sf):
    docs = corpus.drop_exact_duplicates(table(spark, sf, "documents"), F.col("text"), ["doc_id"])
    return corpus.random_split(docs, "doc_id").select("doc_id", "split")


@query
def articles_per_year(spark, sf):
    return analytics.articles_per_year(table(spark, sf, "orders"), F.col("o_orderdate"))


@query
def length_p99(spark, sf):
    return analytics.length_quantile(table(spark, sf, "documents"), F.col("text")).withColumnRenamed("quantile", "p99")


@query
def length_histogram(spark, sf):
    hist = analytics.length_histogram(table(spark, sf, "documents"), F.col("text"))
    return hist.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


# messages ---------------------------------------------------------------


@query
def external_id(spark, sf):
    docs = table(spark, sf, "documents")
    given = F.when(F.col("n_chars") < 500, F.concat(F.lit("doc-"), F.col("doc_id"))).when(F.col("lang") == "de", "")
    ext = ids.external_id(given, F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    return docs.select("doc_id", ext.alias("external_id"), ids.news_id(ext).alias("news_id"))


@query
def iso_dates(spark, sf):
    """Every accepted spelling of the events' times, and malformed ones."""
    events = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    forms = {
        "day": F.date_format(ts, "yyyy-MM-dd"),
        "basic": F.date_format(ts, "yyyyMMdd"),
        "minute": F.date_format(ts, "yyyy-MM-dd'T'HH:mm"),
        "zulu": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "offset": F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+0300'"),
        "micros": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "loose": F.date_format(ts, "yyyy-M-d"),
        "words": F.date_format(ts, "d MMMM yyyy"),
    }
    long = events.select(
        "event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("value")) for k, v in forms.items()])).alias("f")
    ).select("event_id", "f.*")
    parsed = ids.parse_iso8601(F.col("value"))
    return long.select("event_id", "form", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as API articles: some without content, link or source id."""
    pages = table(spark, sf, "pages")
    empty = F.lit(None).cast("string")
    return pages.select(
        "page_id",
        F.when(F.length("html") > 1500, F.col("html")).otherwise("").alias("content"),
        F.when(F.length("html") > 800, F.col("url")).alias("description"),
        F.substring_index("url", "/", 3).alias("title"),
        F.when(F.col("url").contains("/en/"), "2024-01-02 03:04:05").alias("pubDate"),
        F.when(F.col("url").contains("/fr/"), "").otherwise(F.substring_index("url", "/", 3)).alias("source_id"),
        F.lit("pages").alias("source"),
        F.when(F.col("url").contains("?"), empty).otherwise(F.col("url")).alias("link"),
    )


@query
def normalize_articles(spark, sf):
    out = ingest.normalize_articles(articles(spark, sf))
    return out.select(
        F.variant_get("payload", "$.page_id", "bigint").alias("page_id"),
        "external_id", "title", "source", "published_at", F.sha2("text", 256).alias("digest"), "url",
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and event payloads as stream messages of every kind."""
    docs = table(spark, sf, "documents")
    kind = F.pmod("doc_id", F.lit(10))
    full = F.struct(
        F.when(kind == 1, F.col("source")).alias("external_id"), F.col("source").alias("title"),
        F.when(kind == 2, F.lit("2024-13-45")).when(kind == 3, "").when(kind == 4, "2024-01-05T06:07:08+02:00").alias("published_at"),
        "text",
    )
    numeric = F.struct(F.col("source").alias("title"), F.col("n_chars").alias("text"))
    value = (
        F.when(kind == 5, F.col("text"))
        .when(kind == 6, F.to_json(F.array("text")))
        .when(kind == 7, F.to_json(F.struct(F.col("source").alias("title"))))
        .when(kind == 8, F.to_json(numeric))
        .when(kind == 9, F.concat(F.to_json(full), F.lit(" trailing")))
        .otherwise(F.to_json(full))
    )
    texts = docs.select(value.cast("binary").alias("value"), F.lit(0).alias("partition"), F.col("doc_id").alias("offset"))
    events = table(spark, sf, "events").select(
        F.col("props").cast("binary").alias("value"), F.lit(1).alias("partition"), F.col("event_id").alias("offset")
    )
    return texts.unionByName(events)


@query
def validate_payloads(spark, sf):
    parsed = ingest.parse_messages(messages(spark, sf))
    return parsed.select(
        "partition", "offset", "reason",
        F.when(F.col("reason").isNull(), F.col("external_id")).alias("external_id"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
    )


def stored_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source in ('src1', 'src3')").select(F.col("source").alias("external_id"))


@query
def ingest_dedupe(spark, sf):
    valid, _ = ingest.split_valid(ingest.parse_messages(messages(spark, sf)))
    return ingest.new_news(valid, stored_ids(spark, sf)).select("external_id", "partition", "offset")


@query
def ingest_outcomes(spark, sf):
    return ingest.ingest_outcomes(ingest.parse_messages(messages(spark, sf)), stored_ids(spark, sf))


@query
def rejected_messages(spark, sf):
    _, rejected = ingest.split_valid(ingest.parse_messages(messages(spark, sf)))
    return rejected.select("partition", "offset", "reason")


# store ------------------------------------------------------------------


def status_log(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    status = (
        F.when(F.col("event_type").isin("view", "signup"), "new")
        .when(F.col("event_type") == "click", "processing")
        .when(F.col("event_type") == "purchase", "processed")
        .otherwise("failed")
    )
    return events.select(
        F.concat(F.lit("news-"), F.col("user_id")).alias("id"), status.alias("status"),
        F.when(status == "failed", F.col("props")).alias("error_message"), F.col("ts").cast("timestamp").alias("updated_at"),
    )


def news_of_users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.concat(F.lit("news-"), F.col("user_id")).alias("id")).agg(
        F.min("ts").cast("timestamp").alias("created_at")
    )


def text_time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query
def status_transitions(spark, sf):
    return store.current_status(status_log(spark, sf)).select("id", "status", "error_message", text_time("updated_at"))


@query
def next_batch(spark, sf):
    return store.next_batch(news_of_users(spark, sf), status_log(spark, sf)).select("id", text_time("created_at"))


@query
def claim_new(spark, sf):
    log = status_log(spark, sf)
    at = F.lit("2024-02-01").cast("timestamp")
    return store.status_entries(news_of_users(spark, sf), "processing", at, log=log).select("id", "status")


@query
def mark_failed(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    at = F.lit("2024-02-01").cast("timestamp")
    failed = store.status_entries(docs, "failed", at, F.col("text"))
    return failed.select("id", "status", F.sha2("error_message", 256).alias("digest"))


@query
def upsert_metadata(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    current = nation.select(
        F.col("n_nationkey").cast("int").alias("cluster_id"), F.col("n_name").alias("label"),
        F.array("n_name").alias("top_words"), (F.col("n_regionkey") > 1).alias("is_active"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )
    # several updates per cluster: customers rename the topic of their nation, the last key wins
    updates = table(spark, sf, "customer").select(
        (F.col("c_nationkey") + F.lit(10)).alias("cluster_id"), F.concat(F.lit("customer "), F.col("c_custkey")).alias("label"),
        F.array(F.col("c_mktsegment")).alias("top_words"), F.col("c_custkey").alias("seq"),
    )
    out = store.upsert_metadata(current, updates, F.lit("2024-02-01").cast("timestamp"))
    return out.select("cluster_id", "label", F.array_join("top_words", ",").alias("words"), "is_active", text_time("updated_at"))


@query
def reports_referential(spark, sf):
    reports = table(spark, sf, "documents").select(F.col("doc_id").alias("news_id"), "source")
    news = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return store.existing_reports(reports, news).select("news_id", "source")


# features and topics ----------------------------------------------------


@query
def ngram_counts(spark, sf):
    docs = table(spark, sf, "documents")
    grams = tx.ngram_range(words(), 1, 2)
    counts = features.term_counts(docs, ["doc_id"], grams)
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def doc_freq(spark, sf):
    docs = table(spark, sf, "documents")
    counts = features.term_counts(docs, ["doc_id", "lang"], words(min_len=1))
    return features.document_frequency(counts, ["lang"])


def vocabulary_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    return features.vocabulary(counts, features.count_documents(docs), min_df=10, max_df=0.5, max_features=2000)


@query
def vocabulary(spark, sf):
    docs = table(spark, sf, "documents")
    counts = features.term_counts(docs, ["doc_id"], tx.ngram_range(words(), 1, 2))
    return vocabulary_of(docs, counts)


@query
def vocabulary_sketched(spark, sf):
    """``vocabulary`` with surely rare terms dropped by a count-min sketch before the exact count."""
    docs = table(spark, sf, "documents")
    counts = features.term_counts(docs, ["doc_id"], tx.ngram_range(words(), 1, 2))
    return vocabulary_of(docs, features.surely_rare_filtered(counts, 10))


def weights_of(docs: DataFrame) -> DataFrame:
    counts = features.term_counts(docs, ["doc_id", "lang"], words())
    return features.tfidf_long(counts, vocabulary_of(docs, counts), features.count_documents(docs), "doc_id")


@query
def tfidf(spark, sf):
    weights = weights_of(table(spark, sf, "documents"))
    return weights.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query
def tfidf_test_rows(spark, sf):
    """Vocabulary and frequencies of the training rows, weights of the test rows."""
    split = corpus.random_split(table(spark, sf, "documents"), "doc_id")
    found = train.test_weights(
        split.where("split = 'train'"), split.where("split = 'test'"), "doc_id", words(), min_df=10, max_df=0.5, max_features=2000
    )
    return found.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query
def top_words_centroid(spark, sf):
    docs = table(spark, sf, "documents")
    top = topics.top_words_centroid(weights_of(docs), topics.cluster_sizes(docs, "lang"), "lang", 10)
    return top.select("cluster_id", "rank", "word", F.round("score", 6).alias("score"))


def topics_by(docs: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    return topics.top_words_per_cluster(docs, "doc_id", column, words(min_len=1), top_n)


@query
def top_words_cluster(spark, sf):
    top = topics_by(table(spark, sf, "documents"), "lang")
    return top.select("cluster_id", "rank", "word", F.round("score", 6).alias("score"))


@query
def top_words_by_source(spark, sf):
    top = topics_by(table(spark, sf, "documents"), "source", 5)
    return top.select("cluster_id", "rank", "word", F.round("score", 6).alias("score"))


@query
def topic_diversity(spark, sf):
    found = topics_by(table(spark, sf, "documents"), "source", 10)
    return metrics.topic_diversity(found, 10, 0.0).select(F.round("diversity", 6).alias("diversity"))


@query
def coherence_cv(spark, sf):
    docs = table(spark, sf, "documents")
    found = cut_lineage(topics_by(docs, "lang"))
    tokens = tx.space_tokens(F.lower("text"))
    by_topic = coherence.coherence_by_topic(docs, "doc_id", tokens, found)
    return by_topic.select("cluster_id", F.round("coherence", 6).alias("coherence"))


@query
def embed_hashed(spark, sf):
    docs = table(spark, sf, "documents")
    rows = embed.embed(docs, "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.where("x <> 0").select("doc_id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


# vectors ----------------------------------------------------------------


@query
def l2_normalize(spark, sf):
    rows = table(spark, sf, "embeddings")
    normed = rows.withColumn("norm", vectors.l2_norm(F.col("embedding")))
    normed = normed.select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"), F.col("norm"))).alias("pos", "x"))
    return normed.select("vec_id", "pos", F.round("x", 6).alias("x"))


def hidden_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each 64-vector read as 8 tokens of width 8; the label decides the mask."""
    rows = table(spark, sf, "embeddings")
    hidden = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < F.col("label"), 1).otherwise(0))
    return rows.select("vec_id", hidden.alias("hidden"), mask.alias("mask"))


@query
def mean_pooling(spark, sf):
    pooled = hidden_states(spark, sf).select(
        "vec_id", F.posexplode(vectors.mean_pooling(F.col("hidden"), F.col("mask"))).alias("pos", "x")
    )
    return pooled.select("vec_id", "pos", F.round("x", 6).alias("x"))


@query
def cls_pooling(spark, sf):
    pooled = hidden_states(spark, sf).select("vec_id", F.posexplode(vectors.cls_pooling(F.col("hidden"))).alias("pos", "x"))
    return pooled.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def scored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    centres = cluster.mean_vectors(rows, "label", "embedding").select("cluster", "centre")
    return cluster.score_rows(rows, "embedding", centres, "vec_id").drop("embedding")


@query
def nearest_centroid(spark, sf):
    return scored_vectors(spark, sf).select("vec_id", "cluster", F.round("score", 6).alias("score"))


def topic_table(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata for the labels up to 8, the last of them inactive."""
    labels = table(spark, sf, "embeddings").where("label <= 8").groupBy(F.col("label").alias("cluster_id")).agg(
        F.count("*").alias("size")
    )
    return labels.select(
        "cluster_id", F.concat(F.lit("topic "), F.col("cluster_id")).alias("label"),
        F.array(F.concat(F.lit("w"), F.col("cluster_id")), F.concat(F.lit("n"), F.col("size"))).alias("top_words"),
        (F.col("cluster_id") < 8).alias("is_active"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return assign.assign_topics(scored_vectors(spark, sf), topic_table(spark, sf), THRESHOLD)


@query
def assign_topics(spark, sf):
    return reports(spark, sf).select(
        "vec_id", "cluster_id", "cluster_label", F.array_join("top_words", ",").alias("words"), F.round("score", 6).alias("score")
    )


@query
def assign_topics_api(spark, sf):
    out = assign.assign_topics_api(scored_vectors(spark, sf), topic_table(spark, sf))
    return out.select(
        "vec_id", "cluster_id", "topic_label", F.array_join("top_words", ",").alias("words"), F.round("score", 6).alias("score")
    )


@query
def unknown_rate(spark, sf):
    return analytics.unknown_rate(reports(spark, sf)).withColumn("rate", F.round("rate", 6))


def noisy_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.withColumn("cluster", F.when(F.col("label") == 9, -1).when(F.col("label") < 8, F.col("label")))


@query
def cluster_summary(spark, sf):
    out = metrics.cluster_summary(noisy_labels(spark, sf), "cluster")
    return out.withColumn("noise_fraction", F.round("noise_fraction", 6)).withColumn("coverage", F.round("coverage", 6))


@query
def cluster_agreement(spark, sf):
    ari = metrics.adjusted_rand_index(scored_vectors(spark, sf), "label", "cluster")
    return ari.select(F.round("adjusted_rand_index", 6).alias("adjusted_rand_index"))


@query
def review_sample(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return analytics.review_sample(rows, "vec_id", "cluster", 20).select("cluster", "pick", "vec_id")


@query
def silhouette(spark, sf):
    """Label 9 stands for noise, which the measure leaves out."""
    rows = table(spark, sf, "embeddings").withColumn("cluster", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    samples = metrics.silhouette_samples(rows, "vec_id", "embedding", "cluster")
    return metrics.mean_silhouette(samples).select(F.round("silhouette", 6).alias("silhouette"))


@query
def silhouette_samples(spark, sf):
    samples = metrics.silhouette_samples(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return samples.select(F.col("id").alias("vec_id"), "cluster", F.round("silhouette", 6).alias("silhouette"))


@query
def silhouette_sq(spark, sf):
    samples = metrics.silhouette_sq_samples(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return samples.select(F.col("id").alias("vec_id"), "cluster", F.round("silhouette", 6).alias("silhouette"))


@query
def silhouette_by_bucket(spark, sf):
    rows = table(spark, sf, "embeddings")
    lengths = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.size(tx.space_tokens(F.col("text"))).alias("n"))
    bucket = F.when(F.col("n") < 120, "short").when(F.col("n") > 400, "long").otherwise("medium")
    samples = metrics.silhouette_samples(rows, "vec_id", "embedding", "label")
    out = metrics.silhouette_by_bucket(samples, lengths.withColumn("bucket", bucket), "vec_id")
    return out.select("bucket", "n", F.round("silhouette", 6).alias("silhouette"))


@query
def density_clusters(spark, sf):
    rows = table(spark, sf, "embeddings")
    return density.density_clusters(rows, "vec_id", "embedding", EPS, min_samples=4, min_cluster_size=3)


@query
def density_pivots(spark, sf):
    """``density_clusters`` with pivot balls and halos instead of a grid: the same rows."""
    rows = table(spark, sf, "embeddings")
    return pivots.density_clusters(rows, "vec_id", "embedding", EPS, min_samples=4, min_cluster_size=3, pivots=64)


@query
def density_assign(spark, sf):
    rows = table(spark, sf, "embeddings")
    fitted = density.density_clusters(rows, "vec_id", "embedding", EPS, min_samples=4, min_cluster_size=3)
    core = fitted.where("cluster <> -1").join(rows, "vec_id").select(F.col("embedding").alias("vec"), "cluster")
    out = density.density_assign(rows, cut_lineage(core), "vec_id", "embedding", EPS)
    return out.withColumn("strength", F.round("strength", 5))


@query
def density_reduced(spark, sf):
    """Density clusters over PCA axes: with all axes kept they are those of the vectors."""
    rows = table(spark, sf, "embeddings")
    _, found = density.DensityClusterer.fit(rows, "vec_id", "embedding", EPS, 4, 3, pca_size=64)
    return found.select("vec_id", "cluster", "is_core")


@query
def pca_reduce(spark, sf):
    """With all axes kept, distances stay as they were: of every row to the row of the next id."""
    rows = table(spark, sf, "embeddings")
    reduced = cluster.reduce_vectors(rows, cluster.fit_reducer(rows, "embedding", 64), "embedding").select("vec_id", "reduced")
    after = reduced.select((F.col("vec_id") - 1).alias("vec_id"), F.col("reduced").alias("other"))
    apart = F.zip_with("reduced", "other", lambda a, b: (a - b) * (a - b))
    total = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x))
    return reduced.join(after, "vec_id").select("vec_id", F.round(total, 5).alias("distance"))


@query
def pca_norms(spark, sf):
    """With all components kept, a row's length is its distance from the mean."""
    rows = table(spark, sf, "embeddings")
    reduced = cluster.reduce_vectors(rows, cluster.fit_reducer(rows, "embedding", 64), "embedding")
    return reduced.select("vec_id", F.round(vectors.l2_norm(F.col("reduced")), 6).alias("norm"))


@query
def kmeans_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings")
    fitted = cluster.EmbeddingClusterer.fit(rows, "embedding", k=6, pca_size=50, n_init=2, max_iter=100)
    found = fitted.predict(rows, "vec_id")
    # what holds for any fit: the score belongs to the nearest centre, and six centres cost less than one
    own = cluster.reduce_vectors(found, fitted.reducer, "embedding")
    centres = [[float(x) for x in c] for c in fitted.kmeans.clusterCenters()]
    squares = [F.aggregate(F.zip_with("reduced", F.lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x) for c in centres]
    nearest = F.sqrt(F.array_min(F.array(*squares)))
    norm2 = F.aggregate("reduced", F.lit(0.0), lambda t, x: t + x * x)
    checked = own.select("vec_id", "cluster", "score", nearest.alias("d"), norm2.alias("n2"))
    cost = checked.agg((F.sum(F.col("d") * F.col("d")) < F.sum("n2")).alias("ok")).scalar()
    return checked.select(
        "vec_id", F.col("cluster").between(0, 5).alias("in_range"),
        (F.abs(F.col("score") - F.exp(-F.col("d"))) < 1e-9).alias("nearest"), cost.alias("cheaper"),
    )


@query
def kmeans_tfidf(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.ngram_range(words(), 1, 2).alias("grams"))
    # the vectors are smaller than the n-grams and are read by the fits and the prediction: made once
    vectors_of = stored_table(features.fit_tfidf(docs, "doc_id", "grams").transform(docs).select("doc_id", "features"), "vectors")
    model = cluster.fit_kmeans(vectors_of, "features", 8)
    out = model.transform(vectors_of).select("doc_id", "cluster", F.xxhash64(F.col("features").cast("string")).alias("h"))
    out = stored_table(out, "clustered")
    # equal vectors are in one cluster, every cluster is one of eight
    same = out.groupBy("h").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b"))
    joined = out.join(same, "h")
    return joined.select("doc_id", F.col("cluster").between(0, 7).alias("in_range"), (F.col("a") == F.col("b")).alias("equal_together"))


@query
def run_summary(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "title")
    run = train.run_tfidf(
        docs, "doc_id", k=4, n_init=1, max_features=500, clean_options={"stopwords": STOPWORDS, "alphabet": LATIN}
    )
    rows = metrics.run_metrics("tfidf", run["metrics"])
    # measures that depend on the fit are checked for their range
    ranged = F.when(F.col("metric") == "silhouette_score", F.col("value").between(-1, 1)).when(
        F.col("metric").isin("coherence", "topic_diversity"), F.col("value").between(-1, 1)
    )
    return rows.select("run_id", "metric", F.when(ranged.isNull(), F.col("value")).alias("value"), F.coalesce("text", F.when(ranged, "in range")).alias("text"))


# time -------------------------------------------------------------------


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def topic_distribution(spark, sf):
    return analytics.topic_distribution(timed(spark, sf), "event_type").withColumn("share", F.round("share", 6))


def day(name: str = "start"):
    return F.date_format(name, "yyyy-MM-dd").alias("day")


@query
def topic_dynamics(spark, sf):
    return analytics.topic_dynamics(timed(spark, sf), "ts", "event_type").select(day(), "topic", "n")


@query
def topic_spikes(spark, sf):
    spikes = analytics.topic_spikes(analytics.topic_dynamics(timed(spark, sf), "ts", "event_type"), sigmas=1.5)
    return spikes.select(
        day(), "topic", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "is_spike"
    )


def land_by_day(rows: DataFrame, day_col: str, id_col: str, root: str, file_rows: int = 1_000_000) -> tuple[int, int]:
    """Rows with a ``day_col`` as files in ``root/landing``, one day after the other; the number of days and the most
    files of a day.

    The rows are dealt by day in one pass, then each day's are copied in order, so the rows are read twice however
    many days there are. A day has one file for every ``file_rows`` rows of the largest day, at most, so a stream that reads
    that many files at a trigger has no more triggers than there are days.
    """
    spark, rows = rows.sparkSession, rows.where(F.col(day_col).isNotNull())
    counted = {r[0]: r[1] for r in rows.groupBy(day_col).count().collect()}  # one row a day
    files = max(1, -(-max(counted.values(), default=0) // file_rows))
    salt = F.pmod(F.xxhash64(F.lit(2), id_col), F.lit(files))
    rows.repartition(F.col(day_col), salt).write.partitionBy(day_col).parquet(f"{root}/arrivals")
    schema = rows.drop(day_col).schema
    for d in sorted(counted):
        own = spark.read.schema(schema).parquet(f"{root}/arrivals/{day_col}={d}")
        own.coalesce(files).write.mode("append").parquet(f"{root}/landing")
    return len(counted), files


@query
def stream_spikes(spark, sf):
    """``topic_spikes`` from a stream: events land day by day in the order they arrive, a tenth of them
    up to 36 hours late; watermarked window counts and per-topic history in a state store flag them."""
    from topicflow.streaming import spikes

    root = scratch_path(spark, "spikes")
    events = timed(spark, sf)
    late = F.when(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0, F.pmod(F.xxhash64(F.lit(1), "event_id"), F.lit(36 * 3600)))
    arrival = F.floor((F.unix_seconds("ts") + F.coalesce(late, F.lit(0))) / 86400)
    landed = events.withColumn("_arrival", arrival)
    _, files = land_by_day(landed, "_arrival", "event_id", root)
    last = events.agg(F.max("ts")).first()[0]
    if last is not None:
        # files after the last day close every window: a trigger that reads the first marker is followed by another
        for extra in [30] + [31] * files:
            spikes.end_marker(spark, events.schema, "ts", "event_type", F.lit(last) + F.expr(f"INTERVAL {extra} DAYS")).write.mode(
                "append"
            ).parquet(f"{root}/landing")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/landing")
    spikes.run_alerts(source, root, "ts", "event_type", "1 day", "2 days", history=7, sigmas=1.5)
    alerts = spark.read.schema(spikes.ALERTS).parquet(f"{root}/alerts")
    return alerts.select(day(), "topic", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "is_spike")


@query
def value_quantiles(spark, sf):
    """p50, p95, p99 of event values over the whole table and its first week, from daily sketches
    written once; a span reads sketches, not events."""
    sketch = stored_table(sketches.daily_sketch(timed(spark, sf), "ts", "value", 0.01), "value-sketch")
    spans = [("all", None, None), ("first_week", "2024-01-01", "2024-01-07")]
    parts = [
        sketches.quantiles(sketches.merge(sketch, a, b), [0.5, 0.95, 0.99], 0.01).select(F.lit(name).alias("span"), "*")
        for name, a, b in spans
    ]
    out = parts[0].unionByName(parts[1])
    return out.select("span", "n", *[F.round(c, 6).alias(c) for c in ("q50", "q95", "q99")])


@query
def batch_summary(spark, sf):
    """User sessions per day as batches: events are its rows, value its seconds."""
    batches = timed(spark, sf).groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count("*").alias("size"), F.sum("value").alias("seconds")
    )
    out = analytics.batch_summary(batches)
    rounded = ("mean_size", "mean_seconds", "p95_seconds", "rows_per_second")
    return out.select("batches", "rows", *[F.round(c, 4).alias(c) for c in rounded])


# streams ----------------------------------------------------------------


def _landed(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


@query
def stream_ingest(spark, sf):
    from topicflow.sources.messages import file_source
    from topicflow.streaming import jobs

    root = scratch_path(spark, "ingest")
    landing = _landed(messages(spark, sf), f"{root}/landing")
    tables = jobs.Tables(f"{root}/tables")
    jobs.ingest_stream(file_source(spark, landing), tables, f"{root}/checkpoint", None).awaitTermination()
    news = spark.read.parquet(tables.incoming_news)
    return news.select("external_id", F.sha2("raw_text", 256).alias("digest"))


@query
def stream_publish(spark, sf):
    from topicflow.sources.messages import api_responses
    from topicflow.sources.tables import write_batch
    from topicflow.streaming import jobs

    root = scratch_path(spark, "publish")
    # fields that messages don't use, one of them nested, must come through as well
    extra = F.struct(F.lit("fr").alias("lang"), F.array("source", "title").alias("tags")).alias("extra")
    bodies = articles(spark, sf).select(F.array(F.struct("*", extra)).alias("results"))
    # one JSON document per line, as a fetcher lands them
    bodies.write.json(f"{root}/landing")
    landed = api_responses(spark, f"{root}/landing", multi_line=False)
    out = f"{root}/messages"
    jobs.publish_stream(landed, lambda df, i: write_batch(df, out, i), f"{root}/checkpoint", None).awaitTermination()
    value = F.parse_json(F.col("value").cast("string"))
    at = lambda path, name, kind="string": F.variant_get(value, path, kind).alias(name)
    top = ("external_id", "title", "source", "published_at", "url")
    keys = F.array_join(F.array_sort(F.json_object_keys(F.col("value").cast("string"))), ",")
    return spark.read.parquet(out).select(
        *[at(f"$.{name}", name) for name in top],
        F.sha2(F.variant_get(value, "$.text", "string"), 256).alias("digest"),
        keys.alias("keys"),
        at("$.payload.page_id", "page_id", "bigint"),
        at("$.payload.description", "description"),
        at("$.payload.extra.lang", "lang"),
        at("$.payload.extra.tags[1]", "tag"),
    )


@query
def stream_scoring(spark, sf):
    from topicflow.streaming import jobs

    root = scratch_path(spark, "scoring")
    tables = jobs.Tables(f"{root}/tables")
    rows = table(spark, sf, "embeddings")
    vec = rows.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    centres = cluster.mean_vectors(rows, "label", "embedding").select("cluster", "centre")
    topic_table(spark, sf).write.parquet(tables.topic_metadata)
    stamp = F.lit("2024-01-01").cast("timestamp")
    empty = F.lit(None).cast("string")
    id_text = F.col("vec_id").cast("string")
    news = rows.select(
        id_text.alias("id"), id_text.alias("external_id"), F.when(F.col("label") != 5, id_text).alias("title"),
        empty.alias("source"), stamp.alias("published_at"), id_text.alias("raw_text"), empty.alias("url"),
        empty.alias("payload_json"), stamp.alias("created_at"),
    )
    from topicflow.sources.tables import write_batch

    write_batch(news, tables.incoming_news, 0)
    write_batch(store.status_entries(news.select("id"), "new", stamp), tables.status_new, 0)

    def scorer(batch: DataFrame) -> DataFrame:
        return cluster.score_rows(batch.join(vec, "id"), "embedding", centres, "id").select("id", "cluster", "score")

    source = jobs.news_source(spark, tables)
    jobs.score_stream(source, tables, scorer, f"{root}/checkpoint", THRESHOLD, interval=None).awaitTermination()
    found = spark.read.parquet(tables.clustering_reports).select("news_id", "cluster_id", "cluster_label")
    status = store.current_status(jobs.read_status(spark, tables)).select(F.col("id").alias("news_id"), "status")
    return status.join(found, "news_id", "left")
