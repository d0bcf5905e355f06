"""Words that describe each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.operators.features import document_frequency, smooth_idf, term_counts
from topicflow.session import stored_table

NOISE = -1


def rank_words(scores: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` words of each cluster, by score and then word.

    The rank filter becomes a per-partition top-n before the shuffle, so one
    cluster's whole vocabulary never meets in a single task.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), F.asc("word"))
    return (
        scores.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top_n)
        .select("cluster_id", "rank", "word", "score")
    )


def top_words_centroid(tfidf: DataFrame, sizes: DataFrame, cluster: str, top_n: int = 10) -> DataFrame:
    """Top features of each cluster's mean vector.

    ``tfidf`` is ``(cluster, term, tfidf)`` in long form, ``sizes`` is
    ``(cluster, n)`` over all members, also those without any term.
    """
    scores = (
        tfidf.groupBy(cluster, "term")
        .agg(F.sum("tfidf").alias("_sum"))
        .join(sizes, cluster)
        .select(
            F.col(cluster).alias("cluster_id"),
            F.col("term").alias("word"),
            (F.col("_sum") / F.col("n")).alias("score"),
        )
    )
    return rank_words(scores, top_n)


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"))


def top_words_per_cluster(
    df: DataFrame,
    id_col: str,
    cluster: str,
    tokens: Column,
    top_n: int = 15,
    min_df: int = 3,
    max_df: float = 0.8,
) -> DataFrame:
    """Top words by mean TF-IDF, with the TF-IDF fitted inside each cluster.

    All clusters are handled by one plan: the cluster is part of every grouping
    key. Noise and clusters below two documents give no words. The vocabulary is
    written once, so that Spark broadcasts it if it is small enough.
    """
    docs = df.where(F.col(cluster).isNotNull() & (F.col(cluster) != F.lit(NOISE).cast(df.schema[cluster].dataType)))
    docs = docs.select(id_col, F.col(cluster).alias("cluster_id"), tokens.alias("_tokens")).where(
        F.col("_tokens").isNotNull()
    )
    counts = term_counts(docs, [id_col, "cluster_id"], F.col("_tokens"))
    sizes = cluster_sizes(docs, "cluster_id").where(F.col("n") >= 2)
    idf = (
        document_frequency(counts, ["cluster_id"])
        .join(sizes, "cluster_id")
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
        .select("cluster_id", "term", "n", smooth_idf(F.col("n"), F.col("df")).alias("_idf"))
    )
    weighted = counts.join(stored_table(idf, "cluster-idf"), ["cluster_id", "term"]).withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    scores = (
        weighted.withColumn("_x", F.col("_w") / norm)
        .groupBy("cluster_id", F.col("term").alias("word"))
        .agg((F.sum("_x") / F.first("n")).alias("score"))
    )
    return rank_words(scores, top_n)


def topics_as_arrays(topics: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``cluster_id, top_words``: one row per cluster, words in rank order.

    With ``clusters`` (a ``cluster_id`` column) clusters without words get ``[]``.
    """
    packed = topics.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("top_words")
    )
    if clusters is None:
        return packed
    ids = clusters.select("cluster_id").distinct()
    return ids.join(packed, "cluster_id", "left").withColumn(
        "top_words", F.coalesce("top_words", F.array().cast("array<string>"))
    )
