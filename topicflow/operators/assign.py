"""From scored rows to labelled topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def is_unknown(score: Column, threshold: float | None) -> Column:
    """Score strictly below the threshold; a null score or threshold is not."""
    if threshold is None:
        return F.lit(False)
    return F.coalesce(score < F.lit(threshold), F.lit(False))


def active_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.where("is_active").select(
        F.col("cluster_id").alias("_cid"),
        F.col("label").alias("_label"),
        F.coalesce("top_words", F.array().cast("array<string>")).alias("_words"),
    )


def assign_topics(scored: DataFrame, metadata: DataFrame, threshold: float | None = None) -> DataFrame:
    """The stored form: ``cluster_id, cluster_label, top_words, score``.

    Below the threshold or without active metadata the topic is unknown: null
    id, label "unknown", no words, but the score is kept. The metadata table is
    joined without a hint: Spark broadcasts it when its size allows.
    """
    joined = scored.join(active_metadata(metadata), scored["cluster"] == F.col("_cid"), "left")
    known = F.col("_cid").isNotNull() & ~is_unknown(F.col("score"), threshold)
    return joined.withColumns(
        {
            "cluster_id": F.when(known, F.col("cluster")),
            "cluster_label": F.when(known, F.col("_label")).otherwise(F.lit(UNKNOWN)),
            "top_words": F.when(known, F.col("_words")).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_cid", "_label", "_words")


def assign_topics_api(scored: DataFrame, metadata: DataFrame, strict: bool = False) -> DataFrame:
    """The response form: a missing topic gets label ``cluster_<id>`` and no words.

    With ``strict`` a scored cluster without metadata is an error.
    """
    meta = active_metadata(metadata)
    if strict:
        missing = scored.join(meta, scored["cluster"] == F.col("_cid"), "left_anti")
        if not missing.isEmpty():
            raise KeyError(f"no metadata for cluster {missing.first()['cluster']}")
    joined = scored.join(meta, scored["cluster"] == F.col("_cid"), "left")
    return joined.withColumns(
        {
            "cluster_id": F.col("cluster"),
            "topic_label": F.coalesce("_label", F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))),
            "top_words": F.coalesce("_words", F.array().cast("array<string>")),
        }
    ).drop("_cid", "_label", "_words")
