"""Operational tables as append-only logs and snapshots.

Parquet rows are not updated in place: status changes are appended and the
current status is the latest entry, metadata upserts produce a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.functions import ids
from topicflow.schemas import FAILED, NEW, PROCESSED, PROCESSING

# later states win when two entries carry the same time
_ORDER = {NEW: 0, PROCESSING: 1, PROCESSED: 2, FAILED: 3}


def _status_rank(status: Column) -> Column:
    rank = F.lit(-1)
    for name, value in _ORDER.items():
        rank = F.when(status == name, value).otherwise(rank)
    return rank


def current_status(log: DataFrame) -> DataFrame:
    """Latest status row of every news id (one row per id and input partition
    reaches the shuffle)."""
    w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("_rank"))
    ranked = log.withColumn("_rank", _status_rank(F.col("status"))).withColumn("_rn", F.row_number().over(w))
    return ranked.where("_rn = 1").drop("_rn", "_rank")


def status_entries(
    ids_df: DataFrame, status: str, at: Column, error: Column | None = None, log: DataFrame | None = None
) -> DataFrame:
    """Status rows to append for the ids. Errors are cut to 1000 characters and
    cleared by any other status. Only news that is still new can be claimed, so
    ``processing`` entries need the ``log`` to check."""
    if status == PROCESSING:
        fresh = current_status(log).where(F.col("status") == NEW).select("id")
        ids_df = ids_df.join(fresh, "id", "left_semi")
    message = ids.truncate_error(error) if status == FAILED and error is not None else F.lit(None)
    return ids_df.select(
        "id",
        F.lit(status).alias("status"),
        message.cast("string").alias("error_message"),
        at.cast("timestamp").alias("updated_at"),
    )


def next_batch(news: DataFrame, log: DataFrame, limit: int = 32) -> DataFrame:
    """The ``limit`` oldest news that are still new (a top-k, not a full sort)."""
    fresh = current_status(log).where(F.col("status") == NEW).select("id")
    return news.join(fresh, "id", "left_semi").orderBy("created_at", "id").limit(limit)


def upsert_metadata(current: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """New snapshot of the metadata: updates replace label, words and time, and
    make the topic active again. Among several updates of one cluster the one
    with the largest ``seq`` wins."""
    new = updates.select(
        F.col("cluster_id").cast("int").alias("cluster_id"),
        "label",
        "top_words",
        F.lit(True).alias("is_active"),
        at.cast("timestamp").alias("updated_at"),
        (F.col("seq") if "seq" in updates.columns else F.lit(0)).cast("bigint").alias("_seq"),
    )
    old = current.withColumn("_seq", F.lit(None).cast("bigint"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("_seq"))
    both = old.unionByName(new).withColumn("_rn", F.row_number().over(w))
    return both.where("_rn = 1").drop("_rn", "_seq")


def clustering_reports(assigned: DataFrame, news_id: str, at: Column) -> DataFrame:
    """Report rows from ``assign_topics`` output."""
    return assigned.select(
        ids.report_id(F.col(news_id)).alias("id"),
        F.col(news_id).alias("news_id"),
        F.col("cluster_id").cast("int").alias("cluster_id"),
        "cluster_label",
        F.col("top_words").alias("top_words_snapshot"),
        F.col("score").cast("double").alias("score"),
        at.cast("timestamp").alias("created_at"),
    )


def existing_reports(reports: DataFrame, news: DataFrame) -> DataFrame:
    """Reports whose news still exists: what a cascading delete leaves."""
    return reports.join(news.select(F.col("id").alias("news_id")), "news_id", "left_semi")
