"""The continuous jobs: publish, ingest, score.

Every micro-batch writes its results under ``batch_id=<n>`` and replaces that
partition when it is replayed. Comparisons with stored rows leave the running
batch out, so a replay sees the same state as the first attempt and writes the
same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicflow import schemas
from topicflow.operators import assign, ingest, store
from topicflow.operators.idindex import IdIndex
from topicflow.operators.statuslog import StatusLog
from topicflow.session import fetch_bounded, stored_table
from topicflow.sources.tables import _batches, drop_batch, read_table, write_batch

Scorer = Callable[[DataFrame], DataFrame]
HELD_TOPICS = 100_000


@dataclass(frozen=True)
class Tables:
    """Table locations below one root folder."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"


def _start(df: DataFrame, fn, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def publish_stream(
    articles: DataFrame,
    publish: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = "30 seconds",
    tables: Tables | None = None,
) -> StreamingQuery:
    """Landed articles → messages → ``publish(messages, batch_id)``. With ``tables``
    the numbers of fetched and published articles go to ``publish_log``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        messages = ingest.encode_messages(ingest.normalize_articles(batch))
        publish(messages, batch_id)
        if tables is not None:
            counts = batch.agg(F.count("*").alias("fetched"), messages.agg(F.count("*")).scalar().alias("published"))
            write_batch(counts, tables.publish_log, batch_id)

    return _start(articles, run, checkpoint, interval)


def ingest_batch(messages: DataFrame, batch_id: int, tables: Tables) -> None:
    """One micro-batch: validate, route rejects, insert what is absent, count."""
    spark = messages.sparkSession
    # messages are small and cost much to parse: a file of millions of them may be a single partition
    dealt = messages.repartition(spark.sparkContext.defaultParallelism, "partition", "offset", "value")
    parsed = ingest.parse_messages(dealt).persist()
    try:
        index = news_index(spark, tables)
        valid, rejected = ingest.split_valid(parsed)
        # only the index folders of the batch's id buckets are opened, not the whole store
        earlier = index.lookup(valid, "external_id", exclude_batch=batch_id).persist()
        now = F.lit(datetime.now(timezone.utc))
        fresh = ingest.to_incoming_news(ingest.new_news(valid, earlier), now)
        write_batch(rejected, tables.rejected_messages, batch_id)
        write_batch(ingest.ingest_outcomes(parsed, earlier), tables.ingest_log, batch_id)
        fresh.persist()
        write_batch(store.status_entries(fresh.select("id"), schemas.NEW, now), tables.status_new, batch_id)
        write_batch(fresh, tables.incoming_news, batch_id)
        index.add(fresh, "external_id", batch_id)
        fresh.unpersist()
        earlier.unpersist()
    finally:
        parsed.unpersist()


def news_index(spark: SparkSession, tables: Tables) -> IdIndex:
    """The external-id index of ``incoming_news``, built once from the store if it has none yet."""
    index = IdIndex(spark, tables.news_id_index)
    if not index.exists():
        stored = read_table(spark, tables.incoming_news, schemas.INCOMING_NEWS)
        if not stored.isEmpty():
            index.build(stored, "external_id")
    return index


def ingest_stream(
    messages: DataFrame, tables: Tables, checkpoint: str, interval: str | None = "1 second"
) -> StreamingQuery:
    """``value, partition, offset`` messages → ``incoming_news``. Bad messages
    never stop the stream; they land in ``rejected_messages`` with a reason."""
    return _start(messages, lambda df, i: ingest_batch(df, i, tables), checkpoint, interval)


def news_source(spark: SparkSession, tables: Tables, files_per_trigger: int | None = None) -> DataFrame:
    """New ``incoming_news`` files as a stream. Files replaced by a replayed
    ingest batch come again under new names; scoring skips rows it has seen."""
    reader = spark.readStream.schema(schemas.INCOMING_NEWS).option("ignoreMissingFiles", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(tables.incoming_news)


def _load_metadata(spark: SparkSession, path: str, last_good: dict) -> DataFrame:
    """The current metadata snapshot; the previous one if it cannot be read.

    The rows themselves are kept, one per topic, so the copy outlives the file;
    more than ``HELD_TOPICS`` of them are kept in the shared folder instead.
    """
    try:
        snapshot = spark.read.schema(schemas.TOPIC_METADATA).parquet(path)
        rows = fetch_bounded(snapshot, HELD_TOPICS)
        last_good["df"] = stored_table(snapshot, "metadata") if rows is None else spark.createDataFrame(rows, schemas.TOPIC_METADATA)
    except Exception:
        if "df" not in last_good:
            raise
    return last_good["df"]


def status_log(spark: SparkSession, tables: Tables) -> StatusLog:
    return StatusLog(spark, tables.status_new, tables.status_scored, tables.status_base)


def read_status(spark: SparkSession, tables: Tables) -> DataFrame:
    """The status log: the last snapshot's entries (latest per id) and the entries of ingest
    (``new``) and of scoring after it."""
    return status_log(spark, tables).entries()


def snapshot_status(spark: SparkSession, tables: Tables, scored_upto: int) -> int:
    """Fold the status logs into a new snapshot: scoring batches up to ``scored_upto`` and every
    ingest batch but the last (which may still be replayed)."""
    born = _batches(spark, tables.status_new)
    return status_log(spark, tables).snapshot(born[-2] if len(born) > 1 else -1, scored_upto)


def score_batch(
    news: DataFrame,
    batch_id: int,
    tables: Tables,
    scorer: Scorer,
    threshold: float | None,
    metadata: DataFrame,
    text_col: str = "title",
) -> None:
    """Claim, score, report and mark one micro-batch.

    Only news whose current status is ``new`` are claimed. ``scorer`` turns
    ``(id, text)`` into ``(id, cluster, score)``. Rows without text fail on
    their own; an error of the scorer fails the whole batch with its message,
    any later error with a fixed one.
    """
    spark = news.sparkSession
    started = time.monotonic()
    now = F.lit(datetime.now(timezone.utc))
    rows = news.dropDuplicates(["id"])
    # the snapshot's folders of these ids' buckets and the log batches after it, not the whole log
    log = status_log(spark, tables).entries_for(rows, "id", exclude_scored=batch_id)
    claim = store.status_entries(rows.select("id"), schemas.PROCESSING, now, log=log).persist()
    claimed = rows.join(claim.select("id"), "id", "left_semi").persist()
    scored = None
    try:
        write_batch(claim, tables.status_scored, batch_id)
        usable = claimed.where(F.col(text_col).isNotNull())
        empty = claimed.where(F.col(text_col).isNull()).select("id")
        failure = None
        try:
            scored = scorer(usable.select("id", F.col(text_col).alias("text"))).persist()
            scored.count()
        except Exception as exc:  # the model's own message goes to the status log
            failure = str(exc)
        if failure is None:
            try:
                reports = store.clustering_reports(assign.assign_topics(scored, metadata, threshold), "id", now)
                write_batch(reports, tables.clustering_reports, batch_id)
                summary = reports.agg(
                    claimed.agg(F.count("*")).scalar().alias("size"),
                    F.count("*").alias("processed"),
                    F.count_if(F.col("cluster_id").isNull()).alias("unknown"),
                    F.lit(time.monotonic() - started).alias("seconds"),
                )
                write_batch(summary, tables.batch_log, batch_id)
            except Exception:
                failure = "unexpected error during batch processing"
        if failure is not None:
            # an earlier attempt of this batch may have got further
            drop_batch(spark, tables.clustering_reports, batch_id)
            lost = claimed.agg(
                F.count("*").alias("size"),
                F.lit(0).cast("bigint").alias("processed"),
                F.lit(0).cast("bigint").alias("unknown"),
                F.lit(time.monotonic() - started).alias("seconds"),
            )
            write_batch(lost, tables.batch_log, batch_id)
        outcome = schemas.PROCESSED if failure is None else schemas.FAILED
        entries = claim.unionByName(
            store.status_entries(empty, schemas.FAILED, now, F.lit(f"{text_col} is null"))
        ).unionByName(store.status_entries(usable.select("id"), outcome, now, F.lit(failure)))
        write_batch(entries, tables.status_scored, batch_id)
    finally:
        claimed.unpersist()
        claim.unpersist()
        if scored is not None:
            scored.unpersist()


def score_stream(
    news: DataFrame,
    tables: Tables,
    scorer: Scorer,
    checkpoint: str,
    threshold: float | None = None,
    text_col: str = "title",
    interval: str | None = "30 seconds",
    snapshot_every: int | None = 100,
) -> StreamingQuery:
    """New news → topic → ``clustering_reports`` and the status log. Metadata is
    read again for every micro-batch; every ``snapshot_every`` batches the status
    log is folded into a snapshot, so a batch's reads stay short."""
    last_good: dict = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        metadata = _load_metadata(batch.sparkSession, tables.topic_metadata, last_good)
        score_batch(batch, batch_id, tables, scorer, threshold, metadata, text_col)
        if snapshot_every and (batch_id + 1) % snapshot_every == 0:
            snapshot_status(batch.sparkSession, tables, batch_id - 1)

    return _start(news, run, checkpoint, interval)
