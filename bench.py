"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once on the smallest tables to warm up the JVM and then timed,
writing its whole result to a no-op sink. ``docs_per_second`` is the scoring rate (nearest centre plus topic
assignment) to compare with the roughly 27 documents per second of the baseline.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from topicflow.plans.queries import QUERIES, table
from topicflow.session import build_session

HEADLINE = [
    "corpus_content",
    "clean_text",
    "strip_html",
    "lemmatize",
    "join_corpora",
    "dedupe_exact",
    "dedupe_near",
    "articles_per_year",
    "length_histogram",
    "validate_payloads",
    "ingest_dedupe",
    "ingest_outcomes",
    "status_transitions",
    "next_batch",
    "vocabulary",
    "tfidf",
    "top_words_centroid",
    "top_words_cluster",
    "coherence_cv",
    "embed_hashed",
    "nearest_centroid",
    "assign_topics",
    "silhouette",
    "silhouette_sq",
    "density_clusters",
    "density_reduced",
    "kmeans_embeddings",
    "topic_dynamics",
    "topic_spikes",
]


def micro_batch(spark, rows: int = 32) -> float:
    """Seconds to claim, score, report and mark one micro-batch of ``rows`` news."""
    from pyspark.sql import functions as F

    from topicflow import schemas
    from topicflow.operators import store
    from topicflow.session import scratch_path
    from topicflow.sources.tables import write_batch
    from topicflow.streaming import jobs

    tables, stamp = jobs.Tables(scratch_path(spark, "bench")), F.lit("2024-01-01").cast("timestamp")
    id_text = F.concat(F.lit("n"), "id")
    news = spark.range(2 * rows).select(id_text.alias("id"), id_text.alias("title"), stamp.alias("created_at"))
    write_batch(store.status_entries(news.select("id"), schemas.NEW, stamp), tables.status_new, 0)
    topics = spark.createDataFrame([(i, f"t{i}", ["w"], True, None) for i in range(3)], schemas.TOPIC_METADATA)

    def scorer(batch):
        return batch.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("cluster"), F.lit(0.7).alias("score"))

    number = F.substring("id", 2, 20).cast("int")
    jobs.score_batch(news.where(number < rows), 0, tables, scorer, 0.5, topics)  # warm-up
    start = time.time()
    jobs.score_batch(news.where(number >= rows), 1, tables, scorer, 0.5, topics)
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="topicflow-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, failed = {}, {}
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in names:
        for path in (small, sf):
            if os.path.isdir(path):
                start = time.time()
                try:
                    QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
                except Exception as error:  # recorded, and the other queries still run
                    seconds.pop(name, None)
                    failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
                    break
                seconds[name] = round(time.time() - start, 3)
    batch_seconds = micro_batch(spark)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
        "micro_batch_32_seconds": batch_seconds,
        "failed": failed,
    }
    if "assign_topics" in seconds:
        scored = table(spark, sf, "embeddings").count()
        result["docs_per_second"] = round(scored / seconds["assign_topics"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
