"""Streaming spike alerts: event-time windows with a watermark, then per-topic history in a state store.

Stage one counts events per tumbling window and topic with ``withWatermark``: Spark keeps the open
windows in its state store, adds rows that arrive late but within ``delay``, and in append mode emits
a window once, when the watermark passes its end, so every emitted count is final. Rows later than
the watermark are dropped by Spark, as in any append-mode aggregation.

Stage two reads those final counts as a stream and groups them by topic with
``applyInPandasWithState``: the state of a topic is the counts of its last ``history`` windows.
A window is a spike when its count exceeds mean + ``sigmas`` sample standard deviations of that
history (no flag without two earlier windows), the same rule as ``analytics.topic_spikes``. Windows of a
topic are final in the order of their start, so the history is the previous windows of the batch
report. A stage-one batch hands over only a few rows per topic, however hot the topic is.

A stream has no last window; ``end_marker`` rows (topic ``END``, far in the future) close all
windows when a source is finite, and are left out of the alerts. A null topic is a topic of its own;
rows without a time are dropped by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

END = "\u0000end-of-stream"
COUNTS = "start timestamp, end timestamp, topic string, n long"
ALERTS = "start timestamp, topic string, n long, mean double, sd double, is_spike boolean"


def window_counts(events: DataFrame, ts: str, topic: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Final ``start, end, topic, n`` per window of a streaming ``events`` frame (append mode)."""
    counted = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("_w"), F.col(topic).cast("string").alias("topic"))
        .agg(F.count("*").alias("n"))
    )
    return counted.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "topic", "n")


def spike_alerts(counts: DataFrame, history: int = 7, sigmas: float = 3.0) -> DataFrame:
    """``start, topic, n, mean, sd, is_spike`` for every window of a stream of final window counts."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("start", kind="stable")
        means, sds, flags = [], [], []
        for n in rows["n"].tolist():
            seen = np.array(past[-history:], dtype=np.float64)
            mean = float(seen.mean()) if len(seen) else None
            sd = float(seen.std(ddof=1)) if len(seen) > 1 else None
            means.append(mean)
            sds.append(sd)
            flags.append(bool(sd is not None and n > mean + sigmas * sd))
            past.append(int(n))
        state.update((past[-history:],))
        yield pd.DataFrame(
            {
                "start": rows["start"].to_numpy(),
                "topic": key[0],
                "n": rows["n"].astype("int64").to_numpy(),
                "mean": pd.Series(means, dtype="float64"),
                "sd": pd.Series(sds, dtype="float64"),
                "is_spike": flags,
            }
        )

    wanted = counts.where(~F.col("topic").eqNullSafe(F.lit(END)))
    return wanted.groupBy("topic").applyInPandasWithState(
        judge, ALERTS, "history array<long>", "append", GroupStateTimeout.NoTimeout
    )


def end_marker(spark: SparkSession, schema, ts: str, topic: str, at) -> DataFrame:
    """One row of ``schema`` at time ``at`` with topic ``END``, the other columns null."""
    fields = [F.lit(at).cast("timestamp").alias(f.name) if f.name == ts else (F.lit(END) if f.name == topic else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*fields)


def run_alerts(
    events: DataFrame,
    root: str,
    ts: str = "ts",
    topic: str = "event_type",
    width: str = "1 day",
    delay: str = "2 days",
    history: int = 7,
    sigmas: float = 3.0,
    interval: str | None = None,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Both stages as two queries: counts go to ``root/counts``, alerts to ``root/alerts``, with their
    checkpoints below ``root``. ``interval`` None processes what is there and stops (both queries are
    then finished on return)."""
    spark = events.sparkSession

    def start(df: DataFrame, name: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint-{name}")
        writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
        return writer.start(f"{root}/{name}")

    first = start(window_counts(events, ts, topic, width, delay), "counts")
    if interval is None:
        first.awaitTermination()
    counts = spark.readStream.schema(COUNTS).parquet(f"{root}/counts")
    second = start(spike_alerts(counts, history, sigmas), "alerts")
    if interval is None:
        second.awaitTermination()
    return first, second
