"""Reports over articles and assigned topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.session import cut_lineage


def articles_per_year(df: DataFrame, date: Column) -> DataFrame:
    """``year, n`` in year order; rows without a valid date do not count."""
    years = df.select(F.year(date).alias("year")).where(F.col("year").isNotNull())
    return years.groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def require_dates(per_year: DataFrame) -> DataFrame:
    if per_year.isEmpty():
        raise ValueError("no valid dates")
    return per_year


def length_frequencies(df: DataFrame, text: Column) -> DataFrame:
    """``length, freq``. There are far fewer lengths than rows, so quantiles and
    histograms work on this table."""
    return df.groupBy(tx.text_length(text).alias("length")).agg(F.count("*").alias("freq"))


def length_quantile(df: DataFrame, text: Column, q: float = 0.99) -> DataFrame:
    """Exact quantile with linear interpolation, one row."""
    return length_frequencies(df, text).agg(F.percentile("length", F.lit(q), F.col("freq")).alias("quantile"))


def length_histogram(df: DataFrame, text: Column, q: float = 0.99, bins: int = 30) -> DataFrame:
    """``bin, low, high, n`` over lengths up to ``int(quantile)``.

    Equal-width bins from the smallest to the largest kept length, the last one
    closed. Equal extremes are widened by one half on both sides. The lengths
    are counted once and kept, the rest reads that small table.
    """
    freq = cut_lineage(length_frequencies(df, text))
    clip = freq.agg(F.floor(F.percentile("length", F.lit(q), F.col("freq")))).scalar()
    kept = freq.where(F.col("length") <= clip)
    low, high = kept.agg(F.min("length")).scalar(), kept.agg(F.max("length")).scalar()
    bounds = kept.withColumn("_lo", low.cast("double")).withColumn("_hi", high.cast("double"))
    flat = F.col("_lo") == F.col("_hi")
    bounds = bounds.withColumn("low0", F.col("_lo") - F.when(flat, 0.5).otherwise(0.0))
    bounds = bounds.withColumn("high0", F.col("_hi") + F.when(flat, 0.5).otherwise(0.0))
    width = (F.col("high0") - F.col("low0")) / bins
    index = F.least(F.floor((F.col("length") - F.col("low0")) / width), F.lit(bins - 1)).cast("int")
    filled = bounds.select(index.alias("bin"), "freq", "low0", width.alias("_w")).groupBy("bin").agg(
        F.sum("freq").alias("n"), F.first("low0").alias("_l"), F.first("_w").alias("_w")
    )
    return filled.select(
        "bin",
        (F.col("_l") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_l") + (F.col("bin") + 1) * F.col("_w")).alias("high"),
        "n",
    )


def topic_distribution(df: DataFrame, topic: str) -> DataFrame:
    """``topic, n, share`` over all rows."""
    counts = df.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def topic_dynamics(df: DataFrame, ts: str, topic: str, width: str = "1 day") -> DataFrame:
    """``start, topic, n`` per tumbling window."""
    counted = df.groupBy(F.window(ts, width).alias("_w"), F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("start"), "topic", "n")


def topic_spikes(dynamics: DataFrame, history: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Flag windows whose count exceeds mean + ``sigmas`` standard deviations of
    the ``history`` windows before. Works on the counts, so a topic has only as
    many rows as there are windows."""
    w = Window.partitionBy("topic").orderBy("start").rowsBetween(-history, -1)
    base = dynamics.withColumn("mean", F.avg("n").over(w)).withColumn("sd", F.stddev_samp("n").over(w))
    spike = F.coalesce(F.col("n") > F.col("mean") + sigmas * F.col("sd"), F.lit(False))
    return base.withColumn("is_spike", spike)


def unknown_rate(reports: DataFrame) -> DataFrame:
    """``n, unknown, rate``: a report is unknown when its cluster id is null."""
    return reports.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("cluster_id").isNull()).alias("unknown"),
        F.avg(F.col("cluster_id").isNull().cast("double")).alias("rate"),
    )


def review_sample(df: DataFrame, id_col: str, cluster: str, per_cluster: int = 50, seed: int = 42) -> DataFrame:
    """``per_cluster`` rows of every cluster in hash order: repeatable, and cut
    per input partition before the shuffle."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    w = Window.partitionBy(cluster).orderBy("_order", id_col)
    ranked = df.withColumn("_order", order).withColumn("pick", F.row_number().over(w))
    return ranked.where(F.col("pick") <= per_cluster).drop("_order")


def batch_summary(batch_log: DataFrame, size: str = "size", seconds: str = "seconds") -> DataFrame:
    """Batches, rows, mean and p95 duration and rows per second, one row.

    Durations are first counted by the millisecond, so the exact quantile works
    on few distinct values however many batches there are.
    """
    freq = batch_log.groupBy(F.round(F.col(seconds), 3).alias("_s")).agg(
        F.count("*").alias("_n"), F.sum(size).alias("_size"), F.sum(seconds).alias("_total")
    )
    batches = F.sum("_n")
    return freq.agg(
        batches.alias("batches"),
        F.sum("_size").alias("rows"),
        (F.sum("_size") / batches).alias("mean_size"),
        (F.sum("_total") / batches).alias("mean_seconds"),
        F.percentile("_s", F.lit(0.95), F.col("_n")).alias("p95_seconds"),
        (F.sum("_size") / F.sum("_total")).alias("rows_per_second"),
    )
