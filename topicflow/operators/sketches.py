"""Quantiles of any span of days from stored, mergeable per-day sketches.

A value ``x > 0`` falls in bucket ``ceil(ln x / ln g)`` with ``g = (1 + alpha) / (1 - alpha)``;
zero and negative values have buckets of their own mirrored below (``-ceil(ln -x / ln g)`` marked
negative, and zero). A day's sketch is its bucket counts: rows ``day, bucket, n``, a few hundred per day
whatever the number of rows, summed per task before the shuffle. Sketches of days merge by adding
counts, so the quantiles of any span read the stored sketches only, never the rows again.

The q-quantile is the bucket where the running count first reaches ``q * n`` (rank ``ceil(q n)``,
at least 1), reported as ``2 g^i / (g + 1)``: within a relative ``alpha`` of the exact value of that
rank. Null values are not counted; a span without values has null quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01


def _gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """Sign and bucket as one number: positive buckets above, zero as 0 with sign 0, negatives below."""
    lg = math.log(_gamma(alpha))
    magnitude = F.ceil(F.log(F.abs(value)) / F.lit(lg)).cast("long")
    return F.struct(F.signum(value).cast("int").alias("sign"), F.when(value == 0, F.lit(0).cast("long")).otherwise(magnitude).alias("bucket"))


def daily_sketch(df: DataFrame, ts: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """``day, sign, bucket, n`` for the non-null values of every day."""
    keyed = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        F.to_date(ts).alias("day"), bucket_of(F.col(value), alpha).alias("_b")
    )
    return keyed.groupBy("day", "_b.sign", "_b.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, start=None, end=None) -> DataFrame:
    """``sign, bucket, n`` of the days from ``start`` to ``end`` (dates or strings, None: open)."""
    span = sketch
    if start is not None:
        span = span.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        span = span.where(F.col("day") <= F.lit(end).cast("date"))
    return span.groupBy("sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles(merged: DataFrame, qs: list[float], alpha: float = ALPHA) -> DataFrame:
    """One row with ``n`` and a column ``q<100 q>`` per quantile. The buckets of one span are few,
    so they are ordered in one window."""
    g = _gamma(alpha)
    # order: negative values by falling magnitude, zero, positive by rising magnitude
    key = F.when(F.col("sign") < 0, -F.col("bucket") - F.lit(1 << 40)).when(F.col("sign") == 0, F.lit(-(1 << 39))).otherwise(F.col("bucket"))
    ordered = merged.withColumn("_key", key)
    whole = Window.partitionBy()
    running = ordered.withColumn("_upto", F.sum("n").over(whole.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumn("_total", F.sum("n").over(whole))
    middle = F.lit(2.0) * F.pow(F.lit(g), F.col("bucket").cast("double")) / F.lit(g + 1)
    estimate = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign").cast("double") * middle)
    cols = []
    for q in qs:
        rank = F.greatest(F.ceil(F.lit(float(q)) * F.col("_total")), F.lit(1))
        cols.append(F.min(F.when(F.col("_upto") >= rank, F.struct("_key", estimate.alias("v")))).getField("v").alias(f"q{round(q * 100):02d}"))
    out = running.agg(F.max("_total").alias("n"), *cols)
    return out
