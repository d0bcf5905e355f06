"""Expressions over dense ``array<float>`` / ``array<double>`` embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vec: Column, norm: Column) -> Column:
    """``vec / norm``; a zero vector stays zero. Pass ``l2_norm`` as its own
    column so that it is not evaluated once per element."""
    return F.transform(as_double(vec), lambda x: F.when(norm == 0, x).otherwise(x / norm))


def mean_pooling(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; an all-zero mask gives zeros."""
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m), F.lit(1e-9))
    zeros = F.transform(F.get(hidden, 0), lambda _: F.lit(0.0))
    weighted = F.zip_with(hidden, mask, lambda h, m: F.struct(h.alias("h"), m.cast("double").alias("m")))
    total = F.aggregate(
        weighted,
        zeros,
        lambda acc, t: F.zip_with(acc, t["h"], lambda a, x: a + x.cast("double") * t["m"]),
    )
    return F.transform(total, lambda s: s / count)


def cls_pooling(hidden: Column) -> Column:
    """The first token's vector."""
    return F.get(hidden, 0)


def confidence(distance: Column) -> Column:
    return F.exp(-distance)


def clip01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))
