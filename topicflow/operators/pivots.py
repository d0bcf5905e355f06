"""Density clustering pruned by pivot balls with triangle-inequality halos.

The grid of ``density`` cuts a few leading coordinates into cells of width ``eps``; on embeddings
those coordinates barely separate the points, so nearly every pair is compared. Here ``pivots``
points (those of smallest id hash, a bounded table) are the centres of balls. Every point belongs to
the ball of its nearest pivot (its home) and is also a halo member of each other ball ``c`` with
``d(q, c) <= d(q, home) + 2 eps``. If ``d(p, q) <= eps`` and ``p`` lives in ``c``, then
``d(q, c) <= d(p, c) + eps <= d(p, home(q)) + eps <= d(q, home(q)) + 2 eps``: every neighbour of
a point lies in its ball's home or halo rows. So each ball compares its home rows with its home and
halo rows only, one side counted, in bounded blocks (``blocks.map_block_pairs``): who is core is
exact, and spanning edges among core points connect exactly what the radius connects.

Halos are never written as a whole: where balls overlap they would repeat the table once per pivot.
They are placed for the slices of a round (see ``density``), for the balls that still have a point
without ``min_samples`` neighbours, or outside the largest component.

Semantics equal ``density.density_clusters``: identical vectors are one weighted point, a point is
core with at least ``min_samples`` points within ``eps`` (itself included), core points within
``eps`` share a cluster named by its smallest id, clusters below ``min_cluster_size`` and non-core
points are noise (-1), and so are rows without a vector. Within one ball the comparison is
quadratic: a ball holding a third of the table is split into blocks, never one task, but costs its
square; more pivots make balls smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.operators import matrices
from topicflow.operators.density import (
    BLOCK_ROWS,
    NOISE,
    _count_left,
    _edges_within,
    _id_type,
    busy_points,
    compare,
    component_labels,
    distinct_points,
    sliced,
)
from topicflow.session import cut_lineage

PIVOTS = 64


def _centres(points: DataFrame, pivots: int) -> np.ndarray:
    """The pivots: at most that many vectors, which travel with the tasks."""
    rows = points.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(pivots).select("vec").collect()
    return np.array([np.asarray(r["vec"], dtype=np.float64) for r in rows])


def _with_balls(points: DataFrame, centre: np.ndarray, eps: float, only: list[int] | None = None) -> DataFrame:
    """``points`` plus ``_home``, the ball of the nearest pivot, and ``_balls``, those (of ``only``) to take part in."""
    id_type, vec_type = _id_type(points), points.schema["vec"].dataType.simpleString()
    asked = np.isin(np.arange(len(centre)), np.arange(len(centre)) if only is None else only)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            d = matrices.distances(matrices.stack(frame["vec"]), centre)
            own = d.argmin(axis=1)
            reach = (d <= d[np.arange(len(frame)), own][:, None] + 2 * eps) & asked
            yield frame.assign(_home=own.astype(np.int64), _balls=[np.flatnonzero(r) for r in reach])

    return points.select("id", "vec", "weight").mapInPandas(
        place, f"id {id_type}, vec {vec_type}, weight bigint, _home bigint, _balls array<bigint>"
    )


def _in_balls(placed: DataFrame) -> DataFrame:
    """One row per point and ball it takes part in."""
    rows = placed.withColumn("_ball", F.explode("_balls"))
    return rows.select("id", "vec", "weight", F.array("_ball").alias("_cell"), (F.col("_ball") == F.col("_home")).alias("home"))


def balls(points: DataFrame, eps: float, pivots: int = PIVOTS) -> DataFrame:
    """``id, vec, weight, _cell, home``: one row per point and ball it takes part in (``home`` true in
    its own ball, false in halos)."""
    return _in_balls(_with_balls(points, _centres(points, pivots), eps))


def compared_pairs(rows: DataFrame) -> int:
    """How many point pairs the balls compare: home rows times home-or-halo rows, summed over balls."""
    sizes = rows.groupBy("_cell").agg(F.sum(F.col("home").cast("long")).alias("h"), F.count("*").alias("r"))
    return int(sizes.agg(F.sum(F.col("h") * F.col("r"))).first()[0] or 0)


def density_clusters(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    eps: float,
    min_samples: int = 5,
    min_cluster_size: int = 20,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, cluster, is_core`` as ``density.density_clusters``, with pivot balls instead of a grid."""
    noise = F.lit(str(NOISE)).cast(df.schema[id_col].dataType)
    points = distinct_points(df, id_col, vec_col)
    if points.schema["vec"].dataType.simpleString() != "array<float>":
        points = points.withColumn("vec", F.col("vec").cast("array<double>"))
    points, slices = sliced(cut_lineage(points), block_rows)
    id_type = _id_type(points)
    centre = _centres(points, pivots)
    home = _with_balls(points, centre, eps, []).select("id", "vec", "weight", F.array("_home").alias("_cell"))
    home = cut_lineage(home)

    def compared(asking: DataFrame, others: DataFrame, fn, schema: str) -> DataFrame:
        # of the others only what can be near to an asking point's ball is placed, a round's slices at a time
        asked = [r["_cell"][0] for r in asking.select("_cell").distinct().collect()]
        placed = _in_balls(cut_lineage(_with_balls(others, centre, eps, asked)))
        return compare(asking, placed, fn, schema, block_rows, [[0]])

    def counts(asking: DataFrame, part: Column) -> DataFrame:
        return compared(asking, points.where(part), _count_left(eps), f"id {id_type}, n bigint")

    busy = busy_points(home, slices, counts, min_samples)
    core = cut_lineage(home.join(busy, "id", "left_semi"))
    others = cut_lineage(points.join(busy, "id", "left_semi"))

    def links(asking: DataFrame, part: Column) -> DataFrame:
        return compared(asking, others.where(part), _edges_within(eps), f"src {id_type}, dst {id_type}")

    labelled = core.join(component_labels(core, slices, links), "id").select("vec", "weight", "_comp")
    large = labelled.groupBy("_comp").agg(F.sum("weight").alias("_size")).where(F.col("_size") >= min_cluster_size)
    clusters = labelled.join(large, "_comp", "left").select(
        "vec", F.when(F.col("_size").isNotNull(), F.col("_comp")).otherwise(noise).alias("cluster")
    )
    rows = df.select(F.col(id_col), F.col(vec_col).cast(points.schema["vec"].dataType).alias("vec"))
    return rows.join(clusters, "vec", "left").select(
        id_col, F.coalesce("cluster", noise).alias("cluster"), F.col("cluster").isNotNull().alias("is_core")
    )
