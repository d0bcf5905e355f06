"""Nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations, three rounds of random signs and a fast Hadamard transform,
and fall to the nearest signed axis: the largest coordinate in absolute value. Every table has its own
signs. A query looks into the ``probes`` axes of every table that its own turned vector is closest to.
What it meets there is ranked by exact cosine on the original vectors, in double precision.

An axis with many vectors is split into chunks of ``chunk`` rows and the queries of an axis into blocks of
as many, so a unit of work is bounded however many vectors are alike. A unit returns at most ``k`` rows
for each query; no candidate pair leaves it and no axis is capped. The only driver-side data are the row
counts of the ``2 * dim * tables`` axes.

A query that met fewer than ``k`` rows is searched again, exactly, against all different rows in blocks of
``EXACT`` queries and rows. So every query gets ``k`` rows, or all candidates if there are fewer.

Recall depends on the data: it was measured against brute force (see the README and the tests).

Defined results: vectors that are null, zero or hold null or non-finite components, of another length
than the longest, or without an id take no part; rows with equal ids are different candidates for others,
but never for a query of that id, and give one result row per id; equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.llm.common import stored

SLICE = 256
EXACT = 4096
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width, step = *x.shape, 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Rows padded to a power of two and turned by the pseudo-rotation of ``table``."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([11, table]).choice(np.array([-1.0, 1.0]), (3, width))
    for row in signs:
        x = hadamard(x * row)
    return x


def nearest_axes(turned: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` signed axes nearest to each row, ``2 * i`` for +i and ``2 * i + 1`` for -i."""
    both = np.stack([turned, -turned], axis=2).reshape(len(turned), 2 * turned.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.add.reduce(x * x, axis=1, keepdims=True))


def usable(col: str) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, fine) & F.exists(col, lambda x: x != 0)


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    tables: int = 4,
    probes: int = 32,
    chunk: int = 512,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` nearest rows found for every row with ``is_query``."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vec_col))
    rows = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")
    )
    dim = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1
    rows = rows.where(F.size("v") == dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1).values.to_numpy().reshape(-1, dim)[batch.column(1).offsets[0].as_py() // dim :][: batch.num_rows])
            raw = [row.tobytes() for row in x]
            asks = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            ids = batch.column(0).to_numpy()
            for table in range(tables):
                turned = rotated(x, table)
                own = nearest_axes(turned, 1)
                near = nearest_axes(turned[asks], probes)
                at = np.concatenate([np.arange(len(x)), np.repeat(asks, near.shape[1])])
                axis = np.concatenate([own.ravel(), near.ravel()]) + table * 1_000_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(axis.astype(np.int64)), pa.array(np.arange(len(at)) >= len(x)), pa.array(ids[at]), pa.array([raw[i] for i in at], pa.binary())],
                    names=["axis", "asks", "id", "v"],
                )

    placed = stored(rows.mapInArrow(place, "axis long, asks boolean, id long, v binary"), "axes")
    sizes = placed.groupBy("axis").agg(
        F.ceil(F.sum((~F.col("asks")).cast("bigint")) / chunk).alias("chunks"), F.ceil(F.sum(F.col("asks").cast("bigint")) / chunk).alias("blocks")
    )
    each = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)))
    units = placed.join(F.broadcast(sizes), "axis").where("chunks > 0 and blocks > 0")  # at most 2 * dim * tables rows
    units = units.withColumn("chunk", F.explode(F.when(F.col("asks"), each("chunks")).otherwise(own("chunks"))))
    units = units.withColumn("block", F.explode(F.when(F.col("asks"), own("blocks")).otherwise(each("blocks"))))

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
        rows_at, out = np.flatnonzero(~asks), []
        rows_at = rows_at[np.argsort(ids[rows_at], kind="stable")]
        y, near_ids = x[rows_at], ids[rows_at]
        for part in np.array_split(np.flatnonzero(asks), max(1, -(-int(asks.sum()) // SLICE))):
            scores = x[part] @ y.T
            scores[ids[part][:, None] == near_ids] = -np.inf
            if scores.shape[1] > k:
                floor = np.partition(scores, -k, axis=1)[:, -k] - SLACK
            else:
                floor = np.full(len(part), -np.inf)
            for i, row in enumerate(part):
                at = np.flatnonzero((scores[i] >= floor[i]) & np.isfinite(scores[i]))
                # summed in one fixed order, so that equal vectors have equal scores in every unit
                exact = np.add.reduce(np.ascontiguousarray(x[row] * y[at]), axis=1)
                top = np.lexsort((near_ids[at], -exact))[:k]
                out += [(int(ids[row]), int(near_ids[at[j]]), float(exact[j])) for j in top]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    result = "query_id long, id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def ranked(found: DataFrame) -> DataFrame:
        # the same row comes from several units: dense ranks keep the limit before the shuffle right
        return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()

    named = lambda df: df.select("query_id", "rank", F.col("id").alias(id_col), "score")
    if not len(sizes.take(1)):
        return named(ranked(vectors.sparkSession.createDataFrame([], result)))
    met = stored(ranked(units.groupBy("axis", "chunk", "block").applyInArrow(best, result)), "near-rows")
    first = placed.where(F.col("axis") < 1_000_000)  # the first table has every row and query
    asked = first.where("asks").select(F.col("id").alias("query_id")).distinct()
    counts = met.groupBy("query_id").agg(F.count("*").alias("n"))
    short = stored(asked.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id"), "short-queries")
    if not len(short.take(1)):
        return named(met)
    asks = first.where("asks").join(short, F.col("id") == F.col("query_id"), "left_semi").select("asks", "id", "v").distinct()
    all_rows = stored(first.where("not asks").select("asks", "id", "v").distinct().unionByName(asks), "exact-rows")
    n = all_rows.agg(F.sum((~F.col("asks")).cast("bigint")).alias("rows"), F.sum(F.col("asks").cast("bigint")).alias("queries")).first()
    chunks, blocks = (F.lit(max(1, -(-x // EXACT))) for x in n)
    every = lambda x: F.sequence(F.lit(0).cast("bigint"), x - 1)
    at = lambda x: F.array(F.pmod(F.xxhash64("id", "v"), x).cast("bigint"))
    pairs = all_rows.withColumn("chunk", F.explode(F.when(F.col("asks"), every(chunks.cast("bigint"))).otherwise(at(chunks))))
    pairs = pairs.withColumn("block", F.explode(F.when(F.col("asks"), at(blocks)).otherwise(every(blocks.cast("bigint")))))
    exact = ranked(pairs.groupBy("chunk", "block").applyInArrow(best, result))
    return named(met.join(short, "query_id", "left_anti").unionByName(exact))
