"""Quality measures of a clustering and its topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.operators import blocks, matrices
from topicflow.operators.cluster import mean_vectors
from topicflow.session import cut_lineage, stored_table

NOISE = -1
DENSE_BLOCK, TILE_ROWS, PASSING_ROWS = 8192, 1024, 4096
# blocks of a group, groups of a small table, and the values (of vectors or sums) that a task holds for a group
GROUP_BLOCKS, SPREAD, GROUP_CELLS = 4, 8, 1 << 23
# which side of a pair of groups a row is on; both when a group meets itself
LEFT, RIGHT, BOTH = 0, 1, 2
# cells of one block of sparse rows made dense, and the most rows it has
DENSE_CELLS, SPARSE_BLOCK = 1 << 23, 16384


def sparse_block_rows(features: int) -> int:
    """Rows per block for sparse vectors over so many features. A row is shuffled once per group of blocks of
    the table, so blocks are as large as their dense form allows."""
    return max(blocks.BLOCK_ROWS, min(SPARSE_BLOCK, DENSE_CELLS // max(features, 1)))


def _without_noise(df: DataFrame, cluster: str) -> DataFrame:
    return df.where(F.col(cluster) != NOISE)


class _Tile:
    """Some rows of a group. Sparse vectors stay so until they are compared; ``columns`` numbers the positions."""

    def __init__(self, batch: pa.RecordBatch, columns: dict[int, int], known_only: bool):
        self.ids, self.rows = batch.column("id"), batch.num_rows
        self.labels, self.members = matrices.one_hot(batch.column("cluster").to_numpy(zero_copy_only=False))
        self.labels, self.own = self.labels.tolist(), batch.column("cluster")
        lists = batch.column("vec")
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.at, lengths = None, pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if "idx" not in batch.schema.names:
            if (lengths != lengths[0]).any():
                raise ValueError("the vectors differ in length")
            self.values = self.values.reshape(self.rows, -1)
            self.square = (self.values * self.values).sum(axis=1)
            return
        row = np.repeat(np.arange(self.rows, dtype=np.int32), lengths)
        used, code = np.unique(batch.column("idx").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        # the last of a row's equal positions counts
        _, last = np.unique((row * np.int64(max(len(used), 1)) + code)[::-1], return_index=True)
        if len(last) < len(code):
            keep = np.sort(len(code) - 1 - last)
            row, code, self.values = row[keep], code[keep], self.values[keep]
        self.square = np.bincount(row, self.values * self.values, self.rows)
        number = columns.get if known_only else lambda i, _: columns.setdefault(i, len(columns))
        column = np.array([number(i, -1) for i in used.tolist()], dtype=np.int32)[code]
        here = column >= 0
        self.at, self.values = (row[here], column[here]), self.values[here]

    def dense(self, width: int) -> np.ndarray:
        if self.at is None:
            return self.values
        out = np.zeros((self.rows, width))
        out[self.at] = self.values
        return out


class _Sums:
    """Summed distances of rows to clusters. Before they take more than ``GROUP_CELLS`` they are set out as rows."""

    def __init__(self, tiles: list[_Tile]):
        self.ids = pa.concat_arrays([t.ids for t in tiles])
        self.own = pa.concat_arrays([t.own for t in tiles])
        self.codes, self.cells, self.full = {}, np.zeros((len(self.ids), 0)), []

    def add(self, rows: slice, labels: list[int], sums: np.ndarray) -> None:
        new = [x for x in labels if x not in self.codes]
        if new and self.codes and len(self.ids) * (len(self.codes) + len(new)) > GROUP_CELLS:
            self.full.append((self.codes, self.cells))
            self.codes, self.cells, new = {}, self.cells[:, :0], labels
        if new:
            self.codes |= {x: len(self.codes) + i for i, x in enumerate(new)}
            self.cells = np.hstack([self.cells, np.zeros((len(self.ids), len(new)))])
        self.cells[rows, [self.codes[x] for x in labels]] += sums

    def taken(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Rows of the sums that are set out, at the end of all."""
        done, self.full = self.full + [(self.codes, self.cells)] * last, []
        for codes, cells in done:
            others = np.array(list(codes), dtype=np.int64)
            step = max(1, TILE_ROWS * 8 // max(len(others), 1))
            for start in range(0, len(cells) if len(others) else 0, step):
                part = cells[start : start + step]
                row = pa.array(np.repeat(np.arange(start, start + len(part)), len(others)))
                columns = [self.ids.take(row), self.own.take(row), pa.array(np.tile(others, len(part))), pa.array(part.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "own", "other", "dist"])


def _one_sided(batches: Iterator[pa.RecordBatch], most: dict[int, int]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows that come sorted by side, as batches of one side with its ``most`` rows (a side's last one may have less)."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        out = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        waiting.clear()
        return out.drop_columns(["_side"])

    side, room = None, 0
    for batch in batches:
        sides = batch.column("_side").to_numpy()
        start = 0
        while start < len(sides):
            if sides[start] != side:
                if waiting:
                    yield side, joined()
                side, room = sides[start], most[sides[start]]
            stop = min(start + room, int(np.searchsorted(sides, side, side="right")))
            waiting.append(batch.slice(start, stop - start))
            room -= stop - start
            if room == 0:
                yield side, joined()
                room = most[side]
            start = stop
    if waiting:
        yield side, joined()


def _id_codes(ids: pa.Array) -> tuple[np.ndarray, bool]:
    """Equal numbers for equal ids, own ones for nulls, and whether ids are repeated."""
    coded = ids.dictionary_encode()
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).copy()
    codes[codes < 0] = -1 - np.flatnonzero(codes < 0)
    return codes, len(coded.dictionary) + coded.null_count < len(ids)


def _pair_sums(block_rows: int):
    """Summed distances of every point of two groups (or of one) to the clusters of the other, tile by tile.

    A task has one pair. It holds the left group; the right one passes by. A group that meets itself is held
    whole, and its pairs of tiles are compared once.
    """
    tile, passing = min(TILE_ROWS, block_rows), min(PASSING_ROWS, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[int, int] = {}
        held: list[_Tile] = []
        sums, starts, room = None, None, np.empty(tile * passing)

        def distances(left: _Tile, right: _Tile, scaled: np.ndarray) -> np.ndarray:
            d = room[: left.rows * right.rows].reshape(left.rows, right.rows)
            np.dot(left.dense(len(columns)), scaled.T, out=d)
            d += left.square[:, None]
            d += right.square
            return np.sqrt(np.maximum(d, 0.0, out=d), out=d)

        def spans() -> list[slice]:
            ends = np.cumsum([t.rows for t in held]).tolist()
            return [slice(e - t.rows, e) for e, t in zip(ends, held)]

        side = None
        for side, batch in _one_sided(batches, {LEFT: tile, RIGHT: passing, BOTH: tile}):
            if side != RIGHT:
                held.append(_Tile(batch, columns, False))
                continue
            if not held:
                return
            if sums is None:
                sums, starts = _Sums(held), spans()
            right = _Tile(batch, columns, True)
            scaled, back = -2.0 * right.dense(len(columns)), _Sums([right])
            for rows, left in zip(starts, held):
                d = distances(left, right, scaled)
                sums.add(rows, right.labels, d @ right.members)
                back.add(slice(None), left.labels, d.T @ left.members)
            yield from back.taken(last=True)
            yield from sums.taken()
        if side == BOTH:
            sums, starts = _Sums(held), spans()
            codes, repeated = _id_codes(sums.ids)
            for j, right in enumerate(held):
                scaled = -2.0 * right.dense(len(columns))
                for i, left in enumerate(held[: j + 1]):
                    d = distances(left, right, scaled)
                    # rounding may leave a point slightly away from itself
                    if repeated:
                        np.putmask(d, codes[starts[i]][:, None] == codes[starts[j]], 0.0)
                    elif i == j:
                        np.fill_diagonal(d, 0.0)
                    sums.add(starts[i], right.labels, d @ right.members)
                    if i < j:
                        sums.add(starts[j], left.labels, d.T @ left.members)
                yield from sums.taken()
        if sums is not None:
            yield from sums.taken(last=True)

    return run


def _combine(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """``id, cluster, silhouette`` from summed distances per (point, cluster)."""
    mean_to = sums.join(sizes.select(F.col("cluster").alias("other"), F.col("n").alias("_n")), "other")
    own = F.col("own") == F.col("other")
    per_point = mean_to.groupBy("id", "own").agg(
        F.max(F.when(own, F.col("_n"))).alias("_size"),
        F.max(F.when(own & (F.col("_n") > 1), F.col("dist") / (F.col("_n") - 1))).alias("_a"),
        F.min(F.when(~own, F.col("dist") / F.col("_n"))).alias("_b"),
    )
    return _scored(per_point)


def _scored(per_point: DataFrame) -> DataFrame:
    """Silhouette from ``id, own, _size, _a, _b``. With one cluster only, ``_b``
    and so the value is null; a singleton scores 0."""
    largest = F.greatest("_a", "_b")
    value = (
        F.when(F.col("_b").isNull(), F.lit(None))
        .when(F.col("_size") == 1, F.lit(0.0))
        .when(largest == 0, F.lit(0.0))
        .otherwise((F.col("_b") - F.col("_a")) / largest)
    )
    return per_point.select("id", F.col("own").alias("cluster"), value.cast("double").alias("silhouette"))


def silhouette_samples(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    cluster: str,
    block_rows: int | None = None,
    idx_col: str | None = None,
) -> DataFrame:
    """``id, cluster, silhouette`` per point, Euclidean, noise left out.

    The definition needs the distance of every pair, so the work is quadratic.
    Rows are dealt by a hash of their id to groups of some blocks, and every pair
    of groups is one task: it holds the left group, compares the right one with
    it tile by tile, and returns one sum per point and cluster. A row is shuffled
    once per group of the table. For corpora where that is too much use
    ``silhouette_sq_samples`` (linear, a different number). Sparse vectors have
    their positions in ``idx_col``; only tiles of them are made dense, of at most
    ``block_rows`` (see ``sparse_block_rows``) rows.
    """
    block_rows = block_rows or (DENSE_BLOCK if idx_col is None else blocks.BLOCK_ROWS)
    sparse = [] if idx_col is None else [F.col(idx_col).alias("idx")]
    points = _without_noise(df, cluster).where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(cluster).cast("bigint").alias("cluster"), *sparse
    )
    points = stored_table(points, "points")
    rows, width = points.agg(F.count("*"), F.coalesce(F.avg(F.size("vec")), F.lit(0.0))).first()
    group_rows = max(1, min(GROUP_BLOCKS * block_rows, int(GROUP_CELLS / max(width, 1))))
    groups = max(1, -(-rows // group_rows), min(SPREAD, -(-rows // blocks.BLOCK_ROWS)))
    group = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(groups).cast("bigint")).cast("int")
    placed = points.withColumn("_group", group).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    low, high = F.least("_group", "_other"), F.greatest("_group", "_other")
    side = F.when(F.col("_group") < F.col("_other"), LEFT).when(F.col("_group") > F.col("_other"), RIGHT).otherwise(BOTH)
    pair = (high * (high + 1) / 2).cast("int") + low
    paired = placed.select("id", "vec", "cluster", *(["idx"] if sparse else []), pair.alias("_pair"), side.alias("_side"))
    dealt = paired.repartitionById(groups * (groups + 1) // 2, F.col("_pair")).sortWithinPartitions("_side").drop("_pair")
    id_type = df.schema[id_col].dataType.simpleString()
    parts = dealt.mapInArrow(_pair_sums(block_rows), f"id {id_type}, own bigint, other bigint, dist double")
    sums = parts.groupBy("id", "own", "other").agg(F.sum("dist").alias("dist"))
    sizes = points.groupBy("cluster").agg(F.count("*").alias("n"))
    return _combine(sums, sizes)


def _squared_to_clusters(left: pd.DataFrame, right: pd.DataFrame, same: bool = False) -> pd.DataFrame:
    """Mean squared distance of points to their own and nearest other cluster,
    among the clusters at hand."""
    x, centres = matrices.stack(left["vec"]), matrices.stack(right["centre"])
    mean_to = (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + right["sq"].to_numpy()[None, :]
    own = left["cluster"].to_numpy()[:, None] == right["cluster"].to_numpy()[None, :]
    size = (own * right["n"].to_numpy()[None, :]).max(axis=1, initial=0)
    a = np.where(own, mean_to, -np.inf).max(axis=1, initial=-np.inf) * size / np.maximum(size - 1, 1)
    b = np.where(own, np.inf, mean_to).min(axis=1, initial=np.inf)
    out = pd.DataFrame({"id": left["id"].to_numpy(), "own": left["cluster"].to_numpy(), "_size": size})
    return out.assign(_a=np.where(size > 1, a, np.nan), _b=np.where(np.isinf(b), np.nan, b))


def silhouette_sq_samples(df: DataFrame, id_col: str, vec_col: str, cluster: str, block: int = 4096) -> DataFrame:
    """Silhouette on squared distances, ``id, cluster, silhouette``.

    The mean squared distance to a cluster follows from its mean and mean
    squared norm, so every row meets the cluster statistics once and no other
    row. The statistics travel with the tasks in blocks of about ``block``, one
    narrow pass over the rows for each; a row keeps its own and its nearest
    other cluster's value.
    """
    points = _without_noise(df, cluster).where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(cluster).cast("bigint").alias("cluster")
    )
    norm2 = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x)
    squares = points.groupBy("cluster").agg(F.avg(norm2).alias("sq"))
    stats = cut_lineage(mean_vectors(points, "cluster", "vec").join(squares, "cluster").select("cluster", "n", "centre", "sq"))
    blocks_n = max(1, -(-stats.count() // block))
    none = F.lit(None).cast("double")
    out = points.select("*", F.lit(0).cast("bigint").alias("_size"), none.alias("_a"), none.alias("_b"))
    for number in range(blocks_n):
        rows = stats.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks_n)) == number).collect()
        table = pd.DataFrame([r.asDict() for r in rows], columns=["cluster", "n", "centre", "sq"])
        if not len(table):
            continue

        def score(batches, table=table):
            for batch in batches:
                if not len(batch):
                    continue
                found = _squared_to_clusters(batch, table)
                size = np.maximum(batch["_size"].to_numpy(), found["_size"].to_numpy())
                a = np.fmax(batch["_a"].to_numpy(float), found["_a"].to_numpy(float))
                b = np.fmin(batch["_b"].to_numpy(float), found["_b"].to_numpy(float))
                yield batch.assign(_size=size, _a=a, _b=b)

        out = out.mapInPandas(score, out.schema)
    clean = {c: F.nanvl(c, none) for c in ("_a", "_b")}
    return _scored(out.select("id", F.col("cluster").alias("own"), "_size", "_a", "_b").withColumns(clean))


def mean_silhouette(samples: DataFrame) -> DataFrame:
    """One row; null with fewer than two clusters."""
    return samples.agg(F.avg("silhouette").alias("silhouette"))


def silhouette_by_bucket(samples: DataFrame, buckets: DataFrame, id_col: str) -> DataFrame:
    """Mean silhouette per ``bucket``; ``buckets`` is ``(id, bucket)``."""
    joined = samples.join(buckets.select(F.col(id_col).alias("id"), "bucket"), "id")
    return joined.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("silhouette").alias("silhouette"))


def topic_diversity(topics: DataFrame, top_n: int | None = None, empty: float | None = None) -> DataFrame:
    """Distinct over all topic words, one row. ``top_n`` limits the words per
    topic; without any word the result is ``empty``."""
    words = topics if top_n is None else topics.where(F.col("rank") <= top_n)
    ratio = F.count_distinct("word") / F.nullif(F.count("word"), F.lit(0))
    return words.agg(F.coalesce(ratio, F.lit(empty).cast("double")).alias("diversity"))


def cluster_summary(df: DataFrame, cluster: str) -> DataFrame:
    """Clusters found, noise share and coverage, one row."""
    c = F.col(cluster)
    noise = F.coalesce((c == NOISE).cast("double"), F.lit(0.0))
    covered = (c.isNotNull() & (c != NOISE)).cast("double")
    return df.agg(
        F.count("*").alias("n_samples"),
        F.count_distinct(F.when(c != NOISE, c)).alias("n_clusters_found"),
        F.coalesce(F.avg(noise), F.lit(0.0)).alias("noise_fraction"),
        F.avg(covered).alias("coverage"),
    )


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings of the same rows, one row, from their
    contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    cells = cut_lineage(cells)
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("_ab"), F.sum("n").alias("_n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("_a"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("_b"))
    sums = both.select("_ab", "_n", rows.scalar().alias("_a"), cols.scalar().alias("_b"))
    expected = F.col("_a") * F.col("_b") / _pairs(F.col("_n"))
    largest = (F.col("_a") + F.col("_b")) / 2
    return sums.select(
        F.when(largest == expected, F.lit(1.0))
        .otherwise((F.col("_ab") - expected) / (largest - expected))
        .alias("adjusted_rand_index")
    )


def run_metrics(run_id: str, values: DataFrame) -> DataFrame:
    """One wide row of scalar metrics as ``run_id, metric, value, text`` rows."""
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            (F.lit(None) if dtype == "string" else F.col(name)).cast("double").alias("value"),
            (F.col(name) if dtype == "string" else F.lit(None)).cast("string").alias("text"),
        )
        for name, dtype in values.dtypes
    ]
    return values.select(F.inline(F.array(*entries))).select(F.lit(run_id).alias("run_id"), "metric", "value", "text")
