"""Density clustering with noise at a fixed radius.

A point is core when at least ``min_samples`` points (itself included) lie
within ``eps``. Core points within ``eps`` of each other share a cluster, other
points and clusters below ``min_cluster_size`` are noise (-1). This is a
horizontal cut through the density hierarchy, and it is computed exactly:

* identical vectors are collapsed to one weighted point first, so a huge group
  of copies is one row;
* the leading ``grid_dims`` coordinates, cut into cells of width ``eps``, limit
  the comparisons: points within ``eps`` lie in the same or adjacent cells;
* a crowded cell gets an anchor, its first point. Points within ``eps / 2`` of it
  are within ``eps`` of each other: with enough of them all are core and connected
  through the anchor, and they are not compared with each other;
* everything else is compared in bounded blocks, which return neighbour counts
  and spanning edges (see ``blocks``);
* the other side of the comparisons comes in slices of the points by id hash, few
  first and four times as many in every round. A point that has ``min_samples``
  neighbours is core and asks no further, and core points that are connected to
  the largest component have nothing left to find there, so only the open rest
  meets the later slices. Nobody is given up before all slices were met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.operators import blocks, matrices
from topicflow.operators.components import connected_components
from topicflow.operators.cluster import fit_reducer, reduce_vectors
from topicflow.session import cut_lineage

NOISE = -1
# rows per block here, and rows that are compared at a time within a block
BLOCK_ROWS, TILE_ROWS = 2048, 512
# slices (of about ``block_rows`` points) that the first round of counting and of linking meets
COUNT_FIRST, LINK_FIRST, WIDEN = 8, 2, 4


def grid_cell(vec: Column, eps: float, dims: int) -> Column:
    """Cell on the leading coordinates. The first cell axes of a PCA projection
    separate best; any coordinates give exact results."""
    parts = [F.floor(F.get(vec, i).cast("double") / F.lit(float(eps))).cast("bigint") for i in range(dims)]
    return F.array(*parts)


def _id_type(points: DataFrame) -> str:
    return points.schema["id"].dataType.simpleString()


def distinct_points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec, weight``: one row per distinct vector, under its smallest id."""
    return (
        df.where(F.col(vec_col).isNotNull())
        .groupBy(F.col(vec_col).alias("vec"))
        .agg(F.min(id_col).alias("id"), F.count("*").alias("weight"))
    )


def _gridded(points: DataFrame, eps: float, dims: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    cells_of = points.withColumn("_cell", grid_cell(F.col("vec"), eps, dims))
    cells = blocks.cell_blocks(cells_of, block_rows)
    return blocks.with_blocks(cells_of, cells, "id"), cells


def _distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def _with_rings(points: DataFrame, eps: float, min_samples: int, dims: int, block_rows: int) -> DataFrame:
    """``points`` plus ``_cell`` and ``anchor``. The last cell coordinate is 0 for
    points around the anchor of a dense cell, else 1."""
    grid = points.withColumn("_cell", grid_cell(F.col("vec"), eps, dims))
    crowded = cut_lineage(blocks.cell_blocks(grid, block_rows).where("_blocks > 1"))
    if crowded.isEmpty():
        inner = points.select("id", F.lit(None).cast(points.schema["id"].dataType).alias("anchor")).limit(0)
    else:
        members = blocks.with_anchor(blocks.with_blocks(grid, crowded, "id"), crowded, "vec")
        close = members.where(_distance("vec", "_anchor.vec") <= eps / 2).select(
            "id", "weight", "_cell", F.col("_anchor.id").alias("anchor")
        )
        dense = close.groupBy("_cell").agg(F.sum("weight").alias("_w")).where(F.col("_w") >= min_samples)
        inner = close.join(dense.select("_cell"), "_cell", "left_semi").select("id", "anchor")
    ringed = grid.join(inner, "id", "left")
    ring = F.when(F.col("anchor").isNotNull(), 0).otherwise(1).cast("bigint")
    return cut_lineage(ringed.withColumn("_cell", F.concat("_cell", F.array(ring))))


def _inner(cell: str, dims: int) -> Column:
    return F.get(cell, dims) == 0


def _reach(eps: float):
    """An anchor (left) against the inner points of another dense cell: one link, if any."""

    def reach(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        near = matrices.distances(matrices.stack(left["vec"]), matrices.stack(right["vec"])) <= eps
        hit = near.any(axis=1)
        to = near.argmax(axis=1)[hit]
        return pd.DataFrame(
            {
                "src": left["id"].to_numpy()[hit],
                "dst": right["id"].to_numpy()[to],
                "other": right["anchor"].to_numpy()[to].astype(right["id"].dtype),
            }
        )

    return reach


def _dense_edges(placed: DataFrame, cells: DataFrame, pairs: DataFrame, eps: float, dims: int, block_rows: int):
    """Edges among the inner points of dense cells.

    Inside a cell they hang on the anchor. Two adjacent dense cells are linked
    by one edge if an anchor reaches into the other cell; only if neither does,
    and the anchors are within ``2 * eps``, are their points compared.
    """
    inner = placed.where(_inner("_cell", dims))
    star = inner.where("id <> anchor").select(F.col("id").alias("src"), F.col("anchor").alias("dst"))
    anchors = inner.where("id = anchor").select("id", "vec", "_cell")
    anchor_cells = anchors.select("_cell", F.lit(1).cast("bigint").alias("_rows"), F.lit(1).cast("bigint").alias("_blocks"))
    offsets = [o + [0] for o in blocks.all_neighbours(dims) if any(o)]
    reached = cut_lineage(
        blocks.map_block_pairs(
            anchors.withColumn("_block", F.lit(0).cast("bigint")),
            inner,
            blocks.block_pairs(anchor_cells, cells, offsets),
            _reach(eps),
            "src {0}, dst {0}, other {0}".format(_id_type(placed)),
            block_rows,
        )
    )
    linked = reached.select(F.least("src", "other").alias("_a"), F.greatest("src", "other").alias("_b")).distinct()
    lhs = anchors.select(F.col("_cell").alias("_lcell"), F.col("id").alias("_lid"), F.col("vec").alias("_lvec"))
    rhs = anchors.select(F.col("_cell").alias("_rcell"), F.col("id").alias("_rid"), F.col("vec").alias("_rvec"))
    open_pairs = (
        pairs.where(F.col("_lcell") != F.col("_rcell"))
        .join(lhs, "_lcell")
        .join(rhs, "_rcell")
        .where(_distance("_lvec", "_rvec") <= 2 * eps)
        .withColumns({"_a": F.least("_lid", "_rid"), "_b": F.greatest("_lid", "_rid")})
        .join(linked, ["_a", "_b"], "left_anti")
        .select(*pairs.columns)
    )
    rest = blocks.map_block_pairs(inner, inner, open_pairs, _edges_within(eps), "src {0}, dst {0}".format(_id_type(placed)), block_rows)
    return star.unionByName(reached.select("src", "dst")).unionByName(rest)


def _count_left(eps: float):
    """Weighted neighbours of the left rows."""

    def count(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        near = matrices.distances(matrices.stack(left["vec"]), matrices.stack(right["vec"])) <= eps
        # rounding may leave a point slightly away from itself
        near |= left["id"].to_numpy()[:, None] == right["id"].to_numpy()[None, :]
        out = pd.DataFrame({"id": left["id"].to_numpy(), "n": near @ right["weight"].to_numpy()})
        return out[out["n"] > 0]

    return count


def _edges_within(eps: float):
    def edges(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        near = matrices.distances(matrices.stack(left["vec"]), matrices.stack(right["vec"])) <= eps
        return matrices.star_edges(left["id"].to_numpy(), right["id"].to_numpy(), near)

    return edges


def sliced(points: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """``points`` plus ``_slice``, and how many slices (of about ``block_rows`` points) there are."""
    slices = max(1, -(-points.count() // block_rows))
    return points.withColumn("_slice", F.pmod(F.xxhash64(F.lit("slice"), "id"), F.lit(slices))), slices


def _rounds(slices: int, first: int) -> Iterator[Column]:
    """Which rows each round meets: the first slices, then always ``WIDEN`` times as many as all before."""
    lo, hi = 0, first
    while lo < slices:
        yield (F.col("_slice") >= lo) & (F.col("_slice") < hi)
        lo, hi = hi, hi * WIDEN


def compare(left: DataFrame, right: DataFrame, fn, schema: str, block_rows: int, offsets=None, wanted: Column | None = None) -> DataFrame:
    """``fn`` over every block of ``left`` and every block of ``right`` in the cells next to it."""
    left_cells, right_cells = (cut_lineage(blocks.cell_blocks(x, block_rows)) for x in (left, right))
    pairs = blocks.block_pairs(left_cells, right_cells, offsets)
    pairs = pairs if wanted is None else pairs.where(wanted)
    placed = blocks.with_blocks(left, left_cells, "id"), blocks.with_blocks(right, right_cells, "id")
    return blocks.map_block_pairs(*placed, pairs, fn, schema, block_rows)


def busy_points(asking: DataFrame, slices: int, compared, min_samples: int) -> DataFrame:
    """The ids in ``asking`` that have ``min_samples`` weighted neighbours.

    ``compared(asking, round)`` gives ``id, n``, the neighbours in a round's slices.
    """
    open_rows, found = asking.withColumn("_n", F.lit(0).cast("bigint")), asking.select("id").limit(0)
    for part in _rounds(slices, COUNT_FIRST):
        counts = compared(open_rows.drop("_n"), part).groupBy("id").agg(F.sum("n").alias("_more"))
        counted = open_rows.join(counts, "id", "left").withColumn("_n", F.col("_n") + F.coalesce("_more", F.lit(0))).drop("_more")
        counted = cut_lineage(counted)
        found = found.unionByName(counted.where(F.col("_n") >= min_samples).select("id"))
        open_rows = counted.where(F.col("_n") < min_samples)
        if open_rows.isEmpty():
            break
    return found.distinct()


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after the components that ``edges`` touch are joined."""
    ends = [labels.select(F.col("id").alias(c), F.col("_comp").alias(f"_{c}")) for c in ("src", "dst")]
    links = edges.join(ends[0], "src").join(ends[1], "dst").where("_src <> _dst")
    links = cut_lineage(links.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    if links.isEmpty():
        return labels
    roots = connected_components(links).select(F.col("node").alias("_comp"), F.col("component").alias("_root"))
    return cut_lineage(labels.join(roots, "_comp", "left").select("id", F.coalesce("_root", "_comp").alias("_comp")))


def component_labels(core: DataFrame, slices: int, compared, edges: DataFrame | None = None) -> DataFrame:
    """``id, _comp``: the component of every core point, named by its smallest id.

    ``compared(asking, round)`` gives edges that connect what the asking points reach in a round's
    slices, ``edges`` those known before. From the second round on the points of one component, the
    largest after the first, no longer ask: two points in different components are not both in it, and
    the one outside has met all slices in the end.
    """
    labels, largest = core.select("id").distinct(), None
    for part in _rounds(slices, LINK_FIRST):
        if largest is None:
            met = compared(core, part)
            components = connected_components(met if edges is None else met.unionByName(edges))
            labels = labels.join(components, labels["id"] == components["node"], "left")
            labels = cut_lineage(labels.select("id", F.coalesce("component", "id").alias("_comp")))
            biggest = labels.groupBy("_comp").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_comp").first()
            if biggest is None:
                break
            largest = biggest["_comp"]
            continue
        largest = labels.where(F.col("id") == F.lit(largest)).first()["_comp"]
        asking = labels.where(F.col("_comp") != F.lit(largest)).select("id")
        if asking.isEmpty():
            break
        labels = _merged(labels, compared(cut_lineage(core.join(asking, "id", "left_semi")), part))
    return labels


def density_clusters(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    eps: float,
    min_samples: int = 5,
    min_cluster_size: int = 20,
    grid_dims: int = 2,
    block_rows: int = BLOCK_ROWS,
    min_tokens: int | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """``id, cluster, is_core``. A cluster is named by its smallest point id, and
    has the type of the ids; noise is -1 in that type.

    With ``min_tokens`` rows whose token array is shorter are noise at once and
    do not take part.
    """
    noise = F.lit(str(NOISE)).cast(df.schema[id_col].dataType)
    taking_part = df if min_tokens is None else df.where(F.size(tokens_col) >= min_tokens)
    points = cut_lineage(distinct_points(taking_part, id_col, vec_col))
    points, slices = sliced(_with_rings(points, eps, min_samples, grid_dims, block_rows), block_rows)
    id_type, offsets = _id_type(points), blocks.all_neighbours(grid_dims + 1)
    both_inner = _inner("_lcell", grid_dims) & _inner("_rcell", grid_dims)

    def counts(asking: DataFrame, part: Column) -> DataFrame:
        return compare(asking, points.where(part), _count_left(eps), f"id {id_type}, n bigint", block_rows, offsets)

    outer, inner = points.where(~_inner("_cell", grid_dims)), points.where(_inner("_cell", grid_dims))
    busy = busy_points(outer, slices, counts, min_samples)
    core = cut_lineage(points.join(busy.union(inner.select("id")).distinct(), "id", "left_semi"))

    def links(asking: DataFrame, part: Column) -> DataFrame:
        return compare(
            asking, core.where(part), _edges_within(eps), f"src {id_type}, dst {id_type}", block_rows, offsets, ~both_inner
        )

    dense = None
    if not core.where(_inner("_cell", grid_dims)).isEmpty():
        cells = blocks.cell_blocks(core, block_rows)
        placed = blocks.with_blocks(core, cells, "id")
        pairs = blocks.block_pairs(cells, offsets=blocks.half_neighbours(grid_dims + 1))
        dense = _dense_edges(placed, cells, pairs.where(both_inner), eps, grid_dims, block_rows)
    labelled = core.join(component_labels(core, slices, links, dense), "id").select("vec", "weight", "_comp")
    large = labelled.groupBy("_comp").agg(F.sum("weight").alias("_size")).where(F.col("_size") >= min_cluster_size)
    clusters = labelled.join(large, "_comp", "left").select(
        "vec", F.when(F.col("_size").isNotNull(), F.col("_comp")).otherwise(noise).alias("cluster")
    )
    result = taking_part.select(F.col(id_col), F.col(vec_col).alias("vec")).join(clusters, "vec", "left")
    result = result.select(
        id_col,
        F.coalesce("cluster", noise).alias("cluster"),
        F.col("cluster").isNotNull().alias("is_core"),
    )
    if min_tokens is None:
        return result
    rest = df.where(F.size(tokens_col) < min_tokens).select(
        id_col, noise.alias("cluster"), F.lit(False).alias("is_core")
    )
    return result.unionByName(rest)


def _nearest_within(eps: float):
    def nearest(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        right = right.sort_values("cluster")  # equal distances go to the smaller cluster
        x, y = matrices.stack(left["vec"]), matrices.stack(right["vec"])
        best, dist = np.empty(len(left), dtype=np.int64), np.empty(len(left))
        for at in range(0, len(left), TILE_ROWS):
            tile = slice(at, at + TILE_ROWS)
            d = matrices.distances(x[tile], y)
            best[tile] = d.argmin(axis=1)
            dist[tile] = d[np.arange(len(d)), best[tile]]
        out = pd.DataFrame(
            {"id": left["id"].to_numpy(), "distance": dist, "cluster": right["cluster"].to_numpy()[best]}
        )
        return out[out["distance"] <= eps]

    return nearest


def density_assign(
    df: DataFrame,
    core: DataFrame,
    id_col: str,
    vec_col: str,
    eps: float,
    grid_dims: int = 2,
    block_rows: int = 4 * BLOCK_ROWS,
) -> DataFrame:
    """``id, cluster, strength`` by the nearest core point within ``eps``.

    ``core`` is ``(vec, cluster)`` of clustered core points. Strength is
    ``1 - distance / eps`` clipped to [0, 1]; rows out of reach are -1 with 0.
    A row that equals a core point is at distance 0 from it and compared with no
    other; the rest meets the core points of its cell and the adjacent ones.
    """
    left = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = core.schema["cluster"].dataType
    targets = core.where(F.col("cluster") != F.lit(str(NOISE)).cast(kind)).groupBy("vec").agg(F.min("cluster").alias("cluster"))
    targets = cut_lineage(targets.withColumn("id", F.xxhash64("vec")))
    own = targets.select(F.col("vec").cast("array<double>").alias("_key"), F.col("cluster").alias("_own"))
    known = cut_lineage(left.withColumn("_key", F.col("vec").cast("array<double>")).join(own, "_key", "left").drop("_key"))
    exact = known.where(F.col("_own").isNotNull()).select("id", F.lit(0.0).alias("distance"), F.col("_own").alias("cluster"))
    placed, cells = _gridded(known.where(F.col("_own").isNull()).drop("_own"), eps, grid_dims, block_rows)
    goal, goal_cells = _gridded(targets, eps, grid_dims, block_rows)
    pairs = blocks.block_pairs(cells, goal_cells, blocks.all_neighbours(grid_dims))
    found = blocks.map_block_pairs(
        placed, goal, pairs, _nearest_within(eps), f"id {_id_type(left)}, distance double, cluster {kind.simpleString()}", block_rows
    )
    best = found.unionByName(exact).groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("_b"))
    strength = F.least(F.greatest(1 - F.col("_b.distance") / F.lit(float(eps)), F.lit(0.0)), F.lit(1.0))
    return left.join(best, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("_b.cluster", F.lit(str(NOISE)).cast(kind)).alias("cluster"),
        F.coalesce(strength, F.lit(0.0)).alias("strength"),
    )


class DensityClusterer:
    """Centred PCA (optional) followed by density clustering, kept as its core points.

    The leading PCA axes separate best, so the grid over them prunes most of the
    comparisons that the raw coordinates would need.
    """

    def __init__(self, reducer: PipelineModel | None, core: DataFrame, eps: float, vec_col: str = "embedding"):
        self.reducer, self.core, self.eps, self.vec_col = reducer, core, eps, vec_col

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        id_col: str,
        vec_col: str,
        eps: float,
        min_samples: int = 5,
        min_cluster_size: int = 20,
        pca_size: int | None = 50,
        **options,
    ) -> tuple[DensityClusterer, DataFrame]:
        """The fitted object and ``id, cluster, is_core`` of the rows it was fitted on."""
        reducer = fit_reducer(df.where(F.col(vec_col).isNotNull()), vec_col, pca_size) if pca_size else None
        points = cut_lineage(cls._reduced(df.where(F.col(vec_col).isNotNull()), reducer, vec_col).select(id_col, F.col("reduced").alias("vec")))
        found = cut_lineage(density_clusters(points, id_col, "vec", eps, min_samples, min_cluster_size, **options))
        noise = F.lit(str(NOISE)).cast(found.schema["cluster"].dataType)
        core = found.where(F.col("is_core") & (F.col("cluster") != noise)).join(points, id_col).select("vec", "cluster")
        return cls(reducer, cut_lineage(core.distinct()), eps, vec_col), found

    @staticmethod
    def _reduced(df: DataFrame, reducer: PipelineModel | None, vec_col: str) -> DataFrame:
        if reducer is None:
            return df.withColumn("reduced", F.col(vec_col).cast("array<double>"))
        return reduce_vectors(df, reducer, vec_col)

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        """``id, cluster, strength`` of rows with a vector."""
        reduced = self._reduced(df.where(F.col(self.vec_col).isNotNull()), self.reducer, self.vec_col)
        return density_assign(reduced, self.core, id_col, "reduced", self.eps)

    def save(self, path: str) -> None:
        if self.reducer is not None:
            self.reducer.write().overwrite().save(f"{path}/reducer")
        self.core.withColumn("eps", F.lit(float(self.eps))).withColumn("reduces", F.lit(self.reducer is not None)).write.mode(
            "overwrite"
        ).parquet(f"{path}/core")

    @classmethod
    def load(cls, path: str, spark: SparkSession, vec_col: str = "embedding") -> DensityClusterer:
        core = spark.read.parquet(f"{path}/core")
        first = core.first()
        if first is None:
            raise ValueError(f"no core points in {path}")
        reducer = PipelineModel.load(f"{path}/reducer") if first["reduces"] else None
        return cls(reducer, core.select("vec", "cluster"), first["eps"], vec_col)
