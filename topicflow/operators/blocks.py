"""Comparing rows with rows in bounded blocks.

Some operators are defined over pairs of rows: all-pairs silhouette, neighbours
within a radius, near-copies that share a signature band. They all use the same
plan. Rows get a cell (only rows of the same or of neighbouring cells can
match), a cell is split by a hash of the row id into blocks of about
``block_rows`` rows, and every pair of blocks becomes one unit of work. A cell
that holds a third of the table turns into many blocks, so no task ever sees a
whole cell. A unit compares its two blocks as matrices and returns reduced rows
(sums, counts, a spanning forest), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
WHOLE_TABLE = [0]

PairFunction = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


def constant_cell() -> Column:
    """One cell for everything: every row is compared with every row."""
    return F.array(*[F.lit(v).cast("bigint") for v in WHOLE_TABLE])


def cell_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``_cell, _blocks, _rows``: how many blocks each cell is split into."""
    return (
        rows.groupBy("_cell")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_blocks", F.ceil(F.col("_rows") / F.lit(block_rows)).cast("bigint"))
    )


def with_blocks(rows: DataFrame, cells: DataFrame, id_col: str) -> DataFrame:
    """Add ``_block`` to ``rows``; rows of cells missing in ``cells`` are left out."""
    return rows.join(cells.select("_cell", "_blocks"), "_cell").withColumn(
        "_block", F.pmod(F.xxhash64(F.lit("block"), id_col), F.col("_blocks"))
    ).drop("_blocks")


def with_anchor(members: DataFrame, cells: DataFrame, payload: str) -> DataFrame:
    """Add ``_anchor``, the ``id`` and ``payload`` of the cell's first member.

    ``members`` have ``_cell`` and ``_block``. The anchor is repeated for every
    block of its cell, so that the join has no hot key.
    """
    first = members.groupBy("_cell").agg(F.min(F.struct("id", payload)).alias("_anchor"))
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block")
    return members.join(first.join(cells, "_cell").select("_cell", "_anchor", block), ["_cell", "_block"])


def block_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    offsets: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """One row per pair of blocks to compare.

    ``left`` and ``right`` are cell tables. With ``right`` left out the table is
    compared with itself: ``offsets`` must then hold one of each pair of
    opposite neighbours, and within a cell each unordered pair occurs once.
    """
    own = right is None
    right = left if own else right
    offsets = list(offsets or [WHOLE_TABLE])
    shifts = F.array(*[F.array(*[F.lit(int(v)).cast("bigint") for v in o]) for o in offsets])
    source = left.select(F.col("_cell").alias("_lcell"), F.col("_blocks").alias("_ln"), F.col("_rows").alias("_lr"))
    source = source.withColumn("_shift", F.explode(shifts)).withColumn(
        "_rcell", F.zip_with("_lcell", "_shift", lambda a, b: a + b)
    )
    target = right.select(F.col("_cell").alias("_rcell"), F.col("_blocks").alias("_rn"), F.col("_rows").alias("_rr"))
    cells = source.join(target, "_rcell")
    pairs = cells.withColumn("_lblock", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ln") - 1))).withColumn(
        "_rblock", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rn") - 1))
    )
    if own:
        pairs = pairs.where((F.col("_lcell") != F.col("_rcell")) | (F.col("_lblock") <= F.col("_rblock")))
    same = (F.col("_lcell") == F.col("_rcell")) & (F.col("_lblock") == F.col("_rblock")) & F.lit(own)
    return pairs.select(
        F.xxhash64("_lcell", "_lblock", "_rcell", "_rblock").alias("_pair"),
        "_lcell",
        "_lblock",
        "_rcell",
        "_rblock",
        same.alias("_same"),
        (F.col("_lr") / F.col("_ln") + F.col("_rr") / F.col("_rn")).alias("_load"),
    )


def map_block_pairs(
    left: DataFrame,
    right: DataFrame,
    pairs: DataFrame,
    fn: PairFunction,
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``fn(left_rows, right_rows, same_block)`` for every pair of blocks.

    Many small pairs share one Python call: pairs are spread over bins by hash,
    with as many bins as keep the expected rows per bin near two blocks' worth
    (counted from the block table, not from the rows).
    """
    load = pairs.agg(F.sum("_load")).first()[0] or 0
    bins = max(1, math.ceil(load / (2 * block_rows)))
    keyed = pairs.withColumn("_bin", F.pmod(F.col("_pair"), F.lit(bins)))
    lhs = left.join(
        keyed.select(F.col("_lcell").alias("_cell"), F.col("_lblock").alias("_block"), "_bin", "_pair", "_same"),
        ["_cell", "_block"],
    ).drop("_cell", "_block")
    rhs = right.join(
        keyed.select(F.col("_rcell").alias("_cell"), F.col("_rblock").alias("_block"), "_bin", "_pair"),
        ["_cell", "_block"],
    ).drop("_cell", "_block")
    # both sides may be the same table: give the right side columns of its own
    rhs = rhs.select(*[F.col(c).alias(c) for c in rhs.columns])
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        rights = dict(iter(rpdf.groupby("_pair", sort=False)))
        parts = []
        for pair, lrows in lpdf.groupby("_pair", sort=False):
            rrows = rights.get(pair)
            if rrows is not None:
                parts.append(fn(lrows, rrows, bool(lrows["_same"].iloc[0])))
        parts = [p for p in parts if len(p)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)

    return lhs.groupBy("_bin").cogroup(rhs.groupBy("_bin")).applyInPandas(run, schema)


def half_neighbours(dims: int) -> list[list[int]]:
    """Own cell and one of each pair of opposite neighbour cells."""
    return [o for o in all_neighbours(dims) if tuple(o) >= (0,) * dims]


def all_neighbours(dims: int) -> list[list[int]]:
    offsets: Iterable[list[int]] = [[]]
    for _ in range(dims):
        offsets = [o + [d] for o in offsets for d in (-1, 0, 1)]
    return list(offsets)
