"""Near-duplicate groups by MinHash signatures, exact in the signature space.

Two texts are near copies when their signatures agree in at least
``threshold`` of the positions. Signatures are cut into bands; by the
pigeonhole principle a pair that differs in fewer positions than there are
bands shares a whole band, so comparing within bands misses no such pair.
Identical signatures are collapsed first. A band shared by very many texts is
measured against its first text: all texts near that one are connected through
it and need no comparison with each other, and of the others only those at a
similar distance from it are compared, in bounded blocks (see ``blocks``). So a
huge group of near copies costs one comparison per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.operators import blocks, matrices
from topicflow.operators.components import connected_components
from topicflow.session import cut_lineage

N_HASHES = 64
N_BANDS = 16
BLOCK_ROWS = 512
# odd 64-bit multipliers of the rolling hash
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the word n-grams, combined from the word hashes modulo
    2^64; a shorter text is one shingle."""
    x = np.asarray(hashes, dtype=np.int64).view(np.uint64)
    width = min(n, len(x))
    grams = np.zeros(max(len(x) - n + 1, 1), dtype=np.uint64)
    for i in range(width):
        grams = grams * _BASE + x[i : i + len(grams)]
    grams ^= grams >> np.uint64(29)
    return np.unique(grams * _MIX)


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    a = rng.integers(0, top, size=n, dtype=np.uint64, endpoint=True) | np.uint64(1)
    b = rng.integers(0, top, size=n, dtype=np.uint64, endpoint=True)
    return a, b


def signatures(
    df: DataFrame, id_col: str, tokens: Column, shingle: int = 3, n_hashes: int = N_HASHES, seed: int = 42
) -> DataFrame:
    """``id, sig``: array<int> of ``n_hashes`` minima over the whole text."""
    a, b = _permutations(n_hashes, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sigs = []
            for hashes in batch["_hashes"]:
                # a*x + b modulo 2^64, of which the upper bits are kept
                x = _shingles(hashes, shingle)
                best = np.full(n_hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
                for start in range(0, len(x), 4096):
                    part = a[:, None] * x[None, start : start + 4096] + b[:, None]
                    best = np.minimum(best, part.min(axis=1))
                sigs.append((best >> np.uint64(33)).astype(np.int32))
            yield pd.DataFrame({"id": batch["id"], "sig": sigs})

    source = df.select(F.col(id_col).alias("id"), token_hashes(tokens).alias("_hashes"))
    return source.mapInPandas(run, f"id {_id_type(df, id_col)}, sig array<int>")


def _agreeing(threshold: float):
    def edges(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = np.stack(left["sig"].to_numpy()), np.stack(right["sig"].to_numpy())
        agree = np.zeros((len(a), len(b)), dtype=np.int16)
        for i in range(a.shape[1]):
            agree += a[:, i][:, None] == b[:, i][None, :]
        linked = agree >= threshold * a.shape[1]
        return matrices.star_edges(left["id"].to_numpy(), right["id"].to_numpy(), linked)

    return edges


def _rings(members: DataFrame, crowded: DataFrame, differ: int) -> DataFrame:
    """``id, sig, _cell, _first``: members of crowded bands with their distance ring.

    The ring is the number of positions in which a signature differs from the
    band's first one, in steps of ``differ + 1``. Near copies of the first text
    are ring 0, and near copies of each other are in the same or adjacent rings.
    """
    apart = F.aggregate(
        F.zip_with("sig", "_anchor.sig", lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda acc, x: acc + x
    )
    ring = F.floor(apart / F.lit(differ + 1)).cast("bigint")
    return blocks.with_anchor(members, crowded, "sig").select(
        "id", "sig", F.concat("_cell", F.array(ring)).alias("_cell"), F.col("_anchor.id").alias("_first")
    )


def near_duplicate_groups(
    df: DataFrame,
    id_col: str,
    tokens: Column,
    threshold: float = 0.8,
    shingle: int = 3,
    n_hashes: int = N_HASHES,
    n_bands: int = N_BANDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, group``: ``group`` is the smallest id among the connected near copies.
    Ids may be of any ordered type, such as the text ids of the store."""
    if n_hashes - int(np.ceil(threshold * n_hashes)) >= n_bands:
        raise ValueError("n_bands must exceed the number of positions two near copies may differ in")
    width = n_hashes // n_bands
    sigs = cut_lineage(signatures(df, id_col, tokens, shingle, n_hashes))
    points = sigs.groupBy("sig").agg(F.min("id").alias("id"))
    bands = F.array(
        *[
            F.array(F.lit(i).cast("bigint"), F.xxhash64(F.slice("sig", i * width + 1, width)))
            for i in range(n_bands)
        ]
    )
    # bands of a single text go before the signatures, the wide part, are attached
    banded = points.select("id", F.explode(bands).alias("_cell"))
    cells = cut_lineage(blocks.cell_blocks(banded, block_rows).where("_rows > 1"))
    link = _agreeing(threshold)
    schema = "src {0}, dst {0}".format(_id_type(df, id_col))

    usual = cells.where("_blocks = 1")
    placed = blocks.with_blocks(banded, usual, "id").join(points, "id")
    # the own cell is the only neighbour of a band
    pairs = blocks.block_pairs(usual, offsets=[[0, 0]])
    edges = blocks.map_block_pairs(placed, placed, pairs, link, schema, block_rows)

    crowded = cells.where("_blocks > 1")
    if not crowded.isEmpty():
        differ = n_hashes - int(np.ceil(threshold * n_hashes))
        ringed = cut_lineage(_rings(blocks.with_blocks(banded, crowded, "id").join(points, "id"), crowded, differ))
        star = ringed.where((F.get("_cell", 2) == 0) & (F.col("id") != F.col("_first"))).select(
            F.col("id").alias("src"), F.col("_first").alias("dst")
        )
        ringed = ringed.drop("_first")
        rings = blocks.cell_blocks(ringed, block_rows)
        placed = blocks.with_blocks(ringed, rings, "id")
        pairs = blocks.block_pairs(rings, offsets=[[0, 0, 0], [0, 0, 1]])
        pairs = pairs.where((F.get("_lcell", 2) > 0) | (F.get("_rcell", 2) > 0))
        rest = blocks.map_block_pairs(placed, placed, pairs, link, schema, block_rows)
        edges = edges.unionByName(star).unionByName(rest)
    components = connected_components(edges.distinct())
    grouped = points.join(components, points["id"] == components["node"], "left").select(
        "sig", F.coalesce("component", "id").alias("group")
    )
    return sigs.join(grouped, "sig").select(F.col("id").alias(id_col), "group")


def drop_near_duplicates(df: DataFrame, id_col: str, tokens: Column, **options) -> DataFrame:
    """Keep the row with the smallest id of every near-copy group."""
    groups = near_duplicate_groups(df, id_col, tokens, **options)
    keep = groups.where(F.col("group") == F.col(id_col)).select(id_col)
    return df.join(keep, id_col, "left_semi")
