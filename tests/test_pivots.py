import numpy as np
import pytest
from test_vectors import brute_density, pairwise, points

from topicflow.operators import density, pivots


@pytest.mark.parametrize("block_rows", [8, 1000])
def test_pivots_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.normal(2, 0.3, (60, 3)), rng.uniform(-5, 5, (60, 3))])
    x[20:55] = x[20]
    got = pivots.density_clusters(points(spark, x), "id", "vec", 0.5, 5, 10, pivots=6, block_rows=block_rows)
    want, core = brute_density(pairwise(x), 0.5, 5, 10)
    rows = got.orderBy("id").collect()
    assert [r["cluster"] for r in rows] == want.tolist()
    assert [r["is_core"] for r in rows] == core.tolist()


def test_pivots_prune_clustered_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 4, (10, 16))
    x = np.concatenate([rng.normal(c, 0.25, (200, 16)) for c in centres])
    df = points(spark, x)
    eps = 0.9
    got = pivots.density_clusters(df, "id", "vec", eps, 5, 20, pivots=32)
    want, core = brute_density(pairwise(x), eps, 5, 20)
    rows = got.orderBy("id").collect()
    assert [r["cluster"] for r in rows] == want.tolist() and len(set(want)) >= 9
    # the grid version gives the same clusters
    grid = density.density_clusters(df, "id", "vec", eps, 5, 20).orderBy("id").collect()
    assert [r["cluster"] for r in grid] == want.tolist()
    placed = pivots.balls(density.distinct_points(df, "id", "vec"), eps, 32)
    compared = pivots.compared_pairs(placed)
    assert compared < 0.3 * len(x) ** 2, compared / len(x) ** 2


def test_pivots_edges(spark):
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    assert pivots.density_clusters(empty, "id", "vec", 1.0, 2, 2).count() == 0
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.5, 0.0])], "id bigint, vec array<double>")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in pivots.density_clusters(df, "id", "vec", 1.0, 2, 2).collect()}
    assert got == {1: (1, True), 2: (-1, False), 3: (1, True), 4: (1, True)}


@pytest.mark.parametrize("operator", [density, pivots])
def test_compared_rows_follow_the_table(spark, monkeypatch, operator):
    """Twice the points of one blob are not four times the rows that meet each other, and nothing else changes."""
    loads, run = [], density.blocks.map_block_pairs

    def counted(left, right, pairs, *rest):
        loads[-1] += pairs.agg({"_load": "sum"}).first()[0] or 0
        return run(left, right, pairs, *rest)

    monkeypatch.setattr(density.blocks, "map_block_pairs", counted)
    x = np.random.default_rng(9).normal(0, 0.2, (320, 8))
    x[:3] += 5  # too few to be core
    for n in (160, 320):
        loads.append(0)
        rows = operator.density_clusters(points(spark, x[:n]), "id", "vec", 1.0, 5, 10, block_rows=8).orderBy("id").collect()
        want, core = brute_density(pairwise(x[:n]), 1.0, 5, 10)
        assert [r["cluster"] for r in rows] == want.tolist() and [r["is_core"] for r in rows] == core.tolist()
    assert loads[1] < 3 * loads[0], loads
