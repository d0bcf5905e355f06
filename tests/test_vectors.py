"""Pairwise operators against brute force, with tiny blocks and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.functions import vectors
from topicflow.operators import assign, cluster, components, dedupe, density, metrics


def points(spark, x, labels=None):
    labels = np.zeros(len(x), dtype=int) if labels is None else labels
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, cluster int").repartition(5)


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def brute_silhouette(d, labels):
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    x[:50] = x[0]  # a third of all rows are copies
    labels = rng.integers(0, 4, size=150)
    labels[7] = 9  # a singleton
    return x, labels


def by_id(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()], dtype=float)


def test_silhouette(spark, cloud):
    x, labels = cloud
    df = points(spark, x, labels)
    got = by_id(metrics.silhouette_samples(df, "id", "vec", "cluster", block_rows=20), "silhouette")
    np.testing.assert_allclose(got, brute_silhouette(pairwise(x), labels), atol=1e-7)
    for limit in (100, 2):
        got = by_id(metrics.silhouette_sq_samples(df, "id", "vec", "cluster", block=limit), "silhouette")
        np.testing.assert_allclose(got, brute_silhouette(pairwise(x) ** 2, labels), atol=1e-7)
    noisy = df.withColumn("cluster", F.when(F.col("cluster") == 0, 0).otherwise(-1))
    one = metrics.silhouette_samples(noisy, "id", "vec", "cluster")
    assert metrics.mean_silhouette(one).first()[0] is None
    one = metrics.silhouette_sq_samples(noisy, "id", "vec", "cluster")
    assert metrics.mean_silhouette(one).first()[0] is None


def test_sparse_silhouette(spark, cloud):
    x, labels = cloud
    x = np.where(np.abs(x) < 0.5, 0, x)
    rows = [(i, [int(j) * 10 for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], int(c)) for i, (r, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id bigint, idx array<bigint>, vec array<double>, cluster int")
    got = by_id(metrics.silhouette_samples(df, "id", "vec", "cluster", block_rows=40, idx_col="idx"), "silhouette")
    np.testing.assert_allclose(got, brute_silhouette(pairwise(x), labels), atol=1e-7)


def brute_density(d, eps, min_samples, min_size):
    near = d <= eps
    core = near.sum(1) >= min_samples
    label = np.arange(len(d))
    for _ in range(len(d)):
        label = np.where(core, np.where(near & core[None], label[None], len(d)).min(1), label)
    out = np.full(len(d), -1)
    for c in set(label[core]):
        if (core & (label == c)).sum() >= min_size:
            out[core & (label == c)] = c
    return out, core


@pytest.mark.parametrize("block_rows", [8, 1000])
def test_density(spark, block_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.normal(2, 0.3, (60, 3)), rng.uniform(-5, 5, (60, 3))])
    x[20:55] = x[20]
    df = points(spark, x)
    got = density.density_clusters(df, "id", "vec", 0.5, 5, 10, block_rows=block_rows)
    want, core = brute_density(pairwise(x), 0.5, 5, 10)
    assert [r["cluster"] for r in got.orderBy("id").collect()] == want.tolist()
    assert [r["is_core"] for r in got.orderBy("id").collect()] == core.tolist()
    assert len(set(want)) == 3

    fitted = got.where("cluster <> -1").join(df.drop("cluster"), "id").select("vec", "cluster")
    new = rng.uniform(-1, 3, (40, 3))
    assigned = density.density_assign(points(spark, new), fitted, "id", "vec", 0.5, block_rows=block_rows)
    members = np.flatnonzero(want != -1)
    dist = np.sqrt(((new[:, None] - x[None, members]) ** 2).sum(-1))
    hit = dist.min(1) <= 0.5
    rows = assigned.orderBy("id").collect()
    assert [r["cluster"] for r in rows] == np.where(hit, want[members[dist.argmin(1)]], -1).tolist()
    np.testing.assert_allclose([r["strength"] for r in rows], np.where(hit, 1 - dist.min(1) / 0.5, 0), atol=1e-7)


@pytest.mark.parametrize("eps", [0.2, 0.35, 0.6])
def test_density_with_dense_cells(spark, eps):
    """Tight balls on both sides of cell borders: anchors, links between cells and open pairs."""
    rng = np.random.default_rng(11)
    spots = [(0.01, 0.01), (-0.05, 0.02), (eps * 1.02, 0.0), (eps * 1.9, 0.1), (eps * 2.6, eps), (3.0, 3.0)]
    x = np.concatenate([rng.normal(s, eps / 9, (40, 2)) for s in spots] + [rng.uniform(-1, 4, (30, 2))])
    got = density.density_clusters(points(spark, x), "id", "vec", eps, 6, 8, block_rows=10)
    want, core = brute_density(pairwise(x), eps, 6, 8)
    rows = got.orderBy("id").collect()
    assert [r["cluster"] for r in rows] == want.tolist()
    assert [r["is_core"] for r in rows] == core.tolist()


def test_density_token_minimum(spark):
    df = points(spark, np.zeros((6, 2))).withColumn("toks", F.array_repeat(F.lit("t"), F.col("id").cast("int")))
    out = density.density_clusters(df, "id", "vec", 1.0, 2, 2, min_tokens=3, tokens_col="toks").orderBy("id").collect()
    assert [r["cluster"] for r in out] == [-1, -1, -1, 3, 3, 3]


def test_components_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(1000, i) for i in range(1001, 1100)]
    out = components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert {r["node"]: r["component"] for r in out} == {**{i: 0 for i in range(71)}, **{i: 1000 for i in range(1000, 1100)}}


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), size=80)) for _ in range(12)]
    texts = []
    for i in range(120):
        words = base[0 if i % 3 == 0 else i % 12].split()  # a third of all texts are near copies of one
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 80))] = "edit"
        texts.append(" ".join(words))
    texts += ["", "short", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    tokens = tx.word_tokens(F.col("text"), 1)
    for block_rows in (7, 512):
        groups = dedupe.near_duplicate_groups(df, "id", tokens, 0.8, block_rows=block_rows)
        got = [r["group"] for r in groups.orderBy("id").collect()]
        sigs = dedupe.signatures(df, "id", tokens).orderBy("id").collect()
        sig = np.array([r["sig"] for r in sigs])
        linked = (sig[:, None] == sig[None]).mean(-1) >= 0.8
        label = np.arange(len(sig))
        for _ in range(len(sig)):
            label = np.where(linked, label[None], len(sig)).min(1)
        assert got == label.tolist()
    assert 12 < len(set(got)) < 60
    assert dedupe.drop_near_duplicates(df, "id", tokens).count() == len(set(got))


def test_signature_agreement_estimates_jaccard(spark):
    a, b = [f"t{i}" for i in range(300)], [f"t{i}" for i in range(100, 400)]
    df = spark.createDataFrame([(0, a), (1, b)], "id bigint, toks array<string>")
    s = [r["sig"] for r in dedupe.signatures(df, "id", F.col("toks"), 1, n_hashes=512).orderBy("id").collect()]
    assert abs((np.array(s[0]) == np.array(s[1])).mean() - 0.5) < 0.08
    with pytest.raises(ValueError, match="n_bands"):
        dedupe.near_duplicate_groups(df, "id", F.col("toks"), 0.5)


def test_nearest_centre_paths(spark, cloud):
    x, labels = cloud
    df = points(spark, x, labels)
    centres = cluster.mean_vectors(df, "cluster", "vec").select("cluster", "centre")
    values = sorted(set(labels))
    c = np.array([x[labels == v].mean(0) for v in values])
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1))
    for limit in (100, 2):
        out = cluster.nearest_centre(df.drop("cluster"), "vec", centres, "id", block=limit).orderBy("id").collect()
        assert [r["cluster"] for r in out] == [values[i] for i in d.argmin(1)]
        np.testing.assert_allclose([r["distance"] for r in out], d.min(1), atol=1e-7)


def test_pca_and_kmeans(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6)) * [5, 3, 1, 0.5, 0.2, 0.1] + 7
    df = points(spark, x).drop("cluster")
    model = cluster.fit_reducer(df, "vec", 2)
    z = np.array([r["reduced"] for r in cluster.reduce_vectors(df, model, "vec").orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(z), np.abs(u[:, :2] * s[:2]), atol=1e-6)

    fitted = cluster.EmbeddingClusterer.fit(df, "vec", k=3, pca_size=2, n_init=3)
    scored = {r["id"]: (r["cluster"], r["score"]) for r in fitted.predict(df, "id").collect()}
    assert {c for c, _ in scored.values()} == {0, 1, 2} and all(0 < s <= 1 for _, s in scored.values())
    fitted.save(str(tmp_path / "c"))
    again = cluster.EmbeddingClusterer.load(str(tmp_path / "c"), spark, "vec")
    assert {r["id"]: (r["cluster"], r["score"]) for r in again.predict(df, "id").collect()} == scored


def test_restarts_never_cost_more(spark, cloud):
    df = cluster.with_vector(points(spark, cloud[0]), "vec", "v").drop("cluster")
    one = cluster.fit_kmeans(df, "v", 5, n_init=1).summary.trainingCost
    assert cluster.fit_kmeans(df, "v", 5, n_init=4).summary.trainingCost <= one


def test_pooling_and_norms(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0], [0.0, 0.0]), ([[1.0, 2.0]], [0], [3.0, 4.0])],
        "h array<array<double>>, m array<int>, v array<double>",
    )
    rows = df.select(
        vectors.mean_pooling(F.col("h"), F.col("m")).alias("mean"),
        vectors.cls_pooling(F.col("h")).alias("cls"),
        vectors.l2_normalize(F.col("v"), vectors.l2_norm(F.col("v"))).alias("n"),
        vectors.clip01(F.lit(1.5)).alias("clip"),
    ).collect()
    assert [r["mean"] for r in rows] == [[2.0, 3.0], [0.0, 0.0]]
    assert [r["cls"] for r in rows] == [[1.0, 2.0], [1.0, 2.0]]
    assert [r["n"] for r in rows] == [[0.0, 0.0], [0.6, 0.8]]
    assert rows[0]["clip"] == 1.0


def test_assignment_rules(spark):
    scored = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.4), (3, 0, None), (4, 1, 0.9), (5, 2, 0.9), (6, None, 0.9)], "id int, cluster int, score double")
    meta = spark.createDataFrame([(0, "zero", ["a"], True, None), (1, "off", ["b"], False, None)], "cluster_id int, label string, top_words array<string>, is_active boolean, updated_at timestamp")
    rows = {r["id"]: (r["cluster_id"], r["cluster_label"], r["score"]) for r in assign.assign_topics(scored, meta, 0.5).collect()}
    assert rows == {
        1: (0, "zero", 0.5), 2: (None, "unknown", 0.4), 3: (0, "zero", None), 4: (None, "unknown", 0.9),
        5: (None, "unknown", 0.9), 6: (None, "unknown", 0.9),
    }
    assert assign.assign_topics(scored, meta).where("id = 2").first()["cluster_label"] == "zero"
    api = {r["id"]: (r["topic_label"], r["top_words"]) for r in assign.assign_topics_api(scored, meta).collect()}
    assert api[2] == ("zero", ["a"]) and api[5] == ("cluster_2", [])
    with pytest.raises(KeyError, match="no metadata"):
        assign.assign_topics_api(scored, meta, strict=True)


def test_agreement(spark):
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert metrics.adjusted_rand_index(same, "a", "b").first()[0] == 1.0
    constant = same.withColumn("b", F.lit(0))
    assert metrics.adjusted_rand_index(constant, "a", "b").first()[0] == 0.0


def test_kmeans_tfidf_makes_every_fit(spark, tmp_path, monkeypatch):
    from topicflow.plans.queries import QUERIES

    words = ["apple pear plum", "wheel road brake"]
    rows = [(i, words[i % 2]) for i in range(24)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], cluster.KMeans
    monkeypatch.setattr(cluster, "KMeans", lambda **o: made.append((o["seed"], o["maxIter"])) or real(**o))
    got = QUERIES["kmeans_tfidf"](spark, str(tmp_path)).collect()
    assert len(got) == 24 and all(r["in_range"] and r["equal_together"] for r in got)
    assert sorted(made) == [(42 + i, 300) for i in range(20)]


@pytest.mark.parametrize("sparse", [False, True])
def test_pairs_of_groups_give_every_distance_once(cloud, monkeypatch, sparse):
    import pyarrow as pa

    monkeypatch.setattr(metrics, "GROUP_CELLS", 40)  # sums are set out early
    x, labels = cloud
    x, labels = np.where(np.abs(x[:30]) < 0.5, 0, x[:30]), labels[:30].astype(np.int64)
    d = pairwise(x)

    def batch(rows, side):
        used = [np.flatnonzero(x[i]) if sparse else np.arange(x.shape[1]) for i in rows]
        columns = {"id": pa.array(rows), "vec": pa.array([x[i][u].tolist() for i, u in zip(rows, used)], pa.list_(pa.float64()))}
        columns |= {"cluster": pa.array(labels[rows])} | ({"idx": pa.array([(u * 10).tolist() for u in used], pa.list_(pa.int64()))} if sparse else {})
        return pa.RecordBatch.from_pydict(columns | {"_side": pa.array([side] * len(rows), pa.int32())})

    def sums(*batches):
        out = {}
        for part in metrics._pair_sums(4)(iter(batches)):
            for r in part.to_pylist():
                assert r["own"] == labels[r["id"]]
                out[r["id"], r["other"]] = out.get((r["id"], r["other"]), 0.0) + r["dist"]
        return out

    left, right = list(range(18)), list(range(18, 30))
    want = {(i, c): d[i, [j for j in o if labels[j] == c]].sum() for s, o in ((left, right), (right, left)) for i in s for c in set(labels[o])}
    assert sums(batch(left[:7], 0), batch(left[7:], 0), batch(right[:1], 1), batch(right[1:], 1)) == pytest.approx(want)
    want = {(i, c): d[i, [j for j in left if labels[j] == c]].sum() for i in left for c in set(labels[left])}
    assert sums(batch(left, 2)) == pytest.approx(want, abs=1e-6)


def test_silhouette_over_many_groups(spark, cloud):
    x, labels = cloud
    samples = metrics.silhouette_samples(points(spark, x, labels), "id", "vec", "cluster", block_rows=4)
    np.testing.assert_allclose(by_id(samples, "silhouette"), brute_silhouette(pairwise(x), labels), atol=1e-7)
    assert metrics.silhouette_samples(points(spark, x, labels).where("id < 0"), "id", "vec", "cluster").count() == 0
