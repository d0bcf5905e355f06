import numpy as np
import pytest

from topicflow.operators.cluster import EmbeddingClusterer
from topicflow.plans import train
from topicflow.sources import artifacts


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    pools = [
        "мир война армия фронт удар танк флот штаб полк граница солдат дрон ракета оборона".split(),
        "матч гол команда игра счёт тренер клуб лига кубок мяч ворота пенальти болельщик стадион".split(),
    ]
    rows = [(i, "заголовок", " ".join(rng.choice(pools[i % 2], size=12))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, title string, text string")


def test_tfidf_run(spark, corpus, tmp_path):
    path = str(tmp_path / "run")
    run = train.run_tfidf(corpus, "doc_id", k=2, min_df=5, max_df=0.6, n_init=2, artifacts_path=path)
    groups = run["data"].selectExpr("doc_id % 2 AS parity", "cluster").distinct().collect()
    assert len(groups) == 2 and len({r["cluster"] for r in groups}) == 2
    row = run["metrics"].first()
    assert row["n_samples"] == 60 and row["n_clusters_found"] == 2 and row["silhouette_score"] > 0.1
    saved = {r["metric"]: r["value"] for r in spark.read.parquet(f"{path}/run_metrics").collect()}
    assert saved["coherence"] == pytest.approx(row["coherence"])
    assert artifacts.read_topics_json(spark, f"{path}/topics_json").count() == 2
    model = artifacts.load_model(spark, f"{path}/model")
    assert len(model.stages) == 4


def test_embedding_run_and_scoring(spark, corpus, tmp_path):
    path = str(tmp_path / "run")
    run = train.run_embeddings(corpus, "doc_id", k=2, pca_size=5, n_init=2, top_n=4, artifacts_path=path)
    row = run["metrics"].first()
    assert row["n_clusters_found"] == 2 and row["embedding_dim"] == 256 and 0 < row["topic_diversity"] <= 1
    clusterer = EmbeddingClusterer.load(f"{path}/clusterer", spark)
    scored = train.score_texts(corpus, "doc_id", "text", clusterer)
    assert scored.selectExpr("doc_id % 2 AS p", "cluster").distinct().count() == 2
    assert train.score_texts(corpus.limit(0), "doc_id", "text", clusterer).count() == 0

    stored = artifacts.load_embeddings(spark, f"{path}/embeddings")
    again = train.run_embeddings(corpus, "doc_id", embeddings=stored, k=2, pca_size=5, n_init=2, top_n=4)
    assert again["data"].count() == 60


def test_density_run_saves_and_loads(spark, tmp_path):
    import numpy as np

    from topicflow.operators.density import DensityClusterer

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (3, 12))
    x = np.concatenate([rng.normal(c, 0.1, (25, 12)) for c in centres] + [rng.normal(0, 40, (5, 12))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id bigint, embedding array<double>")
    fitted, found = DensityClusterer.fit(df, "doc_id", "embedding", 2.0, 4, 10, pca_size=4)
    labels = {r["doc_id"]: r["cluster"] for r in found.collect()}
    assert [labels[i] for i in range(75)] == [0] * 25 + [25] * 25 + [50] * 25 and all(labels[i] == -1 for i in range(75, 80))
    fitted.save(str(tmp_path / "m"))
    again = DensityClusterer.load(str(tmp_path / "m"), spark)
    got = {r["doc_id"]: (r["cluster"], r["strength"]) for r in again.predict(df, "doc_id").collect()}
    assert {i: c for i, (c, _) in got.items()} == labels and got[0][1] == 1.0


def test_density_training_run(spark):
    words = ["apple pear plum grape".split(), "engine wheel road brake".split()]
    rows = [(i, "title", " ".join(w for j, w in enumerate(words[i % 2]) if j != i // 2 % 4)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    vectors = spark.createDataFrame([(i, [float(i % 2), i * 1e-3, 1.0]) for i in range(40)], "doc_id bigint, embedding array<double>")
    run = train.run_embeddings(
        docs, "doc_id", vectors, method="density", eps=0.5, min_samples=3, min_cluster_size=5, pca_size=2, silhouette="squared"
    )
    summary = run["metrics"].first()
    assert (summary["n_clusters_found"], summary["noise_fraction"], summary["method"], summary["eps"]) == (2, 0.0, "density", 0.5)
    assert summary["silhouette_score"] > 0.9 and summary["use_pca"]


def test_seed_stability(spark):
    rows = [(i, [float(i % 3) * 10, float(i % 7) * 0.01, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    got = train.seed_stability(df, "doc_id", "embedding", 3, [1, 2, 3], pca_size=2, n_init=3).collect()
    assert [(r["seed_a"], r["seed_b"]) for r in got] == [(1, 2), (1, 3), (2, 3)]
    assert all(r["adjusted_rand_index"] > 0.99 for r in got)


def test_tfidf_run_stores_no_ngrams_and_uses_large_blocks(corpus, monkeypatch):
    from topicflow.operators import metrics

    stored, blocks, cut, measure = [], [], train.cut_lineage, metrics.silhouette_samples
    monkeypatch.setattr(train, "cut_lineage", lambda df: stored.extend(df.columns) or cut(df))
    monkeypatch.setattr(metrics, "silhouette_samples", lambda *a: blocks.append(a[4]) or measure(*a))
    train.run_tfidf(corpus, "doc_id", k=2, min_df=5, max_df=0.6, n_init=1)
    assert "_grams" not in stored and blocks == [metrics.SPARSE_BLOCK]
    assert [metrics.sparse_block_rows(n) for n in (0, 500, 1024, 20000)] == [16384, 16384, 8192, 1024]


def test_tfidf_run_counts_its_terms_once_whatever_the_ids(corpus, monkeypatch):
    from pyspark.sql import functions as F

    counted, real = [], train.features.term_counts
    monkeypatch.setattr(train.features, "term_counts", lambda *a: counted.append(a[1]) or real(*a))
    options = {"k": 2, "min_df": 5, "max_df": 0.6, "n_init": 1}
    want = train.run_tfidf(corpus, "doc_id", **options)
    assert len(counted) == 1
    nameless = corpus.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("void", F.lit(None))
    got = train.run_tfidf(nameless, "doc_id", **options)
    assert got["metrics"].first()["silhouette_score"] == pytest.approx(want["metrics"].first()["silhouette_score"])
    assert got["data"].columns == [*nameless.columns, "content", "clean_text", "cluster"] and got["data"].count() == 60
