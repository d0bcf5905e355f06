"""End-to-end training runs: corpus → clusters → topics → metrics → artifacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.operators import cluster as cl
from topicflow.operators import coherence, corpus, density, embed, features, metrics, topics
from topicflow.session import cut_lineage, stored_table
from topicflow.sources import artifacts


def _scalar(df: DataFrame, name: str):
    return df.scalar().alias(name)


def _summary(
    clustered: DataFrame,
    model: str,
    samples: DataFrame,
    topic_rows: DataFrame,
    id_col: str,
    tokens,
    diversity_n: int | None,
    extra: dict,
) -> DataFrame:
    """One wide row with sizes, parameters and quality measures."""
    base = metrics.cluster_summary(clustered, "cluster")
    empty = None if diversity_n is None else 0.0
    return base.select(
        F.lit(model).alias("model"),
        "n_samples",
        "n_clusters_found",
        "noise_fraction",
        _scalar(metrics.mean_silhouette(samples), "silhouette_score"),
        _scalar(coherence.coherence_cv(clustered, id_col, tokens, topic_rows), "coherence"),
        _scalar(metrics.topic_diversity(topic_rows, diversity_n, empty), "topic_diversity"),
        *[F.lit(v).alias(k) for k, v in extra.items()],
    )


def _save(path: str | None, clustered: DataFrame, topic_rows: DataFrame, summary: DataFrame, run_id: str) -> None:
    if path is None:
        return
    clustered.write.mode("overwrite").parquet(f"{path}/clustered_news")
    artifacts.write_topics(topic_rows, path)
    artifacts.write_metrics(metrics.run_metrics(run_id, summary), path)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``stored_table``, also with columns that are only null and have no type, which Parquet cannot hold."""
    void = [c for c, kind in df.dtypes if kind == "void"]
    return stored_table(df.drop(*void), name).withColumns({c: F.lit(None) for c in void}).select(df.columns)


def run_tfidf(
    df: DataFrame,
    id_col: str,
    text_col: str | None = None,
    k: int = 8,
    min_df: int = 10,
    max_df: float = 0.5,
    max_features: int = 20000,
    seed: int = 42,
    n_init: int = 20,
    top_n: int = 10,
    artifacts_path: str | None = None,
    clean_options: dict | None = None,
) -> dict:
    """TF-IDF over 1- and 2-grams and k-means.

    By default content is built, filtered and cleaned; with ``text_col`` that
    column (for example lemmatized text) is used as it is, nulls as empty.
    """
    if text_col is None:
        docs = corpus.with_clean_text(corpus.drop_short(df), **(clean_options or {}))
        text_col = "clean_text"
    else:
        docs = df.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    # ids may be repeated or null: rows have numbers of their own
    docs = _stored(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    # the n-grams are several times the text: they are made again where needed, and never stored
    grammed = docs.withColumn("_grams", tx.ngram_range(tx.word_tokens(F.col(text_col)), 1, 2))
    model = features.fit_tfidf(grammed, "_row", "_grams", min_df, max_df, max_features)
    vectors = _stored(model.transform(grammed).drop("_tfidf", "_grams"), "vectors")
    kmeans = cl.fit_kmeans(vectors, "features", k, seed, n_init)
    labelled = kmeans.transform(vectors)
    clustered = labelled.drop("features", "_tf", "_row")
    n = features.count_documents(vectors)
    # the terms in use and their counts are in the vectors
    counts = features.vector_counts(labelled, ["_row", "cluster"], "_tf", model.stages[0].vocabulary)
    vocab = features.vocabulary(counts, n, min_df, max_df, max_features)
    weights = features.tfidf_long(counts, vocab, n, "_row").persist()
    topic_rows = cut_lineage(
        topics.top_words_centroid(weights, topics.cluster_sizes(clustered, "cluster"), "cluster", top_n)
    )
    sparse = features.sparse_rows(labelled.select("_row", "cluster"), weights, "_row")
    extra = {"n_clusters": k, "n_features": len(model.stages[0].vocabulary)}
    samples = metrics.silhouette_samples(sparse, "_row", "vec", "cluster", metrics.sparse_block_rows(extra["n_features"]), "idx")
    tokens = tx.space_tokens(F.col(text_col))
    summary = _summary(clustered, "tfidf_kmeans", samples, topic_rows, id_col, tokens, None, extra)
    if artifacts_path:
        artifacts.save_model(PipelineModel(stages=[*model.stages, kmeans]), f"{artifacts_path}/model")
    _save(artifacts_path, clustered, topic_rows, summary, "tfidf_kmeans")
    return {"data": clustered, "topics": topic_rows, "metrics": summary, "model": model, "kmeans": kmeans}


def run_embeddings(
    df: DataFrame,
    id_col: str,
    embeddings: DataFrame | None = None,
    topic_text_col: str = "text",
    k: int = 10,
    pca_size: int = 50,
    seed: int = 42,
    n_init: int = 20,
    top_n: int = 15,
    encoder_factory=None,
    artifacts_path: str | None = None,
    clean_options: dict | None = None,
    method: str = "kmeans",
    eps: float = 0.5,
    min_samples: int = 5,
    min_cluster_size: int = 20,
    silhouette: str = "exact",
) -> dict:
    """Embeddings, PCA and k-means, or density clustering with ``method="density"``.

    Without ``embeddings`` (``id, embedding``) the case-keeping cleaned content
    is encoded. Silhouette is measured on the embeddings themselves, over all
    pairs, or with ``silhouette="squared"`` by the linear squared form.
    """
    if method not in ("kmeans", "density") or silhouette not in ("exact", "squared"):
        raise ValueError("method is kmeans or density, silhouette is exact or squared")
    docs = corpus.drop_short(df)
    if embeddings is None:
        docs = corpus.with_clean_text(docs, out="text", needs_lower=False, **(clean_options or {}))
        docs = docs.where(F.length(F.col(topic_text_col).cast("string")) > 0)
        embeddings = embed.embed(docs, id_col, "text", encoder_factory)
    else:
        docs = docs.withColumn(topic_text_col, F.coalesce(F.col(topic_text_col).cast("string"), F.lit("")))
    joined = cut_lineage(embed.attach_embeddings(docs, cut_lineage(embeddings), id_col))
    if method == "density":
        clusterer, found = density.DensityClusterer.fit(joined, id_col, "embedding", eps, min_samples, min_cluster_size, pca_size)
        clustered = cut_lineage(joined.join(found.drop("is_core"), id_col))
    else:
        clusterer = cl.EmbeddingClusterer.fit(joined, "embedding", k, pca_size, seed, n_init)
        clustered = cut_lineage(clusterer.predict(joined, id_col))
    words = tx.word_tokens(F.col(topic_text_col), 1)
    topic_rows = cut_lineage(topics.top_words_per_cluster(clustered, id_col, "cluster", words, top_n))
    measure = metrics.silhouette_samples if silhouette == "exact" else metrics.silhouette_sq_samples
    samples = measure(clustered, id_col, "embedding", "cluster")
    width = len(joined.select("embedding").first()[0])
    extra = {"method": method, "embedding_dim": width, "use_pca": bool(pca_size), "pca_reducer_size": pca_size, "silhouette_form": silhouette}
    if method == "density":
        extra |= {"eps": eps, "min_samples": min_samples, "min_cluster_size": min_cluster_size}
    else:
        extra |= {"n_clusters_requested": k, "seed": seed, "n_init": n_init}
    tokens = tx.space_tokens(F.col(topic_text_col))
    name = f"embedding_{method}"
    summary = _summary(clustered, name, samples, topic_rows, id_col, tokens, min(10, top_n), extra)
    if artifacts_path:
        clusterer.save(f"{artifacts_path}/clusterer")
        artifacts.save_embeddings(clustered.select(F.col(id_col).alias("doc_id"), "embedding"), f"{artifacts_path}/embeddings")
    _save(artifacts_path, clustered.drop("embedding"), topic_rows, summary, name)
    return {"data": clustered, "topics": topic_rows, "metrics": summary, "clusterer": clusterer}


def test_weights(train: DataFrame, test: DataFrame, id_col: str, tokens, min_df: int = 10, max_df: float = 0.5, max_features: int = 20000) -> DataFrame:
    """``id, term, tfidf`` of ``test`` rows under the vocabulary and document frequencies of ``train``."""
    fitted = features.term_counts(train, [id_col], tokens)
    n = features.count_documents(train)
    vocab = features.vocabulary(fitted, n, min_df, max_df, max_features)
    return features.tfidf_long(features.term_counts(test, [id_col], tokens), vocab, n, id_col)


test_weights.__test__ = False  # not a pytest case


def seed_stability(df: DataFrame, id_col: str, vec_col: str, k: int, seeds: list[int], **options) -> DataFrame:
    """``seed_a, seed_b, adjusted_rand_index`` of k-means fits with different seeds."""
    labels = None
    for seed in seeds:
        fitted = cl.EmbeddingClusterer.fit(df, vec_col, k, seed=seed, **options)
        own = fitted.predict(df, id_col).select(id_col, F.col("cluster").alias(f"c{seed}"))
        labels = cut_lineage(own if labels is None else labels.join(own, id_col))
    parts = [
        metrics.adjusted_rand_index(labels, f"c{a}", f"c{b}").select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "*")
        for i, a in enumerate(seeds)
        for b in seeds[i + 1 :]
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_texts(texts: DataFrame, id_col: str, text_col: str, clusterer: cl.EmbeddingClusterer, encoder_factory=None) -> DataFrame:
    """``id, cluster, score`` of new texts: encode, reduce, nearest centre."""
    vectors = embed.embed(texts, id_col, text_col, encoder_factory)
    return clusterer.predict(vectors, id_col).select(id_col, "cluster", "score")
