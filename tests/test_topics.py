import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.operators import coherence, features, metrics, topics
from topicflow.sources import artifacts

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        cluster = [0, 0, 1, 2][i % 4]
        pool = WORDS[cluster * 8 : cluster * 8 + 14]
        rows.append((i, cluster, " ".join(rng.choice(pool, size=rng.integers(1, 30)))))
    rows += [(200, 5, "alone"), (201, 6, "x y"), (202, 6, "x z"), (203, 6, "x y"), (204, -1, "noise noise")]
    return spark.createDataFrame(rows, "doc_id int, cluster int, text string").cache()


def local(docs):
    return [(r["doc_id"], r["cluster"], r["text"].split()) for r in docs.collect()]


def tfidf_scores(token_lists, min_df, max_df):
    n = len(token_lists)
    counts = [Counter(t) for t in token_lists]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items() if min_df <= d <= max_df * n}
    total = defaultdict(float)
    for c in counts:
        weights = {w: f * idf[w] for w, f in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        for w, x in weights.items():
            total[w] += x / norm
    return {w: x / n for w, x in total.items()}


def test_top_words_per_cluster(spark, docs):
    found = topics.top_words_per_cluster(docs, "doc_id", "cluster", tx.word_tokens(F.col("text"), 1), 6)
    got = defaultdict(list)
    for r in found.orderBy("cluster_id", "rank").collect():
        got[r["cluster_id"]].append((r["word"], round(r["score"], 9)))
    by_cluster = defaultdict(list)
    for _, c, toks in local(docs):
        by_cluster[c].append(toks)
    assert set(got) == {0, 1, 2}  # one and three documents leave no term, noise is skipped
    for c, ranked in got.items():
        scores = tfidf_scores(by_cluster[c], 3, 0.8)
        want = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:6]
        assert ranked == [(w, round(s, 9)) for w, s in want]
    packed = topics.topics_as_arrays(found, docs.where("cluster <> -1").select(F.col("cluster").alias("cluster_id")))
    words = {r["cluster_id"]: r["top_words"] for r in packed.collect()}
    assert words[5] == [] and words[6] == [] and words[0] == [w for w, _ in got[0]]


def test_tfidf_model_equals_long_form(spark, docs):
    grams = docs.withColumn("grams", tx.ngram_range(tx.word_tokens(F.col("text")), 1, 2))
    model = features.fit_tfidf(grams, "doc_id", "grams", 3, 0.5, 50)
    assert len(model.stages[0].vocabulary) == 50
    dense = model.transform(grams).select("doc_id", vector_to_array("features").alias("v")).collect()
    counts = features.term_counts(grams, ["doc_id"], F.col("grams"))
    vocab = features.vocabulary(counts, features.count_documents(docs), 3, 0.5, 50)
    long = features.tfidf_long(counts, vocab, features.count_documents(docs), "doc_id").collect()
    index = {w: i for i, w in enumerate(model.stages[0].vocabulary)}
    want = {r["doc_id"]: np.zeros(50) for r in dense}
    for r in long:
        want[r["doc_id"]][index[r["term"]]] = r["tfidf"]
    for r in dense:
        np.testing.assert_allclose(r["v"], want[r["doc_id"]], atol=1e-12)
        norm = np.linalg.norm(r["v"])
        assert norm == 0 or abs(norm - 1) < 1e-12


def test_model_round_trip(spark, docs, tmp_path):
    grams = docs.withColumn("grams", tx.word_tokens(F.col("text")))
    model = features.fit_tfidf(grams, "doc_id", "grams", 3, 0.5, 50)
    artifacts.save_model(model, str(tmp_path / "m"))
    again = artifacts.load_model(spark, str(tmp_path / "m"))
    assert again.transform(grams).select("features").collect() == model.transform(grams).select("features").collect()
    with pytest.raises(FileNotFoundError, match="missing"):
        artifacts.load_model(spark, str(tmp_path / "missing"))


def brute_cv(token_lists, topic_words, window):
    windows = []
    for toks in token_lists:
        n = max(len(toks) - window + 1, 1)
        windows += [set(toks[i : i + window]) for i in range(n)]
    n = len(windows)

    def p(*words):
        return sum(all(w in win for w in words) for win in windows) / n

    scores = []
    for words in topic_words:
        words = [w for w in words if p(w) > 0]
        if not words:
            continue
        m = np.array([[math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12) for b in words] for a in words])
        t = m.sum(axis=0)
        cos = [(v @ t) / (np.linalg.norm(v) * np.linalg.norm(t)) for v in m]
        scores.append(np.mean(cos))
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [1000, 1])
def test_coherence(spark, docs, block):
    lists = [["w0", "w1", "w9", "never"], ["w16", "w17", "w20"], ["w0", "w20"], ["never"]]
    rows = [(i, r, w, 1.0) for i, ws in enumerate(lists) for r, w in enumerate(ws)]
    table = spark.createDataFrame(rows, "cluster_id int, rank int, word string, score double")
    tokens = tx.space_tokens(F.col("text"))
    got = coherence.coherence_cv(docs, "doc_id", tokens, table, window=20, block=block).first()[0]
    assert got == pytest.approx(brute_cv([t for _, _, t in local(docs)], lists, 20), abs=1e-9)
    with pytest.raises(ValueError, match="no topics"):
        coherence.coherence_cv(docs, "doc_id", tokens, table.limit(0))


def test_diversity(spark):
    table = spark.createDataFrame([(0, 1, "a", 1.0), (0, 2, "b", 1.0), (1, 1, "a", 1.0), (1, 2, "c", 1.0)], "cluster_id int, rank int, word string, score double")
    assert metrics.topic_diversity(table).first()[0] == 0.75
    assert metrics.topic_diversity(table, 1).first()[0] == 0.5
    assert metrics.topic_diversity(table.limit(0)).first()[0] is None
    assert metrics.topic_diversity(table.limit(0), 10, 0.0).first()[0] == 0.0


def test_topics_json(spark, tmp_path):
    table = spark.createDataFrame([(1, 1, "б", 1.0), (1, 2, "a", 0.5), (0, 1, "c", 1.0)], "cluster_id int, rank int, word string, score double")
    artifacts.write_topics(table, str(tmp_path))
    rows = artifacts.read_topics_json(spark, str(tmp_path / "topics_json")).orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["label"], r["top_words"]) for r in rows] == [(0, "cluster_0", ["c"]), (1, "cluster_1", ["б", "a"])]


def test_coherence_empty_tasks(spark):
    # most of the 20 tasks hold no row, and some rows hold no topic word
    few = spark.createDataFrame([(0, "a b c"), (1, "a b"), (2, "zz")], "doc_id int, text string").repartition(20)
    table = spark.createDataFrame([(0, 1, "a", 1.0), (0, 2, "b", 1.0)], "cluster_id int, rank int, word string, score double")
    got = coherence.coherence_cv(few, "doc_id", tx.space_tokens(F.col("text")), table, window=5).first()[0]
    assert got == pytest.approx(brute_cv([["a", "b", "c"], ["a", "b"], ["zz"]], [["a", "b"]], 5), abs=1e-9)


def dense_overlaps(length, own, positions, words, window):
    starts = max(length - window + 1, 1)
    cover = np.zeros((words, starts), dtype=bool)
    for w, p in zip(own, positions):
        cover[w, max(0, p - window + 1) : min(p, starts - 1) + 1] = True
    c = cover.astype(np.int64)
    return c @ c.T


@pytest.mark.parametrize("seed", range(6))
def test_window_overlaps(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(1, 300))
    window = int(rng.integers(1, 40))
    k = int(rng.integers(1, 60))
    positions = rng.integers(0, length, k)
    own = rng.integers(0, 5, k)
    present, own = np.unique(own, return_inverse=True)
    got = coherence.window_overlaps(length, own, positions, len(present), window)
    assert (got == dense_overlaps(length, own, positions, len(present), window)).all()


def test_window_overlaps_long_text():
    # ten million tokens: memory follows the 200 000 positions, not 10^7 times the words
    rng = np.random.default_rng(0)
    positions = np.sort(rng.choice(10_000_000, 200_000, replace=False))
    own = rng.integers(0, 40, len(positions))
    got = coherence.window_overlaps(10_000_000, own, positions, 40, 110)
    assert got.shape == (40, 40) and (np.diag(got) >= got.max(axis=1)).all()


def test_sketch_drops_only_rare_terms(spark):
    rng = np.random.default_rng(2)
    common = [f"c{i}" for i in range(20)]
    rows = [(i, " ".join(list(rng.choice(common, 15)) + [f"rare{i}-{j}" for j in range(10)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    counts = features.term_counts(docs, ["doc_id"], tx.space_tokens(F.col("text")))
    n = F.lit(300)
    want = features.vocabulary(counts, n, min_df=3, max_df=0.9).collect()
    kept = features.surely_rare_filtered(counts, 3, width=1 << 16)
    assert features.vocabulary(kept, n, min_df=3, max_df=0.9).collect() == want and len(want) == 20
    # every rare term is gone before the exact count: far fewer rows and terms reach its shuffle
    assert kept.select("term").distinct().count() <= 25 < counts.select("term").distinct().count() // 2
    assert kept.count() == counts.where(~F.col("term").startswith("rare")).count()
