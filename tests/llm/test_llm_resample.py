"""Importance resampling against plain Python."""

import hashlib
import math
import zlib

import regex

from topicflow.llm import resample

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, bench, share=25, min_words=20, seed=7, buckets=10_000):
    def feats(text):
        words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return len(words), words + [a + " " + b for a, b in zip(words, words[1:])]

    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for f in feats(t)[1]:
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counts([x for _, x in docs]), counts(bench)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = {}
    for i, text in docs:
        n_words, fs = feats(text)
        w = math.floor(sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) / len(fs)) if fs else 0
        if i is None:
            out.setdefault(None, []).append((len(fs), w, None))
            continue
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = (n_words, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    eligible = sorted((k for k in out if k is not None and out[k][0] >= min_words), key=lambda k: (-out[k][3], k))
    ranks = {k: r + 1 for r, k in enumerate(eligible[: share * len(eligible) // 100])}
    return {k: (v[1], v[2], v[3], ranks.get(k)) for k, v in out.items() if k is not None}


def test_resample_brute(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vocab = ["alpha", "Beta", "gamma9", "délta", "ЖУК", "x", "Zeta-eta", "12", "q_r"]
    docs = [(i, " ".join(rng.choice(vocab, size=rng.integers(0, 60)))) for i in range(1, 120)]
    docs += [(200, None), (201, ""), (202, "!!! ,,, ..."), (203, "AbC " * 30), (204, "word " * 100_000)]
    bench = ["alpha beta gamma9 alpha beta", "ЖУК x", None, ""]
    want = brute(docs, bench)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", resample.F.lit("clash")).repartition(7)
    target = spark.createDataFrame([(b,) for b in bench], "text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resample.resample(frame, target).collect()}
    assert got == want
    assert sorted(v[3] for v in got.values() if v[3]) == list(range(1, 1 + sum(1 for v in got.values() if v[3])))


def test_resample_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c " * 10), (1, "a b c " * 10)], "doc_id long, text string")
    rows = sorted(resample.resample(docs, empty).collect(), key=lambda r: (r.doc_id is None, r.rank or 0))
    # repeated rows: equal scores, consecutive ranks (2 drawable rows, 25 % of them: none drawn)
    assert [r.rank for r in rows] == [None, None, None]
    assert rows[0].score == rows[1].score and rows[2].score is None and rows[2].n_features == 5


def test_features_kernels():
    import pyarrow as pa

    owner, bucket, n_words = resample.features(pa.array(["Ab cd", None, "", "x"]))
    assert n_words.tolist() == [2, 0, 0, 1]
    assert sorted(zip(owner.tolist(), bucket.tolist())) == sorted(
        [(0, zlib.crc32(b"ab") % 10_000), (0, zlib.crc32(b"cd") % 10_000), (0, zlib.crc32(b"ab cd") % 10_000), (3, zlib.crc32(b"x") % 10_000)]
    )
