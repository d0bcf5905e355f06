"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences. A sentence is toxic with probability ``p = sigmoid(bias + weights of its
words)``, and the document if any sentence is (noisy-or): ``1 - prod(1 - p)``. Weights are learned from
document labels alone, by gradient descent on the likelihood of the bags; afterwards the sentence
probabilities tell where the offence is.

Words count as themselves and by their first letters (3 to 6), so that inflected forms share weight.
Training: a bounded sample of ``sample`` labelled documents for each class, chosen by a hash of their id.
From it, a distributed count finds the ``features`` word forms that tell the classes apart best
(likelihood ratio); the sentences in terms of these are fitted on the driver (both bounds are parameters).
Scoring is one narrow pass over all documents.

Defined results: a null or empty text, or one without letters, is one sentence without words and has the
probability of the bias; a document with several labels is toxic if one of them says so; rows with null
labels or ids are not used in training; repeated rows get equal scores; without any label of one
of the classes every score is that share of toxic labels (0 if there are none); other columns are kept,
those with the name of a result column replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import texts_of

TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]+")
PREFIXES = (3, 4, 5, 6)
CACHED_WORDS = 200_000


def forms(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return ["=" + word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]


def sentences(text: str | None) -> list[list[str]]:
    """Words of every sentence that has words."""
    out: list[list[str]] = [[]]
    for token in TOKENS.findall((text or "").lower()):
        if token[0].isalpha():
            out[-1].append(token)
        else:
            out.append([])
    return [s for s in out if s]


@dataclass
class Model:
    """Weights by word form, the bias, and the words' sums seen so far."""

    weights: dict[str, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        value = self.cache.get(word)
        if value is None:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            value = self.cache[word] = sum(self.weights.get(f, 0.0) for f in forms(word))
        return value

    def logits(self, text: str | None) -> np.ndarray:
        """One logit per sentence; the bias alone for a text without words."""
        tokens = TOKENS.findall((text or "").lower())
        if not tokens:
            return np.array([self.bias])
        ends = np.fromiter((not t[0].isalpha() for t in tokens), bool, len(tokens))
        value = np.fromiter(map(self.word, tokens), float, len(tokens))
        value[ends] = 0.0
        place = np.cumsum(ends)
        have = np.bincount(place[~ends], minlength=place[-1] + 1) > 0
        sums = np.bincount(place, weights=value, minlength=place[-1] + 1)[have]
        return sums + self.bias if len(sums) else np.array([self.bias])

    def score(self, text: str | None) -> tuple[float, int, int, float]:
        """Document score, sentences, and the worst sentence with its probability."""
        z = self.logits(text)
        worst = int(z.argmax())
        score = -np.expm1(-np.logaddexp(0, z).sum())
        return float(score), len(z), worst, float(1 / (1 + np.exp(-z[worst])))


def training_sample(docs: DataFrame, labels: DataFrame, use: Column, id_col: str, text_col: str, sample: int) -> DataFrame:
    """``text, toxic`` of at most ``sample`` documents of either class, by smallest hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).where(use)
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max("toxic") > 0).alias("toxic"))
    order = [F.xxhash64(F.lit(5), "_id"), F.col("_id")]
    parts = [known.where(F.col("toxic") == flag).orderBy(*order).limit(sample) for flag in (True, False)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("text", "toxic")


def select_features(train: DataFrame, positive: int, negative: int, features: int) -> list[str]:
    """Word forms with the largest likelihood ratio between the classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for s in sentences(text) for w in s}
                seen[toxic].update({f for w in words for f in forms(w)})
        names = list(seen[True] | seen[False])
        cols = [pa.array(names, pa.string()), *(pa.array([seen[c][n] for n in names], pa.int64()) for c in (True, False))]
        yield pa.RecordBatch.from_arrays(cols, names=["form", "a", "b"])

    counts = train.mapInArrow(count, "form string, a long, b long").groupBy("form").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b, n, m = F.col("a"), F.col("b"), F.lit(float(positive)), F.lit(float(negative))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = (a + b) / (n + m)
    ratio = part(a, n * rate) + part(b, m * rate) + part(n - a, n * (1 - rate)) + part(m - b, m * (1 - rate))
    best = counts.where("a + b >= 3").withColumn("ratio", 2 * ratio).where("ratio > 10.83")
    return [r["form"] for r in best.orderBy(F.desc("ratio"), "form").limit(features).collect()]


@dataclass
class Bags:
    """The sample in terms of the chosen features, one after another."""

    toxic: np.ndarray  # of every document
    plain: np.ndarray  # its sentences without features
    bag: np.ndarray  # document of every other sentence
    sentence: np.ndarray  # sentence of every feature
    feature: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[bool, int, list[list[int]]]]) -> Bags:
        """From label, plain sentences and features of the other sentences of every document."""
        some = [s for r in rows for s in r[2]]
        return cls(
            np.array([r[0] for r in rows], float),
            np.array([r[1] for r in rows], float),
            np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]),
            np.repeat(np.arange(len(some)), [len(s) for s in some]),
            np.array([f for s in some for f in s], np.int64),
        )

    @classmethod
    def joined(cls, parts: list[Bags]) -> Bags:
        docs = np.cumsum([0, *(len(p.toxic) for p in parts)])
        rows = np.cumsum([0, *(len(p.bag) for p in parts)])
        pick = lambda name, shift: np.concatenate([np.zeros(0, np.int64), *(getattr(p, name) + k for p, k in zip(parts, shift))])
        none = [0] * len(parts)
        return cls(pick("toxic", none), pick("plain", none), pick("bag", docs), pick("sentence", rows), pick("feature", none))


def bags(train: DataFrame, names: list[str]) -> Bags:
    """The sampled documents as numbers: a few packed arrays per batch reach the driver."""
    index = {n: i for i, n in enumerate(names)}
    kinds = {"toxic": np.float32, "plain": np.int32, "bag": np.int32, "sentence": np.int32, "feature": np.int32}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [[index[f] for w in s for f in forms(w) if f in index] for s in sentences(text)] or [[]]
                some = [f for f in found if f]
                rows.append((toxic, len(found) - len(some), some))
            own = Bags.of(rows)
            cols = [pa.array([getattr(own, n).astype(k).tobytes()], pa.binary()) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(cols, names=list(kinds))

    schema = ", ".join(f"{n} binary" for n in kinds)
    got = train.mapInArrow(run, schema).collect()
    return Bags.joined([Bags(**{n: np.frombuffer(r[n], k) for n, k in kinds.items()}) for r in got])


def fit(sample: Bags, names: list[str], steps: int = 400, ridge: float = 0.02) -> Model:
    """Weights that make the labels likeliest under noisy-or, by Adam with a ridge penalty."""
    y, plain, bag, sent, feat = sample.toxic, sample.plain, sample.bag, sample.sentence, sample.feature
    w, n = np.zeros(len(names) + 1), len(y)
    w[-1] = -5.0
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sent, w[feat], len(bag))
        p, p0 = (1 + np.tanh(z / 2)) / 2, (1 + np.tanh(w[-1] / 2)) / 2
        total = np.bincount(bag, np.logaddexp(0, z), n) + plain * np.logaddexp(0, w[-1])
        # derivative of the loss by the sum of softplus of a bag
        slope = (1 - y) - y / np.expm1(np.clip(total, 1e-12, 700))
        by_sentence = slope[bag] * p
        grad = np.append(np.bincount(feat, by_sentence[sent], len(names)), by_sentence.sum() + (slope * plain * p0).sum())
        grad[:-1] += ridge * n * 0.01 * w[:-1]
        grad /= n
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))


def train_model(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 6000,
    features: int = 4096,
) -> Model:
    """Fit on the labelled documents for which ``use`` (over ``labels``) holds."""
    train = training_sample(docs, labels, use, id_col, text_col, sample).cache()
    try:
        sizes = defaultdict(int, {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()})
        if not sizes[True] or not sizes[False]:
            return Model({}, 40.0 if sizes[True] else -40.0)
        names = select_features(train, sizes[True], sizes[False], features)
        return fit(bags(train, names), names)
    finally:
        train.unpersist()


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``toxic_score, n_sentences, worst_sentence, worst_score``; narrow, no shuffle."""
    weights, bias = model.weights, model.bias
    new = "toxic_score double, n_sentences int, worst_sentence int, worst_score double".split(", ")
    docs = docs.drop(*(n.split()[0] for n in new))
    fields = docs.select("*", *(F.lit(None).cast(n.split()[1]).alias(n.split()[0]) for n in new)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for batch in batches:
            scored = [own.score(t) for t in texts_of(batch.column(at))]
            cols = list(zip(*scored, strict=True)) if scored else [[]] * 4
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.float64())
            more = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(n.split()[0] for n in new)])

    return docs.mapInArrow(run, fields)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Every third document by the checksum of its id."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1
