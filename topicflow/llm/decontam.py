"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``window`` words. Their TF-IDF matrix, with document frequencies
counted over windows of the whole corpus, is decomposed by a distributed randomised SVD: tasks multiply their
passages with a random test matrix, Spark adds the parts up by term, and the driver orthonormalises a
matrix of vocabulary times ``rank``. Document windows are projected to the latent space and compared with all
passages by cosine. Candidates of at least ``near`` are verified on words:

* the longest common subsequence of the item's telling words (those in at most ``common`` of the windows) and
  the document's words around the window must cover ``lcs`` of the item,
* the answer check: of the item's ``answer_words`` rarest words a share of ``answer`` must be there too.

Both tolerate inserted, dropped and changed words, so paraphrases are found.

Documents are read twice, in narrow passes without a shuffle: once to count, once to search. The benchmark
is a stated query set: it is searched in blocks of about ``block`` items, and the bound of a block is what
limits vocabulary, latent vectors and broadcast. Windows are whole texts; nothing is capped.

Defined results: null, empty or wordless texts and items match nothing; an item with a null id is
reported under null; repeated rows are each searched; equal items are all reported; other columns are kept, one named ``leaks`` replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.lmscore import BLANKED

MATCH = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"
SEED = 17
CHUNK = 128  # terms per row of a partial product


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(BLANKED).split()


class Vocabulary:
    """Term numbers of the block's words, -1 for others."""

    def __init__(self, names: dict[bytes, int]):
        self.words = pa.array(list(names), pa.large_binary())

    def encode(self, column: pa.Array, step: int = 256) -> Iterator[np.ndarray]:
        """The term numbers of every text's ``words_of``, looked up for some texts at a time."""
        for at in range(0, len(column), step):
            plain = [(x or "").lower().encode().translate(BLANKED).strip() for x in column.slice(at, step).to_pylist()]
            lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).view(pa.large_string()))
            ends = lists.offsets.to_numpy()
            found = pc.index_in(lists.flatten().view(pa.large_binary()), value_set=self.words)
            ids = pc.fill_null(found, -1).to_numpy()
            for text, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
                yield ids[a:b] if text else ids[:0]  # nothing splits into one empty word


def passages(n: int, window: int) -> list[tuple[int, int]]:
    """Bounds of the half-overlapping windows of ``n`` words; the last one ends with the text."""
    step = window // 2
    starts = range(0, max(1, n - window + step), step)
    return [(s, min(n, s + window)) for s in starts]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit per position of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := row & at.get(x, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def frequencies(docs: DataFrame, text_col: str, vocabulary: dict[bytes, int], window: int) -> tuple[np.ndarray, int]:
    """In how many half windows of the corpus each term stands, and how many half windows there are."""
    size, half = len(vocabulary), window // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, parts = Vocabulary(vocabulary), np.zeros(size, np.int64), 0
        for batch in batches:
            for ids in own.encode(batch.column(0)):
                known = np.flatnonzero(ids >= 0)
                pairs = np.unique((known // half).astype(np.int64) * size + ids[known])
                seen += np.bincount(pairs % size, minlength=size) if size else 0
                parts += -(-len(ids) // half)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([parts, *seen[at].tolist()], pa.int64())], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found, total = np.zeros(size), 0
    for row in rows:  # one for each term of the block's vocabulary
        if row["term"] < 0:
            total = row["n"]
        else:
            found[row["term"]] = row["n"]
    return found, total


def randomised_svd(rows: DataFrame, weights: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the weighted term counts.

    ``rows`` has a column ``ids array<int>`` of term numbers per passage.
    """
    terms = len(weights)
    width = min(terms, rank + 8)

    def times(basis: np.ndarray) -> np.ndarray:
        """A^T A times ``basis``, summed over the tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((terms, width))
            for batch in batches:
                for ids in batch.column(0).to_pylist():
                    at, n = np.unique(np.array(ids, np.int64), return_counts=True)
                    value = n * weights[at]
                    norm = np.sqrt((value * value).sum())
                    if norm:
                        value = value / norm
                        out[at] += np.outer(value, value @ basis[at])
            for at in range(0, terms, CHUNK):
                part = out[at : at + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "v"])

        def add(parts: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py(), np.float64) for v in parts.column("v"))
            return pa.table({"at": parts.column("at")[:1], "v": pa.array([total.tobytes()], pa.binary())})

        summed = np.zeros((terms, width))
        for row in rows.select("ids").mapInArrow(run, "at long, v binary").groupBy("at").applyInArrow(add, "at long, v binary").collect():
            part = np.frombuffer(row["v"], np.float64).reshape(-1, width)
            summed[row["at"] : row["at"] + len(part)] = part
        return summed

    basis = np.random.default_rng(SEED).standard_normal((terms, width))
    for _ in range(2):
        basis = np.linalg.qr(times(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ times(basis))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    return basis @ vectors[:, keep]


@dataclass
class Block:
    """One block of benchmark items, ready to search with."""

    vocabulary: dict[bytes, int]
    latent: np.ndarray  # terms x rank, weighted: a window's latent vector is the sum of its words' rows
    telling: np.ndarray  # terms that count for the subsequence
    owner: np.ndarray  # item of every passage
    passage: np.ndarray  # unit latent vectors
    ids: list[int | None]
    items: list[np.ndarray]  # telling words of every item, in order
    lengths: list[int]
    answers: list[set[int]]


def prepare(
    docs: DataFrame, items: list[tuple[int | None, str | None]], text_col: str, window: int, rank: int, common: float, answer_words: int
) -> Block | None:
    spark = docs.sparkSession
    items = [(i, words_of(t)) for i, t in items]
    items = [(i, w) for i, w in items if w]
    if not items:
        return None
    names: dict[bytes, int] = {}
    for _, words in items:
        for word in words:
            names.setdefault(word, len(names))
    found, total = frequencies(docs, text_col, names, window)
    share = found / max(1, total)
    telling = share <= common
    coded = [np.array([names[w] for w in words]) for _, words in items]
    for own in coded:  # an item of common words only is searched by these
        if not telling[own].any():
            telling[own] = True
    weights = np.log((2 + total) / (1 + found)) * telling
    bounds = [(k, a, b) for k, c in enumerate(coded) for a, b in passages(len(c), window)]
    table = spark.createDataFrame([(coded[k][a:b].tolist(),) for k, a, b in bounds], "ids array<int>")
    vectors = randomised_svd(table, weights, rank)
    latent = (weights[:, None] * vectors).astype(np.float32)
    units = np.array([latent[coded[k][a:b]].sum(axis=0) for k, a, b in bounds])
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
    kept = [c[telling[c]] for c in coded]
    answers = [set(sorted(set(c.tolist()), key=lambda t: (found[t], t))[:answer_words]) for c in kept]
    return Block(names, latent, telling, np.array([k for k, _, _ in bounds]), units, [i for i, _ in items], kept, [len(c) for c in coded], answers)


def matches_in(ids: np.ndarray, block: Block, window: int, near: float, lcs: float, answer: float) -> list[tuple]:
    """``item_id, cosine, lcs, answer`` of the items that the document holds."""
    half, n = window // 2, len(ids)
    # other words weigh nothing
    at = np.flatnonzero(np.append(block.telling, False)[ids])
    if not len(at) or not block.latent.shape[1]:
        return []
    place = at // half
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    parts = np.zeros((-(-n // half), block.latent.shape[1]), np.float32)
    parts[place[first]] = np.add.reduceat(block.latent[ids[at]], first, axis=0)
    sums = parts[:-1] + parts[1:] if len(parts) > 1 else parts
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosine = sums @ block.passage.T
    best: dict[int, tuple[float, float, float]] = {}
    places: dict[int, list[tuple[int, float]]] = {}
    hits = np.flatnonzero(cosine >= near)
    spots, owners = hits // cosine.shape[1], block.owner[hits % cosine.shape[1]]
    for item, spot, value in zip(owners.tolist(), spots.tolist(), cosine.ravel()[hits].tolist(), strict=True):
        places.setdefault(item, []).append((spot, value))
    present = set(ids[at].tolist()) if places else set()
    for item, found in places.items():
        # what the whole document lacks, no window of it has
        if len(block.answers[item] & present) / len(block.answers[item]) < answer:
            continue
        want = block.items[item]
        need = set(want.tolist())
        for at, value in sorted(found, key=lambda x: -x[1]):
            margin = block.lengths[item]
            around = ids[max(0, at * half - margin) : at * half + window + margin]
            have = [x for x in around.tolist() if x in need]
            reached = block.answers[item] & set(have)
            given = len(reached) / len(block.answers[item])
            if given < answer or len(have) < lcs * len(want):
                continue
            common = common_subsequence(want.tolist(), have) / len(want)
            if common >= lcs and (item not in best or (common, given, value) > (best[item][1], best[item][2], best[item][0])):
                best[item] = (value, common, given)
                if common == 1.0:
                    break
    return [(block.ids[k], *v) for k, v in sorted(best.items())]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 64,
    rank: int = 256,
    near: float = 0.35,
    lcs: float = 0.6,
    answer: float = 0.6,
    common: float = 0.1,
    answer_words: int = 5,
    block: int = 2048,
) -> DataFrame:
    """``docs`` plus ``leaks``, an array of the items that the document holds."""
    docs = docs.drop("leaks")
    schema = docs.select("*", F.lit(None).cast(MATCH).alias("leaks")).schema
    at, names = docs.columns.index(text_col), [*docs.columns, "leaks"]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-items.count() // block))
    out = docs.withColumn("leaks", F.array().cast(MATCH))
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number)
        ready = prepare(docs, [(r["i"], r["t"]) for r in mine.collect()], text_col, window, rank, common, answer_words)
        if ready is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(ready)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            vocabulary = Vocabulary(own.vocabulary)
            for batch in batches:
                found = []
                for ids, before in zip(vocabulary.encode(batch.column(at)), batch.column(len(names) - 1).to_pylist(), strict=True):
                    new = matches_in(ids, own, window, near, lcs, answer)
                    found.append([*(before or []), *(dict(zip(("item_id", "cosine", "lcs", "answer"), m, strict=True)) for m in new)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=names)

        out = out.mapInArrow(run, schema)
    return out
