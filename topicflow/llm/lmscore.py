"""Cross-entropy difference of two matched n-gram models.

The background model counts all documents, the target model those a caller marks as wanted. Words, contexts
and pairs of adjacent words are counted exactly, under 64-bit hashes. Probabilities are interpolated,

    p(w) = (c(w) + alpha) / (n + alpha * classes)
    p(w | u) = (c(u, w) + mu * p(w)) / (c(u) + mu)

with as many classes as the documents have different words, at least ``words``. A document's score is the
mean over its tokens of the target loss minus the background loss: below 0 is closer to the target.

Documents are dealt by id to blocks of about ``BLOCK`` bytes of text. A block counts its different words,
contexts and pairs and sends their sorted hashes, cut into as many ranges as there are blocks, with the counts;
a range sums them over all blocks and sends every block its sums in the order of the block's hashes, where the
texts are scored. So the model is spread over ranges, grows with the corpus and is held nowhere as a whole; a
hash is sent at most once by a block, however often it occurs, and only counts come back. Nothing but the
number of words and bytes is brought to the driver.

Defined results: words are lower-cased runs of letters and digits; null, empty or wordless texts have 0
tokens and null losses; repeated rows count repeatedly; without target documents the target model is
uniform; ids and texts are kept, in columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import WordHashes, mix, stored, texts_of

WORDS, PAIRS = 1 << 18, 1 << 20
BLOCK, BLOCKS = 8 << 20, 96
ALPHA, MU = 0.1, 4.0
START = np.uint64(0x9E3779B97F4A7C15)
WORD, CONTEXT, PAIR = (np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0xC2B2AE3D27D4EB4F))
TOTAL = np.uint64(0)  # the key under which all tokens are counted
BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def token_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of((text or "").lower().encode().translate(BLANKED).split())


def keys(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of every token as a word, of its predecessor as a context, and of the pair; texts begin at ``starts``."""
    before = np.concatenate([[START], tokens[:-1]])[: len(tokens)]
    before[starts] = START
    return tuple(x.view(np.int64) for x in (mix(tokens ^ WORD), mix(before ^ CONTEXT), mix(before * PAIR + tokens)))


def tokens_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed tokens of all texts in a row, and the number of each text."""
    hashes = WordHashes()
    found = [token_hashes(t, hashes) for chunk in texts.chunks for t in texts_of(chunk)]
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.array([len(t) for t in found], np.int64)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes)[sizes > 0]


def pack_hashes(sorted_hashes: np.ndarray) -> bytes:
    """Differences of sorted hashes, their lowest bytes first, so that the upper ones, mostly 0, compress."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_hashes(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count; 255 stands for one of the larger ones, which follow a length as 64-bit numbers."""
    large = counts[counts >= 255].astype("<i8")
    return np.int64(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    small = np.frombuffer(packed, np.uint8, n, 8)
    counts = small.astype(np.int64)
    counts[small == 255] = np.frombuffer(packed, "<i8", -1, 8 + n)
    return counts


def hashes_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of all tokens, contexts, pairs and of the total, sorted, and where each of these is in them."""
    every = [x.view(np.uint64) for x in keys(tokens, starts_of(sizes))]
    return np.unique(np.concatenate([*every, np.full(min(len(tokens), 1), TOTAL)]), return_inverse=True)


def sums_of_range(sent: pa.Table) -> pa.Table:
    """For each block's hashes of one range, the sums over all blocks."""
    hashes = [unpack_hashes(p) for p in sent.column("hashes").to_pylist()]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum([len(h) for h in hashes])[:-1]
    out = {"_block": sent.column("_block"), "_range": sent.column("_range")}
    for name in ("t", "b"):
        counts = np.concatenate([unpack_counts(p) for p in sent.column(name).to_pylist()])
        sums = np.bincount(at, counts).astype(np.int64)[at]  # exact below 2 ** 53
        out[name] = pa.array([pack_counts(x) for x in np.split(sums, ends)], pa.binary())
    return pa.table(out)


def extent(docs: DataFrame, text_col: str, pairs: int) -> tuple[int, int]:
    """How many different words the texts have, and how many bytes."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, size = WordHashes(), 0
        seen: set[int] = set()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen, np.uint64, len(seen)).view(np.int64))], names=["word"])
        sizes = lambda: pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([size], pa.int64())], names=["word", "size"])
        for batch in batches:
            for text in texts_of(batch.column(0)):
                size += len((text or "").encode())
                seen.update(token_hashes(text, hashes).tolist())
                if len(seen) >= pairs:
                    yield rows().append_column("size", pa.nulls(len(seen), pa.int64()))
                    seen.clear()
        yield rows().append_column("size", pa.nulls(len(seen), pa.int64()))
        yield sizes()

    sums = docs.select(text_col).mapInArrow(words, "word long, size long").groupBy("word").agg(F.sum("size").alias("size"))
    row = sums.agg(F.count("word").alias("n"), F.sum("size").alias("size")).first()
    return row["n"], row["size"] or 0


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, pairs: int = PAIRS
) -> DataFrame:
    """Ids and texts of ``docs`` plus ``n_tokens, target_loss, background_loss, loss_difference``.

    The target model is of those whose id is in ``target_ids``. ``words`` is the least number of classes that
    smoothing shares out; ``pairs`` bounds only what a task holds before it passes it on.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType
    wanted = target_ids.select(F.col(id_col).cast(kind).alias("_id")).where("_id is not null").distinct()
    vocabulary, size = extent(docs, "_text", pairs)
    blocks = max(BLOCKS, -(-size // BLOCK))
    classes = max(words, vocabulary)
    by_id = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    # ids that are null are nobody's target and may be dealt by text
    dealt = docs.withColumn("_block", F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("_text"), F.lit(blocks)).cast("int")).otherwise(by_id))
    marks = stored(wanted.withColumn("_block", by_id), "target-ids")

    def count(texts: pa.Table, targets: pa.Table) -> pa.Table:
        tokens, sizes = tokens_of(texts.column("_text"))
        chosen = set(targets.column("_id").to_pylist())
        target = np.repeat(np.array([i in chosen for i in texts.column("_id").to_pylist()], bool), sizes)
        unique, at = hashes_of(tokens, sizes)
        marked = np.concatenate([target, target, target])
        t = np.bincount(at[: len(marked)][marked], minlength=len(unique))
        b = np.bincount(at, minlength=len(unique))
        if len(tokens):
            t[at[-1]], b[at[-1]] = target.sum(), len(tokens)
        of_range = ((unique >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        numbers, first = np.unique(of_range, return_index=True)
        cut = lambda x, pack: pa.array([pack(part) for part in np.split(x, first[1:])][: len(numbers)], pa.binary())
        block = texts.column("_block")[0].as_py() if texts.num_rows else 0
        columns = [pa.array(np.full(len(numbers), block, np.int32)), pa.array(numbers.astype(np.int32)), cut(unique, pack_hashes), cut(t, pack_counts), cut(b, pack_counts)]
        return pa.Table.from_arrays(columns, names=["_block", "_range", "hashes", "t", "b"])

    texts = dealt.groupBy("_block")
    counted = texts.cogroup(marks.groupBy("_block")).applyInArrow(count, "_block int, _range int, hashes binary, t binary, b binary")
    sums = counted.groupBy("_range").applyInArrow(sums_of_range, "_block int, _range int, t binary, b binary")

    def losses(texts: pa.Table, model: pa.Table) -> pa.Table:
        tokens, sizes = tokens_of(texts.column("_text"))
        order = np.argsort(model.column("_range").to_numpy())
        _, at = hashes_of(tokens, sizes)
        w, u, p = np.split(at[: 3 * len(tokens)], 3)
        some, number = sizes > 0, np.repeat(np.arange(len(sizes)), sizes)
        means = []
        for name in ("t", "b"):
            sent = model.column(name).to_pylist()
            n = np.concatenate([np.zeros(0), *(unpack_counts(sent[i]) for i in order)])
            total = n[at[-1]] if len(tokens) else 0.0
            single = (n[w] + ALPHA) / (total + ALPHA * classes)
            loss = np.log(n[u] + MU) - np.log(n[p] + MU * single)
            means.append(np.bincount(number, loss, len(sizes)) / np.maximum(sizes, 1))
        cols = [pa.array(x, pa.float64(), mask=~some) for x in (*means, means[0] - means[1])]
        return pa.Table.from_arrays(
            [texts.column("_id"), texts.column("_text"), pa.array(sizes), *cols],
            names=[id_col, text_col, "n_tokens", "target_loss", "background_loss", "loss_difference"],
        )

    extra = [("n_tokens", "long"), ("target_loss", "double"), ("background_loss", "double"), ("loss_difference", "double")]
    named = docs.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col))
    schema = named.select("*", *(F.lit(None).cast(k).alias(n) for n, k in extra)).schema
    return texts.cogroup(sums.groupBy("_block")).applyInArrow(losses, schema)
