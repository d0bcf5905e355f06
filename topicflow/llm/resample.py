"""Importance resampling towards a target distribution with hashed n-gram features and Arrow kernels.

Words are the runs of ``[0-9a-z]`` and non-ASCII characters of a text whose A-Z were lower-cased
(``pyarrow.compute.ascii_lower`` then ``split_pattern_regex`` on the complement). A text's features
are its words and its pairs of neighbouring words joined by one space, repeats counted. A feature's
bucket is the unsigned CRC-32 of its UTF-8 bytes modulo ``buckets``.

Inside a task a slice of texts is handled by whole-column kernels: ``list_flatten`` gives all words,
``dictionary_encode`` numbers the distinct ones, and a word's index next to the following word's
index (shifted by one, same text) names a pair. CRCs are computed once per distinct word and once per
distinct pair of indices, then ``take`` spreads buckets (and later gains) over the features and a
segment sum per text reduces them. Only per-bucket counts leave a task: at most ``buckets`` rows.

The corpus counts ``s`` (documents) and ``t`` (benchmark) per bucket, with totals ``S`` and ``T``,
give every bucket the gain ``floor(1000 * ln((t + 1) (S + B) / ((s + 1) (T + B))))`` with ``B`` the
number of buckets. A document's weight is the floored mean gain of its features, its score adds a
Gumbel key drawn from ``sha256("<seed>:<doc_id>")``, and ``share`` of the documents with at least
``min_words`` words are drawn by highest score (ties to smaller doc_id). Ranks are numbered over one
global sort, with each sorted partition's offset taken from the partition sizes: no task holds more
than its range of the sort.

Edge cases: a null or empty text has no words, weight 0 and is never drawn. A null doc_id gets its
features and weight, but a null score and rank and is not counted among the drawable documents.
Repeated rows are scored alike and take consecutive ranks. Other columns of the input are ignored, so
names that clash with the output do not matter. Empty tables give empty results (and no gains).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicflow.llm.common import stored

# fixed values of the contract: the word rule and the number of buckets
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
# texts of a task are cut into slices of about this many bytes, so memory does not follow batch size
SLICE_BYTES = 8 << 20


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of ``texts`` of about ``SLICE_BYTES`` (one very long text is its own slice)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, texts.slice(at, end - at)
        at = end


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, bucket, n_words)``: for every feature the index of its text and its bucket, and the
    number of words of every text."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    flat = pc.list_flatten(words)
    owner = pc.list_parent_indices(words)
    keep = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(keep), owner.filter(keep).to_numpy().astype(np.int64)
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    if not len(flat):
        return owner, np.zeros(0, np.int64), n_words
    encoded = pc.dictionary_encode(flat)
    index = encoded.indices.to_numpy().astype(np.int64)
    vocab = [w.encode() for w in encoded.dictionary.to_pylist()]
    word_bucket = np.fromiter((zlib.crc32(w) % buckets for w in vocab), np.int64, len(vocab))
    # a word and the next one of the same text: its dictionary index shifted by one
    paired = np.flatnonzero(owner[1:] == owner[:-1])
    keys = index[paired] * len(vocab) + index[paired + 1]
    distinct, back = np.unique(keys, return_inverse=True)
    pair_bucket = np.fromiter(
        (zlib.crc32(vocab[k // len(vocab)] + b" " + vocab[k % len(vocab)]) % buckets for k in distinct.tolist()),
        np.int64,
        len(distinct),
    )
    all_owner = np.concatenate([owner, owner[paired]])
    all_bucket = np.concatenate([word_bucket.take(index), pair_bucket.take(back)])
    return all_owner, all_bucket, n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features per bucket over all rows, summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                _, bucket, _ = features(part, buckets)
                totals += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(totals)
        if len(some):
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array(totals[some], pa.int64())], ["bucket", "n"])

    part = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, s, t, gain`` for every bucket (``buckets`` rows)."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text_col, buckets).withColumnRenamed("n", "s")
    t = bucket_counts(target, text_col, buckets).withColumnRenamed("n", "t")
    table = (
        spark.range(buckets)
        .withColumnRenamed("id", "bucket")
        .join(s, "bucket", "left")
        .join(t, "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    )
    whole = Window.partitionBy()  # over the ``buckets`` rows of this small table only
    big_s = F.sum("s").over(whole).cast("double")
    big_t = F.sum("t").over(whole).cast("double")
    ratio = ((F.col("t") + 1).cast("double") * (big_s + buckets)) / ((F.col("s") + 1).cast("double") * (big_t + buckets))
    return table.withColumn("gain", F.floor(F.lit(1000.0) * F.log(ratio)).cast("double"))


def document_weights(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, n_features, gain_sum`` per row of ``docs``."""
    gains = np.asarray(gains, dtype=np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, sums = [], [], []
            for _, part in _slices(batch.column(1)):
                owner, bucket, words = features(part, len(gains))
                n_words.append(words)
                n_features.append(np.bincount(owner, minlength=len(part)).astype(np.int64))
                sums.append(np.bincount(owner, weights=gains.take(bucket), minlength=len(part)))
            if not n_words:
                continue
            yield pa.record_batch(
                [batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_features)), pa.array(np.concatenate(sums))],
                ["doc_id", "n_words", "n_features", "gain_sum"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, gain_sum double")


def gumbel(doc_id, seed: int = 7):
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))`` with ``h`` the first 32 bits of ``sha256("<seed>:<doc_id>")``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("double")


def numbered(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``_rank`` 1, 2, 3 ... in ``order``: a global sort, written once, and each partition's
    offset from the sizes of the partitions before it."""
    marked = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    marked = stored(marked, "numbered")  # fixes the ids of one evaluation of the sort
    part = F.shiftright("_mid", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per sorted partition: a small table
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    inside = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_rank", F.col("_offset") + inside + 1)
        .drop("_part", "_offset", "_mid")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    share: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null for
    documents not drawn. ``share`` is in percent of the documents with at least ``min_words`` words."""
    gains_table = bucket_gains(docs.select(text_col), target.select(F.col(target_text).alias(text_col)), text_col, buckets)
    # exactly ``buckets`` numbers: a bounded table that travels with the tasks
    gains = np.zeros(buckets)
    for row in gains_table.select("bucket", "gain").toLocalIterator():
        gains[row["bucket"]] = row["gain"]
    weighed = document_weights(docs, gains, id_col, text_col)
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain_sum") / F.col("n_features"))).otherwise(0).cast("long")
    scored = weighed.select(
        "doc_id", "n_words", "n_features", weight.alias("weight"), (weight.cast("double") + gumbel(F.col("doc_id"), seed)).alias("_score")
    )
    eligible = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    scored = stored(scored.withColumn("_eligible", eligible), "resample-scores")
    n = scored.where("_eligible").count()
    draw = share * n // 100
    ranked = numbered(scored.where("_eligible"), [F.col("_score").desc(), F.col("doc_id").asc()])
    ranked = ranked.withColumn("rank", F.when(F.col("_rank") <= draw, F.col("_rank")))
    rest = scored.where(~F.col("_eligible")).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.drop("_rank").unionByName(rest)
    return out.select(
        "doc_id", "n_words", "n_features", "weight", F.col("_score").cast("long").alias("score"), F.col("rank").cast("long")
    )
