"""Topic coherence c_v over sliding windows (Röder, Both and Hinneburg, 2015).

Windows of ``window`` tokens slide by one over each document; a shorter document
is one window. From the shares of windows holding a word or a pair follow NPMI
values; each topic word's vector of NPMI to all words of its topic is compared
by cosine with the sum of these vectors, and all cosines are averaged per topic
and then over topics.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.session import cut_lineage

EPS = 1e-12
# topics that are counted in one pass over the documents
TOPIC_BLOCK = 1000


def _pair_keys(topic_rows: list) -> tuple[list[str], np.ndarray]:
    """Distinct words, and the sorted keys ``i * n + j`` (i <= j) of word pairs that share a topic."""
    by_topic = defaultdict(set)
    for row in topic_rows:
        by_topic[row["cluster_id"]].add(row["word"])
    words = sorted(set().union(*by_topic.values()))
    index, parts = {w: i for i, w in enumerate(words)}, []
    for own in by_topic.values():
        at = np.sort(np.array([index[w] for w in own], dtype=np.int64))
        i, j = np.triu_indices(len(at))
        parts.append(at[i] * len(words) + at[j])
    return words, np.unique(np.concatenate(parts))


def window_overlaps(length: int, own: np.ndarray, positions: np.ndarray, words: int, window: int) -> np.ndarray:
    """``words x words`` numbers of windows (of ``window`` tokens, sliding by one over ``length``
    tokens; a shorter text is one window) that hold both words; the diagonal holds single counts.

    Word ``own[k]`` sits at ``positions[k]``. The windows over a position start in one interval;
    a word's intervals are merged, and two words' common windows are the intersections of their
    interval lists, found through each word's covered length up to any start. Memory follows the
    number of positions, not the text length times the words."""
    starts = max(length - window + 1, 1)
    lo = np.maximum(0, positions - window + 1)
    hi = np.minimum(positions, starts - 1) + 1  # half-open
    # per word, intervals in order, on a line where words lie apart
    span = starts + 1
    order = np.lexsort((lo, own))
    word, lo, hi = own[order], lo[order] + own[order] * span, hi[order] + own[order] * span
    reach = np.maximum.accumulate(hi)
    fresh = np.ones(len(lo), dtype=bool)
    fresh[1:] = lo[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    m_word, m_lo = word[first], lo[first]
    m_hi = np.maximum.reduceat(hi, first) if len(first) else hi[:0]
    # back to each word's own starts
    m_lo, m_hi = m_lo - m_word * span, m_hi - m_word * span
    bounds = np.searchsorted(m_word, np.arange(words + 1))
    out = np.zeros((words, words), dtype=np.int64)
    for a in range(words):
        s, e = m_lo[bounds[a] : bounds[a + 1]], m_hi[bounds[a] : bounds[a + 1]]
        done = np.concatenate([[0], np.cumsum(e - s)])

        def covered(t: np.ndarray) -> np.ndarray:
            k = np.searchsorted(s, t, side="left")
            over = np.where(k > 0, np.maximum(e[np.maximum(k - 1, 0)] - t, 0), 0)
            return done[k] - over

        inter = covered(m_hi) - covered(m_lo)
        out[a] = np.bincount(m_word, weights=inter, minlength=words).astype(np.int64)
    return out


def _count_in_tasks(tokens: DataFrame, topic_rows: list, window: int) -> DataFrame:
    """``word_a, word_b, n`` (equal words: single counts), summed per task first.

    Of a document only the positions of topic words go to Python. There each word
    becomes the 0/1 vector of the window starts that reach it, and one matrix
    product counts the common windows of all its pairs.
    """
    words, keys = _pair_keys(topic_rows)
    hits = F.filter(
        F.transform("_tokens", lambda t, i: F.struct(t.alias("w"), i.alias("p"))), lambda s: s["w"].isin(words)
    )
    # no filter on empty hits here: it would be pushed down and find all hits twice
    pruned = tokens.select(F.size("_tokens").alias("len"), hits.alias("hits")).select(
        "len", F.col("hits.w").alias("w"), F.col("hits.p").alias("p")
    )
    index = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for length, ws, ps in zip(batch["len"], batch["w"], batch["p"]):
                if not len(ws):
                    continue
                present, own = np.unique([index[w] for w in ws], return_inverse=True)
                common = window_overlaps(int(length), own, np.asarray(ps, dtype=np.int64), len(present), window)
                i, j = np.triu_indices(len(present))
                wanted = present[i] * len(words) + present[j]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                known = keys[at] == wanted
                np.add.at(totals, at[known], common[i, j][known].astype(np.int64))
        some = np.flatnonzero(totals)
        if not len(some):  # an empty task (or one without topic words) adds nothing
            return
        a, b = keys[some] // len(words), keys[some] % len(words)
        yield pd.DataFrame(
            {
                "word_a": pd.Series([words[x] for x in a], dtype=object),
                "word_b": pd.Series([words[x] for x in b], dtype=object),
                "n": totals[some],
            }
        )

    partial = pruned.mapInPandas(count, "word_a string, word_b string, n bigint")
    return partial.groupBy("word_a", "word_b").agg(F.sum("n").alias("n"))


def _npmi(joint: Column, pa: Column, pb: Column) -> Column:
    p = joint + EPS
    value = F.log(p / (pa * pb)) / -F.log(p)
    return F.when((pa == 0) | (pb == 0), F.lit(0.0)).otherwise(value)


def window_counts(
    docs: DataFrame, id_col: str, tokens: Column, topics: DataFrame, window: int = 110, block: int = TOPIC_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Word and pair counts, and the one-row number of windows ``n_windows``.

    Topics, a top-n report with few words each, are taken in blocks of about
    ``block``; each block's words travel with the tasks of one pass.
    """
    listed = docs.select(F.col(id_col).alias("_id"), tokens.alias("_tokens"))
    total = listed.agg(
        F.sum(F.greatest(F.size("_tokens") - (window - 1), F.lit(1)).cast("bigint")).alias("n_windows")
    )
    known = topics.where(F.col("word").isNotNull()).select("cluster_id", "word")
    blocks = max(1, -(-known.select("cluster_id").distinct().count() // block))
    counts = docs.sparkSession.createDataFrame([], "word_a string, word_b string, n bigint")
    for number in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == number).collect()
        if rows:
            counts = counts.unionByName(_count_in_tasks(listed, rows, window))
    # a pair of two blocks has the same count in both
    return (counts.distinct() if blocks > 1 else counts), total


def coherence_by_topic(
    docs: DataFrame,
    id_col: str,
    tokens: Column,
    topics: DataFrame,
    window: int = 110,
    block: int = TOPIC_BLOCK,
) -> DataFrame:
    """``cluster_id, coherence``. Words that never occur in the documents are
    left out of their topic, and a topic without any known word is left out."""
    counts, total = window_counts(docs, id_col, tokens, topics, window, block)
    # one row per word pair of a topic, used several times below
    counts = cut_lineage(counts)
    n = total.scalar()
    single = counts.where("word_a = word_b").select(F.col("word_a").alias("word"), (F.col("n") / n).alias("p"))
    words = topics.select("cluster_id", "word").distinct().join(single, "word")
    a = words.select("cluster_id", F.col("word").alias("a"), F.col("p").alias("pa"))
    b = words.select("cluster_id", F.col("word").alias("b"), F.col("p").alias("pb"))
    cells = a.join(b, "cluster_id").withColumn("word_a", F.least("a", "b")).withColumn("word_b", F.greatest("a", "b"))
    cells = cells.join(counts, ["word_a", "word_b"], "left")
    joint = F.coalesce(F.col("n"), F.lit(0)) / n
    cells = cells.select("cluster_id", "a", "b", _npmi(joint, F.col("pa"), F.col("pb")).alias("v"))
    # topic vector: sum of the word vectors, one value per column b
    topic_vec = cells.groupBy("cluster_id", "b").agg(F.sum("v").alias("t"))
    per_word = (
        cells.join(topic_vec, ["cluster_id", "b"])
        .groupBy("cluster_id", "a")
        .agg(
            F.sum(F.col("v") * F.col("t")).alias("_dot"),
            F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_va"),
            F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("_vt"),
        )
    )
    norms = F.col("_va") * F.col("_vt")
    cosine = F.when(norms == 0, F.lit(0.0)).otherwise(F.col("_dot") / norms)
    return per_word.groupBy("cluster_id").agg(F.avg(cosine).alias("coherence"))


def coherence_cv(docs: DataFrame, id_col: str, tokens: Column, topics: DataFrame, **options) -> DataFrame:
    """Mean coherence over topics, one row. An empty topic table is an error."""
    if topics.isEmpty():
        raise ValueError("there are no topics to measure")
    return coherence_by_topic(docs, id_col, tokens, topics, **options).agg(F.avg("coherence").alias("coherence"))
