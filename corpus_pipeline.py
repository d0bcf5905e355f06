"""The training-corpus pipeline: five stages over ``documents``, each a training-data operator.

Every stage works on all rows its predecessor kept. The first four return the columns of ``documents``
(``n_chars`` follows the text), the last one the packed pieces. Null and empty texts pass the filters: they
are not toxic, have no lines to drop, are nobody's copy and hold no benchmark item.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm import decontam, linededup, minhash, packing, toxicity
from topicflow.llm.common import read, small_batches, stored
from topicflow.llm.queries import tokenizer_path

TOXIC = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with small Arrow batches: stages share the executors, whose memory keeps what the largest took."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below ``TOXIC``."""
    model = toxicity.train_model(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~toxicity.is_held_out())
    return toxicity.score_documents(docs, model).where(F.col("toxic_score") < TOXIC).select(docs.columns)


@bounded
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least 3 documents share, kept in the largest id only."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    kept = minhash.near_duplicates(docs).where("kept or doc_id is null").select(F.col("doc_id").alias("_id"))
    return docs.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_id"))).select(docs.columns)


@bounded
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.find_leaks(docs, read(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as best fit finds."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

# model training, hashing and latent search have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; every result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
