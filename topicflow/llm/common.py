"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.session import number_of, scratch_path, small_batches  # noqa: F401 (the operators take them from here)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The column's texts, a few at a time as Python strings."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it holds too many, so memory is bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def heavy_keys(counts: DataFrame, key: str, count: str, parts: int = 1000) -> DataFrame:
    """Keys that hold at least one ``parts``-th of the whole count: never more than ``parts`` rows."""
    total = counts.agg(F.sum(count).alias("n")).first()["n"] or 0
    return counts.where(F.col(count) * parts >= F.lit(total)).where(F.lit(total) > 0).select(key, count)


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: list[str], how: str, parts: int = 1000) -> DataFrame:
    """Join ``left`` with ``right`` (few rows for a key) on ``key``, hot keys of ``left`` spread over salts.

    A key with a share of the rows above one ``parts``-th gets as many salts as it has such shares, so no
    (key, salt) is hot. At most ``parts`` keys have salts, which bounds the broadcast table, and their
    rows of ``right`` are repeated at most twice ``parts`` times together for rows unique by key.
    ``salt_by`` are columns of ``left`` that tell its rows apart. ``how`` is inner or left.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = left.count()
    each = max(1, -(-total // parts))
    hot = counts.where(F.col("_n") > each).select(key, F.ceil(F.col("_n") / each).cast("int").alias("_salts"))
    hot = F.broadcast(stored(hot, "hot-keys"))
    salts = F.coalesce("_salts", F.lit(1))
    spread_left = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), *salt_by), salts).cast("int"))
    spread_right = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread_left.drop("_salts").join(spread_right.drop("_salts"), [key, "_salt"], how).drop("_salt")
