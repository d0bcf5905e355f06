"""Text embeddings: a pluggable encoder over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicflow.functions import text as tx

Encoder = Callable[[list], np.ndarray]


@lru_cache(maxsize=200_000)
def _bucket(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:6], 16) % dim


def hashing_encoder(dim: int = 256) -> Callable[[], Encoder]:
    """Factory of the offline default encoder: hashed term counts over the whole
    token list. A model-based encoder is a factory of the same shape that loads
    its weights when called, once per task."""

    def load() -> Encoder:
        def encode(token_lists: list) -> np.ndarray:
            out = np.zeros((len(token_lists), dim), dtype=np.float64)
            for row, tokens in enumerate(token_lists):
                buckets = np.fromiter((_bucket(t, dim) for t in tokens), dtype=np.int64, count=len(tokens))
                out[row] = np.bincount(buckets, minlength=dim)
            return out

        return encode

    return load


def embed(
    df: DataFrame,
    id_col: str,
    text_col: str,
    encoder_factory: Callable[[], Encoder] | None = None,
    batch_size: int = 32,
    normalize: bool = True,
    tokenize: bool | None = None,
) -> DataFrame:
    """``id, embedding``. Null text counts as empty.

    The factory runs once per task, the encoder once per ``batch_size`` rows.
    The default encoder gets lower-cased word tokens made on the JVM; a custom
    one gets the text unless ``tokenize`` is set.
    """
    factory = encoder_factory or hashing_encoder()
    tokenize = encoder_factory is None if tokenize is None else tokenize
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(id_col, (tx.word_tokens(text, 1) if tokenize else text).alias("_input"))
    schema = T.StructType(
        [df.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                vectors = np.asarray(encode(list(part["_input"])), dtype=np.float64)
                if normalize:
                    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = np.divide(vectors, norms, out=vectors.copy(), where=norms > 0)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": list(vectors.astype(np.float32))})

    return source.mapInPandas(run, schema)


def attach_embeddings(df: DataFrame, embeddings: DataFrame, id_col: str) -> DataFrame:
    """Join rows with their embeddings by id: every id has one row and one embedding."""
    one = F.lit(1).cast("bigint")
    sides = df.select(id_col, one.alias("_row"), F.lit(0).alias("_vec")).unionByName(
        embeddings.select(id_col, F.lit(0).cast("bigint").alias("_row"), F.lit(1).alias("_vec"))
    )
    counts = sides.groupBy(id_col).agg(F.sum("_row").alias("_row"), F.sum("_vec").alias("_vec"))
    lost, extra, repeated = counts.agg(
        F.count_if(F.col("_vec") == 0),
        F.count_if(F.col("_row") == 0),
        F.count_if((F.col("_row") > 1) | (F.col("_vec") > 1) | F.col(id_col).isNull()),
    ).first()
    if lost or extra or repeated:
        raise ValueError(f"rows without embedding: {lost}, embeddings without row: {extra}, repeated or null ids: {repeated}")
    return df.join(embeddings, id_col)


def embedding_job(df: DataFrame, id_col: str, path: str, text_col: str = "text", encoder_factory=None, **options) -> None:
    """Corpus to embedding store: null text as empty, encode, write ``doc_id, embedding``."""
    vectors = embed(df, id_col, text_col, encoder_factory, **options)
    vectors.withColumnRenamed(id_col, "doc_id").write.mode("overwrite").parquet(path)
