"""Term statistics, vocabulary selection and TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicflow.session import scratch_path, small_batches

# documents whose terms are counted at a time
COUNT_ROWS = 256


def term_counts(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """``keys, term, tf``: term counts of each row; ``keys[0]`` is its id.

    One row is one document, so its terms are counted inside the task, some rows of an Arrow
    batch at a time: terms become dictionary codes, and equal (row, code) pairs are counted.
    Nothing is shuffled, and a null or empty array gives no row.
    """
    # a row's terms are several times its text: whole batches of them would fill an executor's direct memory
    small_batches(df.sparkSession)
    rows = df.select(*keys, tokens.alias("_t"))
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(at, COUNT_ROWS)
                lists = part.column(len(keys))
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                terms, row = lists.flatten(), np.repeat(np.arange(part.num_rows), lengths)
                if terms.null_count:
                    row, terms = row[terms.is_valid().to_numpy(zero_copy_only=False)], terms.drop_null()
                coded = terms.dictionary_encode()
                pairs = row * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, tf = np.unique(pairs, return_counts=True)
                row, code = np.divmod(pairs, max(len(coded.dictionary), 1))
                columns = [part.column(i).take(pa.array(row)) for i in range(len(keys))]
                columns += [coded.dictionary.take(pa.array(code)), pa.array(tf, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(count, schema)


def vector_counts(df: DataFrame, keys: list[str], counts_col: str, terms: list[str]) -> DataFrame:
    """``term_counts`` of the vocabulary ``terms`` only, from a CountVectorizer's sparse vectors over them.

    The vectors are written once and read back as the plain columns they consist of.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "counts")
    df.select(*keys, counts_col).write.parquet(path)
    plain = T.StructType([*[df.schema[k] for k in keys], T.StructField(counts_col, df.schema[counts_col].dataType.sqlType())])
    rows = spark.read.schema(plain).parquet(path)
    entry = F.explode(F.arrays_zip(F.col(f"{counts_col}.indices").alias("i"), F.col(f"{counts_col}.values").alias("n")))
    entries = rows.select(*keys, entry.alias("_e")).select(*keys, F.col("_e.i").alias("_i"), F.col("_e.n").cast("bigint").alias("tf"))
    named = spark.createDataFrame(list(enumerate(terms)), "_i int, term string")
    return entries.join(F.broadcast(named), "_i").select(*keys, "term", "tf")


def document_frequency(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, term, df, tf``: documents holding the term and its total count."""
    return counts.groupBy(*(keys or []), "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def vocabulary(
    counts: DataFrame,
    n_docs: Column,
    min_df: int = 10,
    max_df: float = 0.5,
    max_features: int = 20000,
) -> DataFrame:
    """``term, df, tf`` of the terms within the document-frequency bounds, cut to
    the ``max_features`` most frequent by total count (ties by term)."""
    kept = document_frequency(counts).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return kept.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)


def surely_rare_filtered(counts: DataFrame, min_df: int, depth: int = 2, width: int = 1 << 18) -> DataFrame:
    """``counts`` without the rows of terms that surely occur in fewer than ``min_df`` documents.

    A count-min sketch of document frequencies: each row (a document's distinct term) adds one to
    ``depth`` cells chosen by hashes of the term, summed per task before the shuffle, so at most
    ``depth * width`` rows leave a task and the sketch (bounded by that product) is broadcast. A
    term's smallest cell is never below its document frequency, so a term under ``min_df`` there is
    under it in truth; other terms keep all their rows and their exact counts follow."""
    cells = [F.pmod(F.xxhash64(F.lit(f"cms-{i}"), "term"), F.lit(width)) for i in range(depth)]
    keyed = counts.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    sketch = (
        keyed.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_c{i}").alias("c")) for i in range(depth)])).alias("_k"))
        .groupBy("_k.i", "_k.c")
        .agg(F.count("*").alias("n"))
    )
    for i in range(depth):
        own = sketch.where(F.col("i") == i).select(F.col("c").alias(f"_c{i}"), F.col("n").alias(f"_n{i}"))
        keyed = keyed.join(F.broadcast(own), f"_c{i}", "left")
    estimate = F.least(*[F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i in range(depth)])
    return keyed.where(estimate >= min_df).drop(*[f"_c{i}" for i in range(depth)], *[f"_n{i}" for i in range(depth)])


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def tfidf_long(counts: DataFrame, vocab: DataFrame, n_docs: Column, id_col: str) -> DataFrame:
    """``id, term, tfidf`` with L2-normed rows.

    ``vocab`` has at most ``max_features`` rows, so it is broadcast. For the norm
    the weights of vocabulary terms, not the texts, are shuffled by document.
    """
    idf = vocab.select("term", smooth_idf(n_docs, F.col("df")).alias("_idf"))
    weighted = counts.join(F.broadcast(idf), "term").withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weighted.withColumn("_norm", norm).withColumn("tfidf", F.col("_w") / F.col("_norm")).drop(
        "tf", "_idf", "_w", "_norm"
    )


def sparse_rows(docs: DataFrame, tfidf: DataFrame, id_col: str) -> DataFrame:
    """``docs`` plus ``idx`` and ``vec``: positions (term hashes) and weights of
    each document's vector, empty without any vocabulary term."""
    packed = tfidf.groupBy(id_col).agg(
        F.collect_list(F.struct(F.xxhash64("term").alias("i"), F.col("tfidf").alias("v"))).alias("_iv")
    )
    packed = packed.select(id_col, F.col("_iv.i").alias("idx"), F.col("_iv.v").alias("vec"))
    return docs.join(packed, id_col, "left").withColumns(
        {
            "idx": F.coalesce("idx", F.array().cast("array<bigint>")),
            "vec": F.coalesce("vec", F.array().cast("array<double>")),
        }
    )


def count_documents(df: DataFrame) -> Column:
    """Row count as a scalar subquery, evaluated once inside the plan."""
    return df.agg(F.count("*")).scalar()


def fit_tfidf(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    min_df: int = 10,
    max_df: float = 0.5,
    max_features: int = 20000,
    out: str = "features",
) -> PipelineModel:
    """A saved-and-loaded-able TF-IDF model producing sparse L2-normed vectors.

    Fitting aggregates terms and keeps at most ``max_features`` of them; that
    bounded list is the only thing brought to the driver. Transforming is a
    map over rows. MLlib's IDF lacks the ``+1``, hence the explicit scaling.
    """
    n = df.count()
    counts = term_counts(df, [id_col], F.col(tokens_col))
    rows = (
        vocabulary(counts, F.lit(n), min_df, max_df, max_features)
        .select("term", smooth_idf(F.lit(n), F.col("df")).alias("idf"))
        .collect()
    )
    if not rows:
        raise ValueError("no term satisfies the document-frequency bounds")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], tokens_col, "_tf")
    scaler = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
    return Pipeline(stages=[counter, scaler, norm]).fit(df.limit(0))
