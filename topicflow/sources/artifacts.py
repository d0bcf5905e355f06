"""Saved results of a training run: models, topics, metrics, embeddings."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow import schemas
from topicflow.operators.topics import topics_as_arrays


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hpath)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not _exists(spark, path):
        raise FileNotFoundError(f"Model artifact not found at {path}")
    return PipelineModel.load(path)


def save_embeddings(df: DataFrame, path: str) -> None:
    """``doc_id, embedding`` keyed by id, never by position."""
    df.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def topics_json(topics: DataFrame) -> DataFrame:
    """One row ``value``: ``{"<cluster>": ["word", ...], ...}``. The topic table
    is a top-n report, a few words per cluster."""
    packed = topics_as_arrays(topics)
    entries = F.sort_array(F.collect_list(F.struct(F.col("cluster_id").cast("string"), "top_words")))
    return packed.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_topics(topics: DataFrame, path: str) -> None:
    """The ``topics`` table and its JSON form for other tools."""
    topics.write.mode("overwrite").parquet(f"{path}/topics")
    topics_json(topics).coalesce(1).write.mode("overwrite").text(f"{path}/topics_json")


def read_topics_json(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id, label, top_words`` from a topics JSON file; the label of an
    unnamed topic is ``cluster_<id>``."""
    value = F.from_json(F.col("value"), "map<string, array<string>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(value).alias("key", "top_words"))
    return rows.select(
        F.col("key").cast("int").alias("cluster_id"),
        F.concat(F.lit("cluster_"), F.col("key")).alias("label"),
        "top_words",
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(f"{path}/run_metrics")
