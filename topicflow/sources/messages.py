"""Message streams: a Kafka topic, landed files, and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow import schemas


def kafka_source(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """``value, partition, offset`` from the earliest offset on. Needs the Kafka
    connector package on the cluster."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select("value", "partition", "offset")


def kafka_sink(messages: DataFrame, servers: str, topic: str) -> None:
    (
        messages.select("value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def file_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages landed as Parquet ``value, partition, offset``."""
    reader = spark.readStream.schema(schemas.MESSAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def api_responses(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Articles of landed API responses, one per file or (without ``multi_line``)
    one per line: the fields that messages are made of, and the whole article as
    ``payload``. A response without results, or one that is not JSON, gives no rows."""
    reader = spark.readStream.schema(schemas.API_RESPONSE).option("multiLine", multi_line)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    fields = [F.try_variant_get("payload", f"$.{name}", "string").alias(name) for name in schemas.ARTICLE_FIELDS]
    return reader.json(path).select(F.explode("results").alias("payload")).select(*fields, "payload")
