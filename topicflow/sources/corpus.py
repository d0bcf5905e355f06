"""CSV corpora in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and quoted multi-line text.

    Such files cannot be split, so parallelism comes from many files; convert
    large corpora to Parquet once with ``write_table``.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quotes doubled inside quotes; readable by ``read_csv``."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
