"""Corpus preparation: joining sources, building content, cleaning, splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.functions import text as tx


# spellings besides ISO that news dumps use, tried in this order
DATE_FORMATS = (
    "yyyy/M/d[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss][ Z]]",
    "d MMM yyyy H:mm:ss z",
    "d.M.yyyy[ H:mm[:ss]]",
    "MMM d, yyyy[ H:mm[:ss]]",
    "MMMM d, yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "yyyyMMdd",
)


def parse_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """TIMESTAMP, null when the text is not a date in ISO form or one of ``formats``.

    A leading weekday name is ignored; times without a zone are session time.
    """
    text = F.regexp_replace(F.trim(col), r"^\p{L}{3,9}, +(?=\d)", "")
    # eight digits are a day, not a year
    iso = F.when(~text.rlike(r"^\d{5,}$"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def join_corpora(a: DataFrame, b: DataFrame, min_year: int = 2014, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Union of the two corpora as ``title, text, topic, date``.

    Only the first corpus is limited to years after ``min_year`` (which drops
    its undated rows); the second keeps everything, with a null topic.
    """
    left = (
        a.withColumn("date", parse_date(F.col("date"), formats))
        .where(F.year("date") > min_year)
        .drop("url", "tags")
    )
    right = (
        b.drop("source", "rubric", "subrubric", "tags")
        .withColumnRenamed("publication_date", "date")
        .withColumn("date", parse_date(F.col("date"), formats))
    )
    return left.unionByName(right, allowMissingColumns=True)


def with_content(df: DataFrame) -> DataFrame:
    """Add ``content`` unless present: trimmed ``title text``, or the text alone."""
    if "content" in df.columns:
        return df
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in df.columns else F.lit("")
    if "title" not in df.columns:
        return df.withColumn("content", text)
    title = F.coalesce(F.col("title"), F.lit(""))
    return df.withColumn("content", tx.strip(F.concat_ws(" ", title, text)))


def drop_short(df: DataFrame, min_chars: int = 20) -> DataFrame:
    """Rows whose content is present and longer than ``min_chars``."""
    df = with_content(df)
    return df.na.drop(subset=["content"]).withColumn("content", F.col("content").cast("string")).where(
        F.length("content") > min_chars
    )


def with_clean_text(df: DataFrame, source: str = "content", out: str = "clean_text", **options) -> DataFrame:
    """Cleaned text of ``source``; rows that clean to nothing are dropped.

    The text comes out of a generator: written out, Spark would clean again in the filter.
    """
    return df.withColumn(out, F.explode(F.array(tx.clean_text(F.col(source), **options)))).where(F.length(out) > 0)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"the table has no column {name!r}")


def prepare_frame(df: DataFrame, raw_text_col: str = "text", topic_text_col: str = "lemmatized") -> DataFrame:
    """Content filter plus non-empty raw and topic text."""
    df = drop_short(df)
    require_columns(df, [raw_text_col, topic_text_col])
    df = df.na.drop(subset=[raw_text_col, topic_text_col])
    for name in dict.fromkeys([raw_text_col, topic_text_col]):
        df = df.withColumn(name, F.col(name).cast("string")).where(F.length(name) > 0)
    return df


def drop_exact_duplicates(df: DataFrame, text: Column, order: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every distinct text.

    Filtering row_number() = 1 lets Spark keep one row per text and input
    partition before the shuffle, so a text copied many times stays cheap.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("_digest").orderBy(*order)
    return (
        df.withColumn("_digest", F.sha2(F.coalesce(text, F.lit("")), 256))
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_digest", "_rn")
    )


def temporal_split(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Add ``split``: train before ``cutoff``, test from it on."""
    return df.withColumn("split", F.when(F.col(ts) < F.lit(cutoff).cast("timestamp"), "train").otherwise("test"))


def random_split(df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` from a hash of the id: stable under re-runs and re-partitioning."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")), 256)
    bucket = F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(bucket < int(test_share * 16**6), "test").otherwise("train"))
