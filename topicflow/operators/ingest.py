"""Validation, routing and deduplication of incoming messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicflow.functions import ids
from topicflow.session import stored_table

INVALID_JSON = "invalid_json"
NOT_OBJECT = "not_an_object"
MISSING_TEXT = "missing_text"
BAD_DATE = "bad_published_at"
STORED = "stored"
DUPLICATE = "duplicate"

_FIELDS = ("external_id", "title", "source", "published_at", "text", "url")
_OPTIONS = {"allowSingleQuotes": "false"}


def normalize_articles(articles: DataFrame) -> DataFrame:
    """API articles as messages; articles without content and description are skipped.

    Empty strings count as missing where the next candidate takes over. The
    ``payload`` is the article as it came (a variant with all its fields); from
    articles without one it is made of their columns.
    """
    text = F.coalesce(ids.blank_to_null(F.col("content")), ids.blank_to_null(F.col("description")))
    whole = F.to_variant_object(F.struct(*[F.col(c) for c in articles.columns]))
    raw = F.col("payload") if "payload" in articles.columns else whole
    return articles.withColumns(
        {
            "_text": text,
            "_source": F.coalesce(ids.blank_to_null(F.col("source_id")), F.col("source")),
            "_payload": raw,
        }
    ).where(F.col("_text").isNotNull()).select(
        ids.article_id(F.col("link"), F.col("title"), F.col("pubDate"), F.col("_text")).alias("external_id"),
        "title",
        F.col("_source").alias("source"),
        F.col("pubDate").alias("published_at"),
        F.col("_text").alias("text"),
        F.col("link").alias("url"),
        F.col("_payload").alias("payload"),
    )


def encode_messages(messages: DataFrame) -> DataFrame:
    """``value``: the row as UTF-8 JSON, non-ASCII characters and null fields kept."""
    return messages.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary").alias("value"))


def _truthy_text(field: Column) -> Column:
    """A JSON field as text, null when Python would call it false."""

    def convert(v: Column) -> Column:
        kind, text = F.schema_of_variant(v), v.try_cast("string")
        number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        false = (
            kind.isNull()
            | (kind == "VOID")
            | ((kind == "BOOLEAN") & (text == "false"))
            | (number & (v.try_cast("double") == 0))
            | text.isin("", "[]", "{}")
        )
        return F.when(~false, F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))

    return ids.once(field, convert)


def _string_only(field: Column) -> Column:
    return ids.once(field, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string")))


def _pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of
    computing it again: optimizer rules do not move expressions through a generator."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Add ``reason`` (null when valid) and the fields of each message.

    ``value`` must be UTF-8 JSON holding one object whose ``text`` is a
    non-empty string and whose ``published_at``, if a non-empty string, is
    ISO-8601. The message is parsed as the first of two array elements: then
    trailing garbage makes it invalid instead of being ignored. Fields are read
    as variants, which keeps strings and numbers apart.
    """
    fields = ", ".join(f"{name}: variant" for name in _FIELDS)
    schema = f"array<struct<{fields}, _end: int>>"
    raw = F.col("value").cast("string")
    wrapped = F.concat(F.lit("["), F.col("_raw"), F.lit(',{"_end":1}]'))
    df = messages.withColumn("_raw", F.when(F.is_valid_utf8(raw), raw))
    df = _pinned(df, "_items", F.from_json(wrapped, schema, _OPTIONS))
    whole = (F.size("_items") == 2) & (F.get(F.col("_items"), 1)["_end"] == 1)
    looks_object = F.coalesce(F.col("_raw").rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    message = F.when(whole & looks_object, F.get(F.col("_items"), 0))
    truthy = [_truthy_text(message[name]).alias(f"_{name}") for name in _FIELDS]
    plain = [message[name].try_cast("string").alias(f"_plain_{name}") for name in ("title", "source", "url")]
    read = F.struct(
        message.isNotNull().alias("_is_object"),
        F.when(~looks_object, F.expr("try_parse_json(concat('[', _raw, ',0]'))").isNotNull()).alias("_other_json"),
        _string_only(message["text"]).alias("_body"),
        F.nullif(_string_only(message["published_at"]), F.lit("")).alias("_date_text"),
        *truthy,
        *plain,
    )
    # inline gives plain columns, pinned like the others
    df = df.select("*", F.inline_outer(F.array(read)))
    df = _pinned(df, "published_at", ids.parse_iso8601(F.col("_date_text")))
    reason = (
        F.when(
            ~F.col("_is_object"),
            F.when(F.coalesce(F.col("_other_json"), F.lit(False)), NOT_OBJECT).otherwise(INVALID_JSON),
        )
        .when(F.coalesce(F.col("_body"), F.lit("")) == "", MISSING_TEXT)
        .when(F.col("_date_text").isNotNull() & F.col("published_at").isNull(), BAD_DATE)
    )
    ext = ids.external_id(*[F.col(f"_{name}") for name in ("external_id", "title", "source", "published_at", "text")])
    result = _pinned(df, "reason", reason)
    return result.select(
        *messages.columns,
        "reason",
        "published_at",
        ext.alias("external_id"),
        F.col("_plain_title").alias("title"),
        F.col("_plain_source").alias("source"),
        F.col("_plain_url").alias("url"),
        F.col("_body").alias("raw_text"),
        F.col("_raw").alias("payload_json"),
    )


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects as ``partition, offset, value, reason``."""
    valid = parsed.where(F.col("reason").isNull()).drop("reason", "value")
    rejected = parsed.where(F.col("reason").isNotNull()).select("partition", "offset", "value", "reason")
    return valid, rejected


def first_per_id(valid: DataFrame) -> DataFrame:
    """The first message (by partition, offset) of every external id.

    The row_number() = 1 filter drops later copies before the shuffle, so an id
    repeated millions of times sends one row per input partition.
    """
    w = Window.partitionBy("external_id").orderBy("partition", "offset")
    return valid.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def known_ids(ids_df: DataFrame, stored: DataFrame, key: str = "external_id") -> DataFrame:
    """The rows of ``stored`` whose key occurs in ``ids_df``.

    A micro-batch is small and the store is not. The batch's ids are written
    once, so Spark knows their size: below its broadcast threshold the store is
    filtered where it is read, above it both are shuffled.
    """
    return stored.join(stored_table(ids_df.select(key).distinct(), "batch-ids"), key, "left_semi")


def new_news(valid: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-if-absent: first message per id that is not among ``stored``."""
    return first_per_id(valid).join(stored.select("external_id"), "external_id", "left_anti")


def to_incoming_news(fresh: DataFrame, created_at: Column) -> DataFrame:
    return fresh.select(
        ids.news_id(F.col("external_id")).alias("id"),
        "external_id",
        "title",
        "source",
        "published_at",
        "raw_text",
        "url",
        "payload_json",
        created_at.alias("created_at"),
    )


def ingest_outcomes(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """``outcome, n``: stored, duplicate and one row per reject reason.

    One pass: messages are counted per reason, and valid ones per id, before
    they are compared with the store.
    """
    valid = F.col("reason").isNull()
    per_id = parsed.groupBy("reason", F.when(valid, F.col("external_id")).alias("external_id")).agg(
        F.count("*").alias("_n")
    )
    known = stored.select("external_id").distinct().withColumn("_known", F.lit(True))
    fresh = F.when(F.col("_known").isNull(), 1).otherwise(0).cast("bigint")
    counted = per_id.join(known, "external_id", "left").select(
        F.inline(
            F.array(
                F.struct(
                    F.coalesce("reason", F.lit(STORED)).alias("outcome"),
                    F.when(valid, fresh).otherwise(F.col("_n")).alias("n"),
                ),
                F.struct(
                    F.lit(DUPLICATE).alias("outcome"), F.when(valid, F.col("_n") - fresh).otherwise(0).alias("n")
                ),
            )
        )
    )
    return counted.groupBy("outcome").agg(F.sum("n").alias("n")).where("n > 0")
