"""The same expressions as SQL functions, callable from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from topicflow.functions import stopwords as sw
from topicflow.functions.text import ALPHABET


def register(spark: SparkSession) -> None:
    """Create temporary functions ``clean_text`` and ``external_id``."""
    words = ", ".join(f"'{w}'" for w in sw.DEFAULT)
    spark.sql(
        rf"""
        CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN
          array_join(filter(
            regexp_extract_all(
              regexp_replace(lower(coalesce(t, '')), r'(?U)(?:http|www)[^\s\x1c-\x1f]+', ' '),
              r'(?iu)[{ALPHABET}]{{3,}}', 0),
            w -> w NOT IN ({words})), ' ')
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION external_id(
          given STRING, title STRING, source STRING, published_at STRING, body STRING)
        RETURNS STRING RETURN coalesce(nullif(given, ''), sha2(concat_ws('|',
          coalesce(title, ''), coalesce(source, ''), coalesce(published_at, ''), coalesce(body, '')), 256))
        """
    )
