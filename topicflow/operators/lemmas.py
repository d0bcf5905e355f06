"""Lemmatization by a dictionary table ``(token, lemma)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.operators.corpus import require_columns
from topicflow.session import stored_table


def lemmatize(df: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, out: str = "lemmatized") -> DataFrame:
    """``df`` plus ``out``: every whitespace token replaced by its lemma; unknown tokens stay.

    Only the distinct tokens of each row meet the dictionary. They are joined by
    token (broadcast if Spark finds the dictionary small enough, else by shuffle,
    where a frequent token comes once per row and is pre-split by AQE), collected
    per row, and the text is put together where it stands. Of two lemmas of one
    token the smaller counts; rows with equal ids share the replacements.
    """
    entries = dictionary.where("token <> lemma").groupBy(F.col("token").alias("_token")).agg(F.min("lemma").alias("_lemma"))
    entries = stored_table(entries, "lemmas")
    tokens = F.array_distinct(tx.space_tokens(F.col(text_col)))
    found = df.select(F.col(id_col).alias("_id"), F.explode_outer(tokens).alias("_token")).join(entries, "_token")
    lemmas = found.groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("_token", "_lemma"))).alias("_lemmas"))
    joined = df.join(lemmas, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    replaced = F.transform(tx.space_tokens(F.col(text_col)), lambda t: F.coalesce(F.get(F.array(F.col("_lemmas")[t]), 0), t))
    return joined.withColumn(out, F.array_join(replaced, " ")).drop("_id", "_lemmas")


def lemmatize_corpus(
    df: DataFrame, dictionary: DataFrame, id_col: str, target_col: str = "text", out: str = "lemmatized", **options
) -> DataFrame:
    """The corpus job: clean ``target_col`` in place, blank nulls, lemmatize."""
    require_columns(df, [target_col])
    cleaned = df.withColumn(target_col, tx.clean_text(F.col(target_col), **options)).na.fill("")
    return lemmatize(cleaned, dictionary, id_col, target_col, out)
