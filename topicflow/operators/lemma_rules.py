"""Lemmas of words that the dictionary lacks, by longest-suffix rules learnt from the dictionary.

Examples are the dictionary's ``(token, lemma)`` pairs and every lemma as its own form. An example
``token = stem + cut``, ``lemma = stem + tail`` (``stem`` their longest common prefix) gives a rule
"strip ``len(cut)`` characters, add ``tail``", filed under the endings of the token that hold ``cut``
and up to ``context`` characters before it. Per ending the most frequent rule wins (ties: shorter
strip, then smaller tail), and it keeps its support. A word not in the dictionary takes the rule of
its longest ending with at least ``min_support`` examples; without one it stays as it is. Learning
and applying are joins and aggregates on the JVM; the rule table holds at most ``context + 1`` rows
per example, and only the distinct words of the text meet it. Null tokens are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.session import stored_table

CONTEXT = 2
MIN_SUPPORT = 2


def _common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, 1, i) == F.substring(b, 1, i)))
    return F.size(same)


def learn_rules(dictionary: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``ending, strip, tail, support``: the rule of every ending seen in the examples."""
    pairs = dictionary.where(F.col("token").isNotNull() & F.col("lemma").isNotNull() & (F.length("token") > 0)).select("token", "lemma")
    examples = pairs.unionByName(pairs.select(F.col("lemma").alias("token"), "lemma")).where(F.length("token") > 0).distinct()
    shaped = examples.withColumn("_p", _common_prefix(F.col("token"), F.col("lemma"))).select(
        "token", (F.length("token") - F.col("_p")).alias("strip"), F.expr("substring(lemma, _p + 1)").alias("tail")
    )
    span = F.sequence(F.greatest(F.col("strip"), F.lit(1)), F.least(F.col("strip") + context, F.length("token")))
    endings = shaped.select("token", "strip", "tail", F.explode(span).alias("_k")).select(
        F.expr("substring(token, -_k)").alias("ending"), "strip", "tail"
    )
    counted = endings.groupBy("ending", "strip", "tail").agg(F.count("*").alias("support"))
    best = counted.groupBy("ending").agg(F.min(F.struct((-F.col("support")).alias("neg"), "strip", "tail")).alias("_b"))
    return best.select("ending", F.col("_b.strip").alias("strip"), F.col("_b.tail").alias("tail"), (-F.col("_b.neg")).alias("support"))


def guess_lemmas(words: DataFrame, rules: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``token, lemma`` for every distinct token of ``words`` (one ``token`` column): the rule of its
    longest ending with enough support, or the token itself."""
    tokens = words.where(F.col("token").isNotNull()).select("token").distinct()
    ends = tokens.where(F.length("token") > 0).select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("_k")).select(
        "token", "_k", F.expr("substring(token, -_k)").alias("ending")
    )
    usable = rules.where(F.col("support") >= min_support)
    matched = ends.join(usable, "ending").groupBy("token").agg(F.max(F.struct("_k", "strip", "tail")).alias("_r"))
    lemma = F.concat(F.expr("substring(token, 1, length(token) - _r.strip)"), F.col("_r.tail"))
    return tokens.join(matched, "token", "left").select("token", F.when(F.col("_r").isNull(), F.col("token")).otherwise(lemma).alias("lemma"))


def lemmatize_with_rules(
    df: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, out: str = "lemmatized", min_support: int = MIN_SUPPORT
) -> DataFrame:
    """``df`` plus ``out``: dictionary lemmas where the dictionary knows the token, learnt rules elsewhere."""
    known = dictionary.groupBy("token").agg(F.min("lemma").alias("lemma"))
    rules = stored_table(learn_rules(dictionary), "lemma-rules")
    tokens = df.select(F.explode(tx.space_tokens(F.col(text_col))).alias("token"))
    unknown = tokens.join(known, "token", "left_anti")
    table = stored_table(known.unionByName(guess_lemmas(unknown, rules, min_support)).where("token <> lemma"), "lemma-table")
    distinct = F.array_distinct(tx.space_tokens(F.col(text_col)))
    found = df.select(F.col(id_col).alias("_id"), F.explode_outer(distinct).alias("token")).join(table, "token")
    lemmas = found.groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "lemma"))).alias("_lemmas"))
    joined = df.join(lemmas, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    replaced = F.transform(tx.space_tokens(F.col(text_col)), lambda t: F.coalesce(F.get(F.array(F.col("_lemmas")[t]), 0), t))
    return joined.withColumn(out, F.array_join(replaced, " ")).drop("_id", "_lemmas")


def held_out_accuracy(dictionary: DataFrame, folds: int = 10, min_support: int = MIN_SUPPORT) -> float:
    """Share of right lemmas for a tenth of the dictionary's tokens (by hash) under rules learnt from
    the rest; their lemmas count as examples of staying the same."""
    fold = F.pmod(F.xxhash64("token"), F.lit(folds))
    held = dictionary.where(fold == 0)
    rules = learn_rules(dictionary.where(fold != 0))
    want = held.groupBy("token").agg(F.min("lemma").alias("want"))
    got = guess_lemmas(held.select("token"), rules, min_support)
    row = got.join(want, "token").agg(F.avg((F.col("lemma") == F.col("want")).cast("double"))).first()
    return float(row[0] or 0.0)
