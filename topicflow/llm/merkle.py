"""Document fingerprints: a Merkle tree over paragraphs and sections, in SQL functions only.

A text (null: empty) is cut into sections at blank lines (``\\n``, spaces or tabs, ``\\n``) and each
section into paragraphs at ``\\n``. A paragraph's leaf is the first 16 hex digits of its SHA-256, a
section's node those of the SHA-256 of its leaves in order, and the root the SHA-256 of the nodes.
The fingerprint is the string ``root/node1,node2/leaf1,leaf2;leaf3`` (sections apart by ``;``):
equal texts have equal fingerprints, equal roots mean equal trees, and sections whose nodes differ
locate an edit (``changed_sections``).

``likeness`` of two fingerprints is 1 for equal roots, else the share of distinct leaves that both
hold among the distinct leaves of either (a number from 0 to 1).

``edit_next`` pairs every document with the next one in descending doc_id (ties by text; null ids
last; after the last comes the first) without a global window: doc ids are cut into ranges by
quantiles into ranges of bounded rows and characters, each range is one window partition, and the first row of the next non-empty range joins
each range as a sentinel that sorts last. Texts cross one shuffle. A range is at most the rows of one
doc id plus ``rows_per_range`` rows or ``chars_per_range`` characters. Repeated rows are next to each other, so each has its twin as next.
Other columns of the input are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of this fingerprint's layout
SECTION_BREAK = r"\n[ \t]*\n"
LEAF_DIGITS = 16


def _short(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, LEAF_DIGITS)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of ``text`` (null: empty)."""
    sections = F.split(F.coalesce(text, F.lit("")), SECTION_BREAK, -1)
    leaves = F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), _short))
    nodes = F.transform(leaves, lambda ls: _short(F.array_join(ls, "")))
    root = F.sha2(F.array_join(nodes, ""), 256)
    return F.concat_ws("/", root, F.array_join(nodes, ","), F.array_join(F.transform(leaves, lambda ls: F.array_join(ls, ",")), ";"))


def _part(fp: Column, n: int) -> Column:
    return F.split(fp, "/", -1).getItem(n)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else |common distinct leaves| / |distinct leaves of either|."""
    la, lb = F.split(_part(a, 2), "[,;]", -1), F.split(_part(b, 2), "[,;]", -1)
    shared = F.size(F.array_intersect(la, lb)) / F.size(F.array_union(la, lb))
    return F.when(_part(a, 0) == _part(b, 0), F.lit(1.0)).otherwise(shared.cast("double"))


def changed_sections(a: Column, b: Column) -> Column:
    """Positions (from 1) of the sections whose nodes differ, or that only one of the trees has."""
    na, nb = F.split(_part(a, 1), ",", -1), F.split(_part(b, 1), ",", -1)
    return F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(na), F.size(nb))),
        lambda i: ~F.try_element_at(na, i).eqNullSafe(F.try_element_at(nb, i)),
    )


def edit_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 200_000, chars_per_range: int = 16 << 20
) -> DataFrame:
    """``doc_id, text`` and the next document's ``next_text`` for every row; the texts cross one shuffle.

    Each range's first row comes from a partial aggregate (one row per task and range reaches the
    shuffle). The first row of the range that follows is added to a range as a sentinel that sorts
    after its own rows, so one ``lead`` over the range finds every row's next text."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    # a range holds at most ``rows_per_range`` rows and about ``chars_per_range`` characters (one doc id apart)
    # and at least as many ranges as shuffle partitions, so that every task takes part
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "1"))
    ranges = max(1, min(tasks, size["n"]), math.ceil(size["n"] / rows_per_range), math.ceil((size["chars"] or 0) / chars_per_range))
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = base.agg(F.percentile_approx("doc_id", cuts, 10_000).alias("b")).first()["b"] or []
    else:
        bounds = []
    # ranges ascend with doc_id; rows of null doc_id are a range of their own, visited last
    below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    base = base.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below))
    # first of a range: largest doc_id (bitwise not reverses the order without overflow), then smallest text
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("k"), "text", "doc_id")).alias("_f")
    firsts = base.groupBy("_range").agg(first).select("_range", "_f.doc_id", "_f.text")
    # one row per range: which range follows it (the highest follows the last)
    following = firsts.select(
        "_range",
        F.coalesce(F.lead("_range").over(Window.orderBy(F.col("_range").desc())), F.max("_range").over(Window.partitionBy())).alias("_next"),
    )
    sentinels = following.join(firsts.withColumnRenamed("_range", "_next"), "_next").select(
        "_range", "doc_id", "text", F.lit(1).alias("_sentinel")
    )
    rows = base.withColumn("_sentinel", F.lit(0)).unionByName(sentinels)
    w = Window.partitionBy("_range").orderBy("_sentinel", F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    marked = rows.select("doc_id", "text", "_sentinel", F.lead("text").over(w).alias("next_text"))
    return marked.where("_sentinel = 0").drop("_sentinel")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 200_000, chars_per_range: int = 16 << 20
) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    changed_sections``. The edited text keeps the first ``n - floor(n/2)`` code points and then takes as
    many of the next document's first code points as there are, up to ``floor(n/2)``."""
    paired = edit_next(docs, id_col, text_col, rows_per_range, chars_per_range)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, (n - half).cast("int")), F.substring("next_text", 1, half))
    # fingerprints after the shuffle: only texts cross it
    out = paired.select(
        "doc_id", n.alias("n_chars"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("next_text")).alias("next_fp"), edited.alias("_edited")
    )
    out = out.select("*", fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        "edited_fingerprint",
        likeness(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        changed_sections(F.col("fp"), F.col("edited_fingerprint")).alias("changed_sections"),
    )


def fingerprint_sql(table: str = "documents") -> str:
    """DuckDB SQL of the same rows (without ``changed_sections``)."""
    leaves = r"list_transform(string_split_regex({t}, '\n[ \t]*\n'), lambda s: list_transform(string_split(s, chr(10)), lambda p: substr(sha256(p), 1, 16)))"
    fp = (
        "sha256(array_to_string(list_transform({L}, lambda ls: substr(sha256(array_to_string(ls, '')), 1, 16)), '')) || '/' || "
        "array_to_string(list_transform({L}, lambda ls: substr(sha256(array_to_string(ls, '')), 1, 16)), ',') || '/' || "
        "array_to_string(list_transform({L}, lambda ls: array_to_string(ls, ',')), ';')"
    )

    def fp_of(t: str) -> str:
        return fp.replace("{L}", leaves.replace("{t}", t))

    def like(a: str, b: str) -> str:
        la, lb = f"string_split_regex(split_part({a}, '/', 3), '[,;]')", f"string_split_regex(split_part({b}, '/', 3), '[,;]')"
        return (
            f"CASE WHEN split_part({a}, '/', 1) = split_part({b}, '/', 1) THEN 1.0 "
            f"ELSE len(list_distinct(list_intersect({la}, {lb})))::DOUBLE / len(list_distinct(list_concat({la}, {lb}))) END"
        )

    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM {table}
), fp AS (
  SELECT doc_id, t, {fp_of('t')} AS fp FROM base
), ordered AS (
  SELECT doc_id, t, fp,
         coalesce(lead(t) OVER w, first_value(t) OVER whole) AS nt,
         coalesce(lead(fp) OVER w, first_value(fp) OVER whole) AS nfp
  FROM fp
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t ASC),
         whole AS (ORDER BY doc_id DESC NULLS LAST, t ASC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edited AS (
  SELECT doc_id, t, fp, nfp, length(t)::BIGINT AS n_chars,
         substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS e
  FROM ordered
), done AS (
  SELECT doc_id, n_chars, sha256(e) AS edited_sha256, fp AS fingerprint, {fp_of('e')} AS edited_fingerprint, nfp FROM edited
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {like('fingerprint', 'edited_fingerprint')} AS near_edited,
       {like('fingerprint', 'nfp')} AS near_next
FROM done
"""
