"""Named queries of the training-data operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm import crosspolytope, decontam, licenses, linededup, lmscore, maglev, merkle, minhash, packing, resample, sitetree, toxicity, xtok
from topicflow.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


SHARDS = [f"shard-{i:02d}" for i in range(64)]


@query
def op1_license_sentences(spark, sf):
    return licenses.scan_licenses(read(spark, sf, "documents").select("doc_id", "text")).drop("text")


ORACLE["op1_license_sentences"] = licenses.license_sql()


@query
def op2_cross_entropy_difference(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    wanted = read(spark, sf, "labels").where("quality = 1")
    return lmscore.cross_entropy_difference(docs, wanted).drop("text")


@query
def op3_minhash_bbit(spark, sf):
    return minhash.near_duplicates(read(spark, sf, "documents"), k=3, threshold=(17, 20))


@query
def op4_bestfit_packing(spark, sf):
    return packing.pack_documents(read(spark, sf, "documents"), tokenizer_path())


@query
def op5_line_dedup(spark, sf):
    kept = linededup.dedup_lines(read(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, r.k IS NOT NULL AND doc_id <> r.last AS gone FROM keyed LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_cross_polytope(spark, sf):
    return crosspolytope.search(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_maglev_placement(spark, sf):
    return maglev.place(read(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


ORACLE["op7_maglev_placement"] = maglev.place_sql("documents", "doc_id", SHARDS)


@query
def op8_latent_decontamination(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    leaks = decontam.find_leaks(docs, read(spark, sf, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op9_toxicity_mil(spark, sf):
    docs = read(spark, sf, "documents")
    model = toxicity.train_model(docs, read(spark, sf, "labels"), ~toxicity.is_held_out())
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.is_held_out(), F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"),
        "n_sentences",
        "worst_sentence",
        "worst_score",
    )


@query
def op10_site_style_tree(spark, sf):
    pages = sitetree.extract_pages(read(spark, sf, "pages").select("page_id", "url", "html"))
    text = F.col("main_text")
    return pages.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


@query
def op13_importance_resampling(spark, sf):
    drawn = resample.resample(read(spark, sf, "documents"), read(spark, sf, "benchmark"), share=25, min_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query
def op12_merkle_fingerprints(spark, sf):
    found = merkle.fingerprints(read(spark, sf, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


ORACLE["op12_merkle_fingerprints"] = merkle.fingerprint_sql("documents")


@query
def op11_xtok_alignment(spark, sf):
    return xtok.align_documents(read(spark, sf, "documents"), a_file="byte_bpe_50k.json", b_file="piece_bpe_32k.model")
