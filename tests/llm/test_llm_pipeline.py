"""The pipeline's stages against plain Python on a small table."""

import corpus_pipeline
from test_llm_dedup import brute_components, brute_lines, check_packing

from topicflow.llm import toxicity
from topicflow.llm.common import number_of
from topicflow.llm.queries import ORACLE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, table = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in table.collect()}
        out = stage(spark, table, SF)
        if name == "best-fit packing":
            tokenizer = Tokenizer.from_file(tokenizer_path())
            want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in before.items()}
            check_packing(out.collect(), want, 2048)
            break
        assert out.columns == columns
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in QUERIES["op9_toxicity_mil"](spark, SF).collect()}
            assert set(after) == {i for i in before if scores[i] < 0.7} and len(after) < len(before)
        elif name == "line dedup":
            assert after == {i: t for i, _, _, t in brute_lines(before.items())} and after != before
        elif name == "minhash near-dedup":
            root = brute_components(sorted(before.items()), 5, 4, 5)
            assert set(after) == {i for i in before if root[i][1] == i} and len(after) < len(before)
        else:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            flat = lambda t: " ".join(t.split())
            leaked = {i for i, t in before.items() if any(flat(x) in flat(t) for x in items)}
            assert set(after) == set(before) - leaked and leaked
        table = spark.createDataFrame(rows, docs.schema)


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {"doc_id", "sequence_id", "offset"} <= set(got[0].asDict())


def test_stages_bound_arrow_batches(spark):
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    before = {k: spark.conf.get(k) for k in (rows, size)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    try:
        for own, want in ((("10000", "64m"), ("1000", "8m")), (("0", "64m"), ("1000", "8m")), (("50", "1m"), ("50", "1m"))):
            for key, value in zip((rows, size), own, strict=True):
                spark.conf.set(key, value)
            corpus_pipeline.drop_repeated_lines(spark, docs, SF)
            assert [number_of(spark.conf.get(k)) for k in (rows, size)] == [number_of(x) for x in want]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_held_out_is_a_third(spark):
    n = spark.range(3000).where(toxicity.is_held_out("id")).count()
    assert 900 < n < 1100


def test_every_numbered_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)
