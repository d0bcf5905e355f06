import pytest
from pyspark.sql import functions as F

from topicflow.operators.idindex import IdIndex, bucket_of


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "external_id string")


def files_read(df):
    return df.select(F.input_file_name().alias("f")).where("f <> ''").distinct().count()


def test_index_prunes_and_finds(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "index"), buckets=16)
    batches = {n: [f"n{n}-{i}" for i in range(200)] for n in range(3)}
    for n, values in batches.items():
        index.add(ids(spark, values + [None, values[0]]), "external_id", n)
    index.add(ids(spark, batches[2]), "external_id", 2)  # a replay replaces, never doubles
    assert index.table().count() == 600

    probe = ["n0-5", "n1-7", "absent", None, "n2-9", "n2-9"]
    got = sorted(r[0] for r in index.lookup(ids(spark, probe), "external_id").collect())
    assert got == ["n0-5", "n1-7", "n2-9"]
    # the batch itself is left out when asked, as ingest does for a replay
    assert sorted(r[0] for r in index.lookup(ids(spark, probe), "external_id", exclude_batch=2).collect()) == ["n0-5", "n1-7"]

    # only the folders of the probe's buckets are opened
    buckets = {r[0] for r in ids(spark, probe).where("external_id IS NOT NULL").select(bucket_of(F.col("external_id"), 16)).collect()}
    pruned = index.table().where(F.col("bucket").isin(sorted(buckets)))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    assert files_read(pruned) <= 3 * len(buckets) < files_read(index.table())


def test_index_compact_and_empty(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "index"), buckets=4)
    assert index.lookup(ids(spark, ["a"]), "external_id").count() == 0
    for n in range(4):
        index.add(ids(spark, [f"x{n}", "shared"]), "external_id", n)
    assert index.compact(3) == 3
    assert sorted(r[0] for r in index.table().select("batch_id").distinct().collect()) == [-1, 3]
    assert index.table().count() == 6  # "shared" is in the merged folder and in batch 3
    found = index.lookup(ids(spark, ["x0", "x3", "shared", "nope"]), "external_id")
    assert sorted(r[0] for r in found.collect()) == ["shared", "x0", "x3"]
    assert index.compact(3) == 0


def test_index_built_from_store(spark, tmp_path):
    from topicflow.streaming import jobs

    tables = jobs.Tables(str(tmp_path / "t"))
    store = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), (None, 1)], "external_id string, batch_id bigint")
    store.write.partitionBy("batch_id").parquet(tables.incoming_news)
    index = IdIndex(spark, tables.news_id_index)
    index.build(spark.read.parquet(tables.incoming_news), "external_id")
    assert sorted((r.id, r.batch_id) for r in index.table().collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert sorted(r[0] for r in index.lookup(ids(spark, ["c", "a", "z"]), "external_id", exclude_batch=0).collect()) == ["c"]
