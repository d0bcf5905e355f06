import numpy as np
from pyspark.sql import functions as F

from topicflow.functions import text as tx
from topicflow.operators import dedupe
from topicflow.operators.neardup_index import NearDupIndex


def corpus(n=150, seed=1):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=60)) for _ in range(10)]
    texts = []
    for i in range(n):
        words = base[0 if i % 3 == 0 else i % 10].split()  # a third are near copies of one text
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, 60))] = "edit"
        texts.append(" ".join(words))
    texts += ["", "short", "short"]
    return list(enumerate(texts))


def batch_groups(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = dedupe.near_duplicate_groups(df, "id", tx.word_tokens(F.col("text"), 1))
    return {r["id"]: r["group"] for r in got.collect()}


def test_incremental_equals_batch(spark, tmp_path):
    rows = corpus()
    index = NearDupIndex(spark, str(tmp_path / "index"), block_rows=16)
    tokens = tx.word_tokens(F.col("text"), 1)
    for n, part in enumerate([rows[:50], rows[50:110], rows[110:]]):
        index.add(spark.createDataFrame(part, "id bigint, text string"), "id", tokens, n)
    index.add(spark.createDataFrame(rows[110:], "id bigint, text string"), "id", tokens, 2)  # a replay
    got = {r["id"]: r["group"] for r in index.groups().collect()}
    assert got == batch_groups(spark, rows)

    # deleting the smallest member of the big group, and a whole small group
    gone = [0, 1, 11, 21]
    index.delete(spark.createDataFrame([(i,) for i in gone], "id bigint"), "id", 3)
    got = {r["id"]: r["group"] for r in index.groups().collect()}
    assert got == batch_groups(spark, [r for r in rows if r[0] not in gone])
