from pyspark.sql import functions as F

from topicflow.operators import components


def test_spread_join_equals_plain_join_with_a_hot_key(spark):
    left = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("_new"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("_new"), (F.col("id") * 10).alias("_root"))
    got = components._spread_join(left, right, "_new", "node", parts=100)
    want = left.join(right, "_new", "left")
    assert sorted(got.select("node", "_new", "_root").collect()) == sorted(want.select("node", "_new", "_root").collect())
    # the hot label's rows went to several salts
    salted = left.join(F.broadcast(spark.createDataFrame([(7, 34)], "_new long, _salts int")), "_new")
    assert salted.select(F.pmod(F.xxhash64("node"), F.col("_salts")).alias("s")).distinct().count() > 10
