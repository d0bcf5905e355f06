"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.session import cut_lineage


def _spread_join(left: DataFrame, right: DataFrame, key: str, tell_apart: str, parts: int = 1000, total: int | None = None) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per key) on ``key``. A key with more than one
    ``parts``-th of the left rows, such as the label of a huge component, is spread over as many salts
    as it has such shares, and its right row is repeated once per salt: no task gets all its rows.
    At most ``parts`` keys are hot, so their table is broadcast. ``total`` is the number of left rows, if known."""
    total = left.count() if total is None else total
    each = max(1, -(-total // parts))
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > each)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / each).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(tell_apart), salts).cast("int"))
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"], "left").drop("_salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` with the smallest node id of each component.

    Each round takes the smallest label among the neighbours and then follows
    label pointers once, so chains shrink geometrically; rounds go on until no
    label changes. Labels are checkpointed to shared storage per round, and
    those of the round before are released. Grouping by node is
    pre-aggregated, and the joins have one row per node on one side, so a hub
    with very many edges is split by AQE instead of landing in one task; the
    rows of a huge component's label are spread over salts when its pointer
    is looked up.
    """
    # one explode instead of a union, which would compute the edges twice
    ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
    both = edges.where("src <> dst").select(F.inline(F.array(*ends)))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_m")).select(
            "node", F.least("node", "_m").alias("component")
        )
    )
    total = labels.count()  # a round keeps every node
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("_c").alias("_c"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_c").alias("_new")
        )
        hooked = cut_lineage(hooked)
        pointers = hooked.select(F.col("node").alias("_new"), F.col("_new").alias("_root"))
        moved = cut_lineage(
            _spread_join(hooked, pointers, "_new", "node", total=total).select(
                "node", "_old", F.least("_new", F.coalesce("_root", "_new")).alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.where("component <> _old").isEmpty():
            return labels
