"""The news status log as a snapshot plus a tail, merged on read.

Status entries are appended per micro-batch to two logs: ``new`` entries by ingest and claims and
outcomes by scoring, each in ``batch_id=<n>`` folders. A snapshot folds every entry up to a batch of
each log into the latest entry per id (``store.current_status``), written as generation ``g`` in
folders ``gen=<g>/bucket=<b>`` with ``b = pmod(xxhash64(id), buckets)``. A marker file
``_current-<g>``, written under a temporary name and renamed, commits it; readers take the
highest marker, so a crash while writing leaves the previous generation in force.

``entries_for`` reads, for a batch's ids, only the snapshot folders of their buckets (partition
pruning; at most ``buckets`` values reach the driver) and the log batches after the snapshot's
bounds: a scoring batch no longer reads all status ever written. ``entries`` is the whole state:
snapshot rows (latest per id) and the tail. Snapshot bounds must stay below any batch that may
still be replayed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow import schemas
from topicflow.operators import store
from topicflow.operators.idindex import bucket_of
from topicflow.sources.tables import read_table

BUCKETS = 64
MARKER = "_current-"


class StatusLog:
    """Logs at ``new_path`` and ``scored_path``, snapshots below ``base_path``."""

    def __init__(self, spark: SparkSession, new_path: str, scored_path: str, base_path: str, buckets: int = BUCKETS):
        self.spark, self.new_path, self.scored_path, self.base_path, self.buckets = spark, new_path, scored_path, base_path, buckets

    def _fs(self, path: str):
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hpath, hpath.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def pointer(self) -> dict:
        """The committed snapshot: ``gen``, ``new_upto``, ``scored_upto`` (generation 0: none)."""
        hpath, fs = self._fs(self.base_path)
        marks = [s.getPath() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []
        marks = sorted((p for p in marks if p.getName().startswith(MARKER)), key=lambda p: p.getName())
        if not marks:
            return {"gen": 0, "new_upto": -1, "scored_upto": -1}
        stream = fs.open(marks[-1])
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _base(self, at: dict) -> DataFrame:
        schema = f"{schemas.NEWS_STATUS}, bucket int"
        if at["gen"] == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base_path}/gen={at['gen']}")

    def _tail(self, at: dict, exclude_scored: int | None = None) -> DataFrame:
        born = read_table(self.spark, self.new_path, schemas.NEWS_STATUS).where(F.col("batch_id") > at["new_upto"])
        scored = read_table(self.spark, self.scored_path, schemas.NEWS_STATUS).where(F.col("batch_id") > at["scored_upto"])
        if exclude_scored is not None:
            scored = scored.where(F.col("batch_id") != F.lit(int(exclude_scored)))
        return born.withColumn("batch_id", F.lit(None).cast("bigint")).unionByName(scored)

    def entries(self) -> DataFrame:
        """``id, status, error_message, updated_at, batch_id``: the snapshot (batch_id null) and the tail."""
        at = self.pointer()
        base = self._base(at).drop("bucket").withColumn("batch_id", F.lit(None).cast("bigint"))
        return base.unionByName(self._tail(at))

    def entries_for(self, ids: DataFrame, key: str = "id", exclude_scored: int | None = None) -> DataFrame:
        """The entries of the ids in ``ids``: their buckets of the snapshot and the tail."""
        at = self.pointer()
        wanted = ids.select(F.col(key).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
        buckets = sorted(r[0] for r in wanted.select(bucket_of(F.col("id"), self.buckets)).distinct().collect())
        base = self._base(at).where(F.col("bucket").isin(buckets)).drop("bucket").withColumn("batch_id", F.lit(None).cast("bigint"))
        return base.unionByName(self._tail(at, exclude_scored)).join(wanted, "id", "left_semi")

    def snapshot(self, new_upto: int, scored_upto: int) -> int:
        """Fold the log batches up to these bounds into a new generation; returns its number."""
        at = self.pointer()
        if new_upto <= at["new_upto"] and scored_upto <= at["scored_upto"]:
            return at["gen"]
        new_upto, scored_upto = max(new_upto, at["new_upto"]), max(scored_upto, at["scored_upto"])
        born = read_table(self.spark, self.new_path, schemas.NEWS_STATUS)
        born = born.where((F.col("batch_id") > at["new_upto"]) & (F.col("batch_id") <= new_upto))
        scored = read_table(self.spark, self.scored_path, schemas.NEWS_STATUS)
        scored = scored.where((F.col("batch_id") > at["scored_upto"]) & (F.col("batch_id") <= scored_upto))
        folded = self._base(at).drop("bucket").unionByName(born.drop("batch_id")).unionByName(scored.drop("batch_id"))
        latest = store.current_status(folded).withColumn("bucket", bucket_of(F.col("id"), self.buckets))
        gen = at["gen"] + 1
        latest.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.base_path}/gen={gen}"
        )
        temporary, fs = self._fs(f"{self.base_path}/_writing-{gen}")
        stream = fs.create(temporary, True)
        try:
            stream.writeUTF(json.dumps({"gen": gen, "new_upto": int(new_upto), "scored_upto": int(scored_upto)}))
        finally:
            stream.close()
        fs.rename(temporary, self._fs(f"{self.base_path}/{MARKER}{gen:012d}")[0])  # the commit
        for old in range(1, gen):
            for name in (f"gen={old}", f"{MARKER}{old:012d}"):
                path, _ = self._fs(f"{self.base_path}/{name}")
                fs.delete(path, True)
        return gen
