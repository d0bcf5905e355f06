"""An id index pruned by hash prefix, so a micro-batch opens only the files that may hold its ids.

The index at ``path`` is Parquet in folders ``batch_id=<n>/bucket=<b>``, where ``b`` is
``pmod(xxhash64(id), buckets)``. Within a bucket the ids of a batch are sorted and written with a
Parquet Bloom filter on ``id``. A lookup first finds the buckets of its ids (at most ``buckets``
values reach the driver), and Spark lists and opens only those buckets' folders (partition
pruning); up to ``IN_LIST`` distinct ids are also pushed to the Parquet reader as equalities, so
row groups whose Bloom filter or min/max excludes them are skipped. The rest is a semi join with the
batch's ids.

Adding the ids of a batch replaces that batch's folder: a replayed batch neither doubles nor keeps
stale ids. ``compact`` merges the folders of old batches into one, bucket by bucket. Null ids are
never indexed and never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
# up to this many ids are also pushed down as equalities (Bloom filters and statistics)
IN_LIST = 1000


def bucket_of(col: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


class IdIndex:
    """Ids by batch and hash bucket below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, id_type: str = "string"):
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        return hpath, hpath.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self) -> bool:
        hpath, fs = self._fs(self.path)
        return fs.exists(hpath)

    def _write(self, rows: DataFrame, folder: str) -> None:
        # one task per bucket of the batch; ids sorted inside it, so row groups cover narrow ranges
        rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#id", "true"
        ).partitionBy("bucket").parquet(folder)

    def add(self, ids: DataFrame, key: str, batch_id: int) -> None:
        """Index the distinct non-null ``key`` values of ``ids`` as batch ``batch_id`` (replacing it)."""
        rows = ids.select(F.col(key).cast(self.id_type).alias("id")).where(F.col("id").isNotNull()).distinct()
        self._write(rows.withColumn("bucket", bucket_of(F.col("id"), self.buckets)), f"{self.path}/batch_id={int(batch_id)}")

    def build(self, table: DataFrame, key: str, batch_col: str = "batch_id") -> None:
        """Index all rows of a table written in batches at once (for a store that has no index yet)."""
        rows = table.select(F.col(key).cast(self.id_type).alias("id"), F.col(batch_col).cast("bigint").alias("batch_id"))
        rows = rows.where(F.col("id").isNotNull()).distinct().withColumn("bucket", bucket_of(F.col("id"), self.buckets))
        rows.repartition("batch_id", "bucket").sortWithinPartitions("batch_id", "bucket", "id").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#id", "true"
        ).partitionBy("batch_id", "bucket").parquet(self.path)

    def drop(self, batch_id: int) -> None:
        hpath, fs = self._fs(f"{self.path}/batch_id={int(batch_id)}")
        fs.delete(hpath, True)

    def table(self) -> DataFrame:
        schema = f"id {self.id_type}, batch_id bigint, bucket int"
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def lookup(self, ids: DataFrame, key: str, exclude_batch: int | None = None) -> DataFrame:
        """The distinct ``key`` values of ``ids`` that the index holds (outside batch ``exclude_batch``)."""
        wanted = ids.select(F.col(key).cast(self.id_type).alias("id")).where(F.col("id").isNotNull()).distinct()
        buckets = sorted(r[0] for r in wanted.select(bucket_of(F.col("id"), self.buckets)).distinct().collect())
        index = self.table().where(F.col("bucket").isin(buckets))
        if exclude_batch is not None:
            index = index.where(F.col("batch_id") != F.lit(int(exclude_batch)))
        few = wanted.take(IN_LIST + 1)
        if len(few) <= IN_LIST:
            index = index.where(F.col("id").isin([r[0] for r in few]))
        return index.join(wanted, "id", "left_semi").select(F.col("id").alias(key)).distinct()

    def compact(self, up_to: int) -> int:
        """Merge the batches below ``up_to`` into one new folder with a batch number below all of them;
        returns how many were merged. The merged ids are written before the old folders go, so a crash
        in between leaves ids twice (lookups are distinct) and never loses one; compacting again
        finishes the job. ``up_to`` must not be above the oldest batch that may still be replayed."""
        old = self.table().where(F.col("batch_id") < F.lit(int(up_to)))
        numbers = sorted(r[0] for r in old.select("batch_id").distinct().collect())
        if len(numbers) <= 1:
            return 0
        target = min(numbers[0], 0) - 1
        self._write(old.select("id", "bucket").distinct(), f"{self.path}/batch_id={target}")
        for n in numbers:
            self.drop(n)
        return len(numbers)
