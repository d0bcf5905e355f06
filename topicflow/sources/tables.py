"""Parquet tables, written in replaceable batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



MARKER = "_compaction"


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` with its fixed schema, empty when nothing was
    written yet. Includes ``batch_id`` when the table is written in batches.
    A compaction that stopped half way is finished first."""
    hpath, fs = _fs(spark, path)
    full = f"{schema}, batch_id BIGINT"
    if not fs.exists(hpath):
        return spark.createDataFrame([], full)
    finish_compaction(spark, path)
    return spark.read.schema(full).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch as its own partition. Replaying the batch replaces
    the partition, also by an empty one, so its rows are never doubled or left."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what an earlier attempt of the batch has written."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={int(batch_id)}")
    hpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hpath, True)


def _batches(spark: SparkSession, path: str) -> list[int]:
    hpath, fs = _fs(spark, path)
    if not fs.exists(hpath):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(hpath)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id="))


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Roll a committed compaction forward: its marker names the bound, the target batch and the
    staged rows. While the staged folder exists, the old folders (target included) go and it takes
    the target's place; afterwards only old folders other than the target are left to delete."""
    marker, fs = _fs(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        return
    stream = fs.open(marker)
    try:
        found = json.loads(stream.readUTF())
        up_to, target, staged = found["up_to"], found["target"], found["staged"]
    finally:
        stream.close()
    staged_path, _ = _fs(spark, staged)
    if fs.exists(staged_path):
        for batch_id in _batches(spark, path):
            if batch_id < up_to:
                drop_batch(spark, path, batch_id)
        fs.rename(staged_path, _fs(spark, f"{path}/batch_id={target}")[0])
    else:
        for batch_id in _batches(spark, path):
            if batch_id < up_to and batch_id != target:
                drop_batch(spark, path, batch_id)
    fs.delete(marker, False)


def compact_batches(spark: SparkSession, path: str, schema: str, up_to: int, files: int = 1) -> int:
    """Merge the partitions of batches below ``up_to`` into the one before it.

    Returns the number of merged partitions. ``up_to`` must not be above the
    oldest batch that may still be replayed, and the table's rows must not
    carry meaning in their batch number. Streams that read the table by file see
    the merged rows again; ``score_batch`` skips news it has handled.

    The merged rows are staged beside the table; a marker written by rename commits
    them; then the old folders go and the staged one takes the last one's place. A
    crash before the marker leaves the table as it was, after it ``read_table`` (or
    the next compaction) finishes the job: rows are never doubled or lost.
    """
    finish_compaction(spark, path)
    table = read_table(spark, path, schema)
    old = [b for b in _batches(spark, path) if b < up_to]
    if len(old) < 2:
        return 0
    staged = f"{path.rstrip('/')}-staged-{up_to}"
    table.where(F.col("batch_id") < up_to).drop("batch_id").coalesce(files).write.mode("overwrite").parquet(staged)
    marker, fs = _fs(spark, f"{path}/{MARKER}")
    temporary, _ = _fs(spark, f"{path}/{MARKER}.tmp")
    stream = fs.create(temporary, True)
    try:
        stream.writeUTF(json.dumps({"up_to": int(up_to), "target": max(old), "staged": staged}))
    finally:
        stream.close()
    fs.rename(temporary, marker)  # the commit
    finish_compaction(spark, path)
    return len(old)


def append_reports(reports: DataFrame, path: str) -> None:
    """Append reports; an empty frame adds no rows."""
    reports.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
