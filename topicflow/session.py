"""Session settings, shared working storage and bounded driver reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

_SCRATCH: list[str] = []


def build_session(app: str = "topicflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew join)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the cluster's ``spark.checkpoint.dir``, or the folder given to
    ``setCheckpointDir``. Only a session inside one JVM without either gets a
    temporary folder; on a cluster that would lose data with a host.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(spark, "_topicflow_root", None)
    root = root or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="topicflow-")
    spark._topicflow_root = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{work_root(spark)}/topicflow/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this process made; returns how many there were.

    For use between jobs, when no result that reads them is still needed.
    """
    paths, hadoop = list(_SCRATCH), spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
        _SCRATCH.remove(path)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, surviving lost executors."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fetch_bounded(df: DataFrame, limit: int) -> list[Row] | None:
    """At most ``limit`` rows on the driver, or None when there are more."""
    rows = df.take(limit + 1)
    return rows if len(rows) <= limit else None


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    Spark knows the size of such a table, so it broadcasts it in a join only
    below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Let Python workers get Arrow batches of at most ``rows`` rows and about ``size`` bytes.

    Batches of Spark's 10 000 rows hold a task's whole texts several times over, in the executor's direct
    memory and in the worker. Smaller limits that the session has already are kept.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = number_of(spark.conf.get(key))
        if not 0 < now <= number_of(most):
            spark.conf.set(key, most)


def number_of(value: int | str) -> int:
    """A count or a size like ``64m``, in units or bytes."""
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", str(value).strip().lower()).groups()
    return int(number) * 1024 ** "bkmgt".index(unit or "b")
