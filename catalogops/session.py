"""Session settings the operators count on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Only settings that change plans; sizes (memory, shuffle partitions) are the cluster's to choose.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_local_folders: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Bound by bytes the batches that Python workers are sent, unless the cluster has its own bound.

    Spark's bound is ten thousand rows: of whole texts that is far more than a task should hold, in the
    executor's buffers and again in its worker, which keeps what it has taken.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "4m")


def work_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master that names none, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    already = context.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="catalogops-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
