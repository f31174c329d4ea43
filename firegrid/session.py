"""Session helpers: settings every plan in the package relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # result tables are rewritten one product/band at a time
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# shuffle blocks of this size fit an executor's memory with room for sorting
PARTITION_BYTES = 256 * 1024**2


def shuffle_partitions(input_bytes: int, least: int = 200) -> int:
    """Partitions to start from for a job over that much data; AQE merges what turns out small."""
    return max(least, -(-input_bytes // PARTITION_BYTES))


def get_spark(app: str = "firegrid", master: str | None = None, input_bytes: int | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session. Cluster sizing is left to spark-submit and ``extra``.

    ``input_bytes``: size of the data a job reads; its shuffles then start from partitions of ``PARTITION_BYTES``.
    """
    if input_bytes is not None:
        extra = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_partitions(input_bytes)), **extra}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder, one per application, is made only in local mode, where the executors are this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="firegrid-")
        return _LOCAL[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch path once what was read from it is stored elsewhere; nothing happens where it is gone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for loops whose plan would otherwise keep growing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
