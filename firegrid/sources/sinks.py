"""Writing results, provenance and resumable parts."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, parts: Sequence[str] = (), force: bool = False) -> None:
    """Write only when absent, unless forced.

    With ``parts`` this holds for every combination of partition values by itself: what is there stays, what
    is not is added, and a forced write replaces just the partitions it carries. Rows are rebalanced
    by the partition columns, so a large partition is written by many tasks and no task opens many files.
    """
    if not parts:
        df.write.mode("overwrite" if force else "ignore").parquet(path)
        return
    if not force and _exists(df.sparkSession, path):
        there = df.sparkSession.read.parquet(path).select(*[F.col(p).alias(f"_{p}") for p in parts]).distinct()
        # values are compared as the folder names they become
        df = df.join(there, [F.col(p).cast("string").eqNullSafe(F.col(f"_{p}").cast("string")) for p in parts], "left_anti")
    mode = "overwrite" if force else "append"
    df.hint("rebalance", *parts).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_table(df: DataFrame, path: str) -> None:
    """Result table as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def code_version() -> str:
    """Commit of the folder this package lies in."""
    try:
        done = subprocess.run(["git", "-C", os.path.dirname(os.path.abspath(__file__)), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
        return done.stdout.strip() or "unknown"
    except OSError:
        return "unknown"


def provenance(spark: SparkSession, title: str, summary: str, inputs: Mapping[str, str]) -> DataFrame:
    """One row saying what was made, from what, by which code and when."""
    pairs = [F.lit(x) for kv in sorted(inputs.items()) for x in kv]
    return spark.range(1).select(
        F.lit(title).alias("title"),
        F.lit(summary).alias("summary"),
        F.create_map(*pairs).alias("inputs") if pairs else F.lit(None).cast("map<string,string>").alias("inputs"),
        F.lit(code_version()).alias("code_version"),
        F.current_timestamp().alias("created"),
    )


def append_provenance(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def split_vars(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("lat_idx", "lon_idx")) -> dict[str, DataFrame]:
    """One narrow table per variable."""
    return {v: df.select(*keys, F.col(v).alias("value")) for v in names}


def pending_bands(all_bands: DataFrame, done: DataFrame, key: str = "lat_band") -> DataFrame:
    """Bands not yet in the done-table (S9); NULL is a band."""
    there = done.select(F.col(key).alias("_done")).distinct()
    return all_bands.select(key).distinct().join(there, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def write_pending(df: DataFrame, path: str, key: str = "lat_band") -> None:
    """Compute and store only the bands missing under ``path``; safe to rerun after a loss.

    Which bands exist is read back from the stored table; a band is visible only
    once its write job committed, and stays if a later one is lost. Every band is a job of its own whose tasks write their rows as they
    come: none is sorted or exchanged, so a task's memory does not depend on the size of a band. ``df`` is read once
    per pending band; the driver sees their values only.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    if _exists(spark, path):
        pending = pending_bands(df, spark.read.parquet(path).select(key), key)
    else:
        pending = df.select(key).distinct()
    bands = [r[0] for r in pending.collect()]
    for band in bands:
        value = F.lit(band).cast(kind)
        # a constant needs no sort before it names the folder
        df.where(F.col(key).eqNullSafe(value)).withColumn(key, value).write.mode("append").partitionBy(key).parquet(path)
    if not bands:
        df.limit(0).write.mode("append").partitionBy(key).parquet(path)


def validity(df: DataFrame, col: str, hi: float = 1.0) -> DataFrame:
    """Largest value, number of values and the verdict of the output check."""
    return df.agg(F.max(col).alias("max_value"), F.count(col).alias("n_values")).withColumn(
        "valid", (F.col("n_values") > 0) & F.coalesce(F.col("max_value") <= hi, F.lit(False))
    )


def check_valid(df: DataFrame, col: str, hi: float = 1.0) -> bool:
    return bool(validity(df, col, hi).first()["valid"])
