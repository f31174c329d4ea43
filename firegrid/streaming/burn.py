"""Streaming twin of the annual burn flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.grid import CELL
from firegrid.operators.masks import filter_months


def burn_flag_stream(
    stream: DataFrame, watermark: str = "400 days", months: tuple[int, int] | None = None, flag: str = "burnt"
) -> DataFrame:
    """OR of burn flags per cell and year over an unbounded input.

    The state is one flag per cell and open year. The watermark lets a year go once no
    later observation can reach it: the year's last day stands as event time, so
    state is dropped ``watermark`` after the turn of the year. Run it in update or
    append mode; on the same rows the result equals the batch operator's.
    """
    rows = filter_months(stream, *months) if months else stream
    year_end = F.make_date(F.year("t"), F.lit(12), F.lit(31)).cast("timestamp")
    return (
        rows.withColumn("year_end", year_end)
        .withWatermark("year_end", watermark)
        .groupBy(*CELL, "year_end")
        .agg(F.max(F.col(flag).cast("int")).alias(flag))
        .withColumn("year", F.year("year_end"))
    )


def run_to_table(flags: DataFrame, path: str) -> DataFrame:
    """Drain the available input into a table and return its current state.

    Every micro-batch writes its changed groups under its own batch number, so a batch replayed after a
    failure replaces itself; the newest version of a group is its largest flag.
    """
    from pyspark.sql import SparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/flags/batch={number}")

    query = (
        flags.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = SparkSession.getActiveSession()
    out = spark.read.parquet(f"{path}/flags")
    return out.groupBy(*CELL, "year").agg(F.max("burnt").alias("burnt"))
