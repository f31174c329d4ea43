"""Reading gridded products, tiles and lookup tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firegrid.grid import GridSpec


@dataclass(frozen=True)
class Product:
    """Registry entry of a product: where it lives, its variable, period and grid."""

    name: str
    path: str
    var: str
    start: int
    end: int
    grid: GridSpec | None = None
    rename: Mapping[str, str] = field(default_factory=dict)

    @property
    def n_years(self) -> int:
        return self.end - self.start + 1


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers of any kind as NULL, the one form that operators know."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_product(
    spark: SparkSession, path: str, cols: Sequence[str] | None = None, rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Read one product; only the wanted columns reach the scan."""
    df = spark.read.parquet(path)
    if cols:
        df = df.select(*cols)
    return nan_to_null(df.withColumnsRenamed(dict(rename or {})))


def read_multi(spark: SparkSession, paths: Sequence[str], check_shape: bool = True, step: str = "t") -> DataFrame:
    """Read many files as one time-stacked table.

    With ``check_shape`` every step must cover the same number of rows and
    columns of cells; the check is an aggregate, not a scan on the driver.
    """
    df = spark.read.option("mergeSchema", "false").parquet(*paths)
    if check_shape:
        shapes = step_shapes(df, step).select("n_lat", "n_lon").distinct().limit(2).collect()
        if len(shapes) > 1:
            raise ValueError("files do not share one grid shape")
    return nan_to_null(df)


def step_shapes(df: DataFrame, step: str = "t") -> DataFrame:
    """Axis lengths seen at every step. Two-level distinct, so one hot step is no problem."""
    rows = df.groupBy(step, "lat_idx").agg(F.max("lon_idx").alias("hi"), F.min("lon_idx").alias("lo"))
    return rows.groupBy(step).agg(
        F.count(F.lit(1)).alias("n_lat"), (F.max("hi") - F.min("lo") + 1).alias("n_lon")
    )


def mosaic(tiles: Sequence[DataFrame], offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Put tiles on one grid by shifting their cell indices (S3)."""
    out = None
    for tile, (dy, dx) in zip(tiles, offsets, strict=True):
        part = tile.withColumns(
            {
                "lat_idx": (F.col("lat_idx") + F.lit(dy)).cast("int"),
                "lon_idx": (F.col("lon_idx") + F.lit(dx)).cast("int"),
            }
        )
        out = part if out is None else out.unionByName(part)
    return out


def read_lookup(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV table with header, explicit types and an optional byte-order mark.

    Columns are matched by header name, so the file may hold more of them.
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.csv(path, header=True, multiLine=False, mode="FAILFAST", escape='"')
    clean = [c.lstrip("﻿").strip() for c in raw.columns]
    return raw.toDF(*clean).select(
        *[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in want.fields]
    )
