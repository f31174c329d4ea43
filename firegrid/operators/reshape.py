"""Reshaping and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec, as_col
from firegrid.operators.joins import reindex_nearest

SEASONS = ("DJF", "MAM", "JJA", "SON")


def sort_out(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Total order for output (R1); range partitioned, so no single-task sort."""
    return df.orderBy(*cols)


def season_columns(df: DataFrame, var: str, keys: Sequence[str] = CELL, value: str = "value") -> DataFrame:
    """Season rows to columns ``<var>DJF`` ... in fixed order (R2)."""
    aggs = [F.avg(F.when(F.col("season") == s, F.col(value))).alias(f"{var}{s}") for s in SEASONS]
    return df.groupBy(*keys).agg(*aggs)


def to_pixel_rows(df: DataFrame) -> DataFrame:
    """Stacking pixels (R3) is the identity here: a long table is already one row per pixel and step."""
    return df


def unpivot_events(df: DataFrame, ids: Sequence[str], prefixes: Sequence[str], n: int) -> DataFrame:
    """Repeated column groups ``Frame01, Date01, Frame02 ...`` to one row per event.

    An event whose columns are all empty gives no row.
    """
    events = []
    for i in range(1, n + 1):
        fields = [
            (F.col(f"{p}{i:02d}") if f"{p}{i:02d}" in df.columns else F.lit(None)).alias(p.lower()) for p in prefixes
        ]
        events.append(F.struct(F.lit(i).alias("ev"), *fields))
    names = [p.lower() for p in prefixes]
    long = df.select(*ids, F.inline(F.array(*events)))
    return long.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names]))


def densify(df: DataFrame, keys: DataFrame, steps: Sequence[int], step: str = "year") -> DataFrame:
    """Complete key x step table, existing rows joined on.

    The steps are exploded per key, so no cross join is planned.
    """
    frame = keys.withColumn(step, F.explode(F.array(*[F.lit(s) for s in steps])))
    return frame.join(df, [*keys.columns, step], "left")


def upsample_nn(df: DataFrame, k: int) -> DataFrame:
    """Every cell repeated k x k times on the finer grid."""
    fine = F.sequence(F.lit(0), F.lit(k - 1))
    return (
        df.withColumn("_i", F.explode(fine))
        .withColumn("_j", F.explode(fine))
        .withColumns(
            {
                "lat_idx": (F.col("lat_idx") * k + F.col("_i")).cast("int"),
                "lon_idx": (F.col("lon_idx") * k + F.col("_j")).cast("int"),
            }
        )
        .drop("_i", "_j")
    )


def lattice_sample(df: DataFrame, g: GridSpec, step_deg: float) -> DataFrame:
    """Regular subsample of a fine grid, one cell per ``step_deg``."""
    coarse = GridSpec(
        g.lat0,
        g.lon0,
        step_deg if g.dlat > 0 else -step_deg,
        step_deg,
        int(abs(g.dlat) * (g.nlat - 1) / step_deg + 1e-9) + 1,
        int(abs(g.dlon) * (g.nlon - 1) / step_deg + 1e-9) + 1,
    )
    return reindex_nearest(df, g, coarse)


def band_combos(
    pixels: DataFrame, combos: Mapping[str, Sequence[int]], keys: Sequence[str] = ("scene", "y", "x")
) -> DataFrame:
    """Bands of every named combination, in its order (R8). A band may be part of several."""
    table = [
        F.struct(F.lit(name).alias("combo"), F.lit(pos).alias("pos"), F.lit(b).alias("b"))
        for name, bands in combos.items()
        for pos, b in enumerate(bands)
    ]
    hit = F.filter(F.array(*table), lambda c: c["b"] == F.col("band"))
    return pixels.select(*keys, "band", "value", F.inline(hit)).drop("b")


def arg_extreme(df: DataFrame, by: Sequence[str], key: str, value: str, how: str = "max") -> DataFrame:
    """Key of the largest or smallest value of each group (R9); ties go to the smallest key."""
    sign = -1 if how == "max" else 1
    best = F.min(F.struct((F.col(value) * sign).alias("v"), F.col(key).alias("k")))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, F.col("_b.k").alias(key), (F.col("_b.v") * sign).alias(value))
    )


def pivot_series(df: DataFrame, row: str, step: str, value: str, steps: Sequence) -> DataFrame:
    """Long series to a row x step matrix for export."""
    return df.groupBy(row).pivot(step, list(steps)).agg(F.first(value, ignorenulls=True))


def stack_time(*dfs: DataFrame) -> DataFrame:
    """Tables of different periods as one."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def any_of(*flags: Column | str) -> Column:
    """OR of masks."""
    return reduce(lambda a, b: a | b, [as_col(f) for f in flags])


def all_of(*flags: Column | str) -> Column:
    """AND of masks."""
    return reduce(lambda a, b: a & b, [as_col(f) for f in flags])


def distinct_years(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Years seen in either list (U4)."""
    return a.select(*keys, "year").union(b.select(*keys, "year")).distinct()


def clean_values(df: DataFrame, col: str, exact: Mapping[str, str]) -> DataFrame:
    """Known bad labels replaced by their right form."""
    return df.na.replace(dict(exact), subset=[col])


def rate_difference_interval(a: Column | str, b: Column | str) -> Column:
    """Interval of what is in rate ``a`` but not in ``b``: 1/(a-b), NULL where nothing is left."""
    diff = as_col(a) - as_col(b)
    return F.lit(1.0) / F.when(diff > 0, diff)
