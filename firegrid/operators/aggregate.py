"""Aggregations over time, space and classes.

Everything combines partially before its exchange. Exact percentiles go through
:mod:`firegrid.operators.ordered`, except inside blocks whose size is fixed by
the block factor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions.decode import right_closed_bin, season_of, season_year
from firegrid.functions.geo import cos_weight
from firegrid.grid import CELL, GridSpec
from firegrid.operators.ordered import exact_percentiles, weighted_quantiles


def annual_any(df: DataFrame, flag: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Burned at any time of the year (A1)."""
    return df.groupBy(*keys, "year").agg(F.bool_or(F.col(flag)).alias(flag))


def annual_max(df: DataFrame, col: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Annual maximum (A2)."""
    return df.groupBy(*keys, "year").agg(F.max(col).alias(col))


def monthly_max(df: DataFrame, col: str, keys: Sequence[str] = CELL, t: str = "t") -> DataFrame:
    """Monthly maximum (A3)."""
    return df.groupBy(*keys, F.trunc(t, "MM").alias("month_start")).agg(F.max(col).alias(col))


def annual_reduce(df: DataFrame, how_by_var: Mapping[str, str], keys: Sequence[str] = CELL) -> DataFrame:
    """Annual sum or mean, chosen per variable (A4); columns keep the variable's name."""
    how = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    return df.groupBy(*keys, "year").agg(*[how[h](v).alias(v) for v, h in how_by_var.items()])


def season_reduce(
    df: DataFrame,
    cols: Mapping[str, str],
    convention: str = "dec_shift",
    keys: Sequence[str] = CELL,
) -> DataFrame:
    """Sum or mean per season of a year (A5), for either December convention."""
    how = {"sum": F.sum, "mean": F.avg}
    return df.groupBy(
        *keys, season_year("year", "month", convention).alias("season_year"), season_of("month").alias("season")
    ).agg(*[how[h](c).alias(c) for c, h in cols.items()])


def season_climatology(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = CELL, period: tuple[int, int] | None = None
) -> DataFrame:
    """Mean per season over all months of a period (A6); all years by default."""
    if period:
        df = df.where(F.col("year").between(*period))
    return df.groupBy(*keys, season_of("month").alias("season")).agg(*[F.avg(c).alias(c) for c in cols])


def annual_burned_fraction(
    df: DataFrame, n_years: int, flag: str = "burnt", keys: Sequence[str] = CELL, out: str = "AnBF"
) -> DataFrame:
    """Share of years burned (A7). Years without a row count as not burned, so the
    sparse table of burned observations is enough and no dense cube is built.

    The burned years of a cell are a set, merged before the single exchange and bounded by the calendar.
    """
    burned = df.where(F.col(flag).cast("boolean") & F.col("year").isNotNull())
    return burned.groupBy(*keys).agg((F.size(F.collect_set("year")) / F.lit(float(n_years))).alias(out))


_REDUCERS = {
    "mean": F.avg,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "count": F.count,
}


def coarsen(
    df: DataFrame,
    col: str,
    ky: int,
    kx: int,
    how: str = "mean",
    boundary: str = "pad",
    skipna: bool = True,
    g: GridSpec | None = None,
    part: Sequence[str] = (),
    out: str | None = None,
) -> DataFrame:
    """Blocks of ky x kx cells (A8), one input row per cell (and ``part``). ``trim`` drops incomplete edge blocks (needs the
    grid), ``pad`` keeps them. Without ``skipna`` one missing cell empties its block.
    """
    out = out or col
    if boundary == "trim":
        if g is None:
            raise ValueError("trim needs the grid")
        df = df.where((F.col("lat_idx") < g.nlat // ky * ky) & (F.col("lon_idx") < g.nlon // kx * kx))
    blocks = df.withColumns(
        {
            "lat_idx": F.expr(f"CAST(lat_idx DIV {ky} AS INT)"),
            "lon_idx": F.expr(f"CAST(lon_idx DIV {kx} AS INT)"),
        }
    )
    if how == "mode":
        # most frequent value, smallest on ties: two combinable aggregates
        counted = blocks.where(F.col(col).isNotNull()).groupBy(*part, *CELL, col).agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy(*part, *CELL).agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(out))
    value = _REDUCERS[how](F.col(col))
    if not skipna:
        value = F.when(F.count(col) == F.count(F.lit(1)), value)
    return blocks.groupBy(*part, *CELL).agg(value.alias(out))


def coarsen_fraction(df: DataFrame, cond: Column, ky: int, kx: int, out: str = "fraction", **kw) -> DataFrame:
    """Share of cells per block meeting a condition."""
    return coarsen(df.withColumn("_hit", cond.cast("double")), "_hit", ky, kx, "mean", out=out, **kw)


def annual_sum(df: DataFrame, col: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Monthly fractions summed over the year (A10)."""
    return df.groupBy(*keys, "year").agg(F.sum(col).alias(col))


def regional_series(df: DataFrame, mask: DataFrame, col: str, t: str = "t", flag: str = "mask") -> DataFrame:
    """Mean over the masked region per time step."""
    kept = df.join(mask.where(F.col(flag)).select(*CELL), list(CELL), "left_semi")
    return kept.groupBy(t).agg(F.avg(col).alias(col))


def coslat_fraction(df: DataFrame, pred: Column, valid: Column, lat: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """cos(latitude)-weighted share of valid cells meeting a predicate."""
    w = cos_weight(lat)
    return df.groupBy(*by).agg(
        (F.sum(F.when(valid & pred, w).otherwise(0.0)) / F.sum(F.when(valid, w))).alias("fraction")
    )


def area_sum(df: DataFrame, pred: Column, g: GridSpec, by: Sequence[str] = (), out: str = "km2") -> DataFrame:
    """Area in km2 of the cells meeting a predicate."""
    return df.groupBy(*by).agg(F.sum(F.when(pred, g.area_km2()).otherwise(0.0)).alias(out))


def weighted_mean_std(df: DataFrame, x: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and standard deviation, ddof 0 (A14), in two passes over the data for precision."""
    by = list(by)
    kept = df.where(F.col(x).isNotNull() & F.col(w).isNotNull())
    mean = kept.groupBy(*by).agg((F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("mean"))
    named = mean.select(*[F.col(c).alias(f"_{c}") for c in by], "mean")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]  # NULL is a group like any other
    both = kept.join(named, same).drop(*[f"_{c}" for c in by]) if by else kept.join(F.broadcast(mean))  # one row: the mean itself
    dev = F.pow(F.col(x) - F.col("mean"), 2)
    return both.groupBy(*by, "mean").agg(F.sqrt(F.sum(F.col(w) * dev) / F.sum(w)).alias("std"))


def interval_shares(
    df: DataFrame, x: str, edges: Sequence[float], w: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Weighted share of values in disjoint classes ``(e[i-1], e[i]]``, the first from -inf."""
    valid = F.col(x).isNotNull()
    total = F.sum(F.when(valid, w))
    cols, below = [], None
    for e in edges:
        hit = F.col(x) <= e if below is None else (F.col(x) > below) & (F.col(x) <= e)
        label = f"{below or 0:g}_{e:g}"
        part = F.sum(F.when(hit, w).otherwise(0.0))
        cols += [(part / total).alias(f"share_{label}"), part.alias(f"sum_{label}")]
        below = e
    return df.groupBy(*by).agg(*cols)


def class_shares(df: DataFrame, cls: str, w: Column, by: Sequence[str] = ()) -> DataFrame:
    """Percent and weight of every class."""
    sums = df.where(F.col(cls).isNotNull()).groupBy(*by, cls).agg(F.sum(w).alias("weight"))
    # at most one row per class: a small table
    return sums.withColumn("percent", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)) * 100)


def trend_summary(df: DataFrame, slope: str = "slope", sig: str = "reject", by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread, extremes and the shares of significant rise, fall and no change."""
    n = F.count(slope)
    s, ok = F.col(slope), F.coalesce(F.col(sig), F.lit(False))
    return df.groupBy(*by).agg(
        F.avg(slope).alias("mean"),
        F.stddev_pop(slope).alias("sd"),
        F.var_pop(slope).alias("var"),
        F.max(slope).alias("max"),
        F.min(slope).alias("min"),
        (F.count_if(ok & (s > 0)) / n).alias("sig_up"),
        (F.count_if(ok & (s < 0)) / n).alias("sig_down"),
        (F.count_if(s.isNotNull() & ~(ok & (s != 0))) / n).alias("no_change"),
    )


def ratio_of_totals(a: DataFrame, b: DataFrame, col: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Ratio of two totals per block (A19); NULL where the lower one is zero."""
    ta = a.groupBy(*keys).agg(F.sum(col).alias("_a"))
    tb = b.groupBy(*keys).agg(F.sum(col).alias("_b"))
    return ta.join(tb, list(keys)).select(*keys, (F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0))).alias("ratio"))


def histogram(
    df: DataFrame, x: str, bins: int, lo: float, hi: float, by: Sequence[str] = (), w: Column | None = None
) -> DataFrame:
    """Equal-width histogram, normalised per group (A23). The last bin is closed; values outside are left out."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    weight = F.lit(1.0) if w is None else w
    counts = (
        df.where(F.col(x).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.sum(weight).alias("weight"))
    )
    # bins per group are few, whatever the group holds
    return counts.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*by)))


def percentiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles (A24), safe for groups of any size."""
    return exact_percentiles(df, x, probs, by)


def weighted_percentiles(df: DataFrame, x: str, w: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Weighted quantiles."""
    return weighted_quantiles(df, x, w, probs, by)


def block_significance(
    df: DataFrame, k: int, sig: str, g: GridSpec, sig_frac: float | None = None, nan_frac: float | None = None
) -> DataFrame:
    """Blocks to be stippled (A25) with their median position.

    A block counts when the significant share exceeds ``sig_frac`` and fewer than
    ``nan_frac`` of its cells are missing. Without a ``nan_frac`` the share is taken of
    all k*k cells and must reach ``sig_frac``.
    """
    s = F.col(sig)
    agg = df.groupBy(
        F.expr(f"CAST(lat_idx DIV {k} AS INT)").alias("by"), F.expr(f"CAST(lon_idx DIV {k} AS INT)").alias("bx")
    ).agg(
        F.sum(F.coalesce(s.cast("double"), F.lit(0.0))).alias("n_sig"),
        F.count(s).alias("n_valid"),
        F.count(F.lit(1)).alias("n_cells"),
        F.percentile(g.lat(), F.lit(0.5)).alias("lat"),
        F.percentile(g.lon(), F.lit(0.5)).alias("lon"),
    )
    if nan_frac is None:
        keep = F.col("n_sig") / F.lit(float(k * k)) >= sig_frac
    else:
        keep = (F.col("n_sig") / F.nullif(F.col("n_valid"), F.lit(0)) > sig_frac) & (
            1 - F.col("n_valid") / F.col("n_cells") < nan_frac
        )
    return agg.where(keep)


def ensemble_mean(dfs: Sequence[DataFrame], col: str, keys: Sequence[str]) -> DataFrame:
    """Mean of several rasters, missing ones skipped (A28): union and one aggregate."""
    stacked = None
    for d in dfs:
        part = d.select(*keys, col)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(F.avg(col).alias(col))


def confusion_matrix(
    df: DataFrame, obs: str, pred: str, edges: Sequence[float], normalize: str | None = "true"
) -> DataFrame:
    """Dense class-by-class counts (A29) over right-closed bins, normalised by observed class."""
    n = len(edges) - 1
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    frame = (
        df.sparkSession.range(1)
        .select(F.explode(ids).alias("obs_bin"))
        .select("obs_bin", F.explode(ids).alias("pred_bin"))
    )
    counts = (
        df.select(right_closed_bin(obs, edges).alias("obs_bin"), right_closed_bin(pred, edges).alias("pred_bin"))
        .where(F.col("obs_bin").isNotNull() & F.col("pred_bin").isNotNull())
        .groupBy("obs_bin", "pred_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dense = frame.join(counts, ["obs_bin", "pred_bin"], "left").na.fill(0, ["n"])
    if normalize != "true":
        return dense
    total = F.sum("n").over(Window.partitionBy("obs_bin"))
    return dense.withColumn("share", F.col("n") / F.nullif(total, F.lit(0)))


def box_numbers(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    return exact_percentiles(df, x, (0.0, 0.25, 0.5, 0.75, 1.0), by).withColumnsRenamed(
        {"q0": "min", "q1": "q25", "q2": "median", "q3": "q75", "q4": "max"}
    )


def regional_burned_fraction(df: DataFrame, burned: str, years: Sequence[int] | None = None) -> DataFrame:
    """Burned share of a region per year (A31): steps are summed per cell, then burned
    cells over valid cells.
    """
    if years:
        df = df.where(F.col("year").isin(*years))
    cells = df.groupBy(*CELL, "year").agg(F.sum(F.col(burned).cast("double")).alias("b"))
    return cells.groupBy("year").agg((F.sum("b") / F.count("b")).alias("fraction"))


def mean_annual_max(df: DataFrame, col: str, start: int, end: int, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean over the years of the annual maximum (A33); both levels share the cell's partitioning."""
    years = annual_max(df.where(F.col("year").between(start, end)), col, keys)
    return years.groupBy(*keys).agg(F.avg(col).alias(col))


def forest_rule(
    df: DataFrame, cover: str, nonforest: str, ky: int, kx: int, min_cover: float = 0.3, max_nonforest: float = 0.4
) -> DataFrame:
    """Forest by two criteria per block (A34): mean cover and share of non-forest."""
    out = df.groupBy(
        F.expr(f"CAST(lat_idx DIV {ky} AS INT)").alias("lat_idx"),
        F.expr(f"CAST(lon_idx DIV {kx} AS INT)").alias("lon_idx"),
    ).agg(F.avg(cover).alias("cover"), F.avg(nonforest).alias("nonforest"))
    return out.withColumn(
        "forest", F.coalesce((F.col("cover") >= min_cover) & (F.col("nonforest") <= max_nonforest), F.lit(False))
    )


def post_event_anomaly(
    data: DataFrame, events: DataFrame, years: int = 4, key: str = "site", x: str = "year", y: str = "value"
) -> DataFrame:
    """Mean standardised anomaly in the years after an event.

    ``events``: one row per key with ``event``. Mean and spread are aggregates joined
    back, so a long series is never held in a window.
    """
    stats = data.groupBy(key).agg(F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s")).join(events, key)
    z = (F.col(y) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    after = data.join(stats, key).where((F.col(x) > F.col("event")) & (F.col(x) <= F.col("event") + years))
    return after.groupBy(key).agg(F.avg(z).alias("anomaly"), F.count(z).alias("n"))
