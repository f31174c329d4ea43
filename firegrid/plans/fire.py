"""Fire-regime products composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.functions.decode import clip, reciprocal_floor
from firegrid.grid import CELL, GridSpec
from firegrid.operators.aggregate import coarsen, coarsen_fraction, histogram
from firegrid.operators.joins import cells_near_points, reindex_nearest
from firegrid.operators.masks import enough_cells, fire_or_prev_year
from firegrid.operators.windows import mean_fold, moving_mean, separable, sum_fold

FLOOR = 1e-6


def _intervals(df: DataFrame, frac: Column, sf: int) -> DataFrame:
    """Floor, land mask and data-sufficiency mask, then the interval.

    ``df`` carries ``land`` and the moving count ``_n_land``. The floor applies before the
    masks, so unmasked gaps give the largest interval.
    """
    floored = F.when(frac > 0, frac).otherwise(F.lit(FLOOR))
    ok = F.col("land") & enough_cells(F.col("_n_land"), sf)
    return df.select(*CELL, F.when(ok, floored).alias("AnBF")).withColumn("FRI", F.lit(1.0) / F.col("AnBF"))


def _with_land(df: DataFrame, land: DataFrame) -> DataFrame:
    joined = df.join(land.select(*CELL, "land"), list(CELL))
    return joined.withColumn("_one", F.when(F.col("land"), F.lit(1.0)).otherwise(F.lit(0.0)))


def fri(anbf: DataFrame, land: DataFrame, g: GridSpec, mwb: float) -> DataFrame:
    """Fire return interval (D1): smoothed burned fraction, floored, masked, inverted.

    ``anbf``: one row per cell of the grid; ``land``: cells with boolean ``land``. Fraction
    and land count are smoothed together: one exchange per axis.
    """
    sf = g.cells_per_degree(mwb)
    rows = _with_land(anbf.select(*CELL, "AnBF"), land)
    smooth = separable(rows, {"_f": ("AnBF", mean_fold()), "_n_land": ("_one", sum_fold())}, sf)
    return _intervals(smooth, F.col("_f"), sf)


def fri_forest_weighted(
    loss: DataFrame, cover: DataFrame, land: DataFrame, g: GridSpec, mwb: float, tcf: float
) -> DataFrame:
    """Forest-loss interval weighted by forest cover (D2): ``loss`` has AnBF, ``cover`` has treecover."""
    sf = g.cells_per_degree(mwb)
    weights = cover.select(*CELL, (F.col("treecover") >= tcf).cast("double").alias("_w"))
    rows = _with_land(loss.select(*CELL, "AnBF").join(weights, list(CELL)), land)
    rows = rows.withColumn("_vw", F.coalesce(F.col("AnBF"), F.lit(0.0)) * F.col("_w"))
    stats = {"_sv": ("_vw", sum_fold()), "_sw": ("_w", sum_fold()), "_n_land": ("_one", sum_fold())}
    smooth = separable(rows, stats, sf)
    return _intervals(smooth, F.col("_sv") / F.nullif(F.col("_sw"), F.lit(0.0)), sf)


def fri_loss(df: DataFrame, keep: Column, sf: int, years: int = 18, min_periods: int = 100) -> DataFrame:
    """Older forest-loss interval (D3): share lost over the whole period, times its length.

    ``df`` has boolean ``lost``; cells failing ``keep`` are outside the domain.
    """
    rows = df.withColumn("_l", F.when(keep, F.col("lost").cast("double")))
    smooth = moving_mean(rows, "_l", sf, min_periods, out="fraction")
    return smooth.select(*CELL, "fraction", (F.lit(float(years)) / F.when(F.col("fraction") > 0, F.col("fraction"))).alias("FRI"))


def stand_replacing_fraction(fire_loss: DataFrame, fire: DataFrame) -> DataFrame:
    """Share of burning that replaces the stand, at most 1 (D4); NULL where nothing burns."""
    a = fire_loss.select(*CELL, F.col("AnBF").alias("_l"))
    b = fire.select(*CELL, F.col("AnBF").alias("_f"))
    return a.join(b, list(CELL)).select(*CELL, clip(F.col("_l") / F.nullif(F.col("_f"), F.lit(0.0)), hi=1.0).alias("sr_frac"))


# fixed values: interval limits in years for fire and for stand replacement
FIRE_LIMITS = (15, 30)
STAND_LIMITS = (60, 120)


def _below(c: str, limit: float) -> Column:
    return F.coalesce(F.col(c) <= limit, F.lit(False))


def _trio(fire: str, stand: str, high_also: Column | None = None, medium_also: Column | None = None) -> list[Column]:
    """Medium, high and critical flags; a missing interval counts as above the limit."""
    f15, f30 = (_below(fire, x) for x in FIRE_LIMITS)
    s60, s120 = (_below(stand, x) for x in STAND_LIMITS)
    high = f30 & s120
    if high_also is not None:
        high = high | high_also
    medium = f30 | s120
    if medium_also is not None:
        medium = medium | medium_also
    return [medium, high, high & (f15 | s60)]


def risk_class(df: DataFrame, fire: str = "FRI", stand: str = "SR_FRI", dist: str = "DIST_FRI") -> DataFrame:
    """Risk 0..6 (D5): medium, high and critical by fire, and again by any disturbance.

    Input: the three intervals side by side, one row per cell.
    """
    by_fire = _trio(fire, stand)
    by_all = _trio(fire, dist, high_also=by_fire[1], medium_also=by_fire[0])
    total = sum((f.cast("int") for f in by_fire[1:] + by_all), by_fire[0].cast("int"))
    return df.withColumn("risk", total)


def future_risk(df: DataFrame, pred: str = "AnBF", sr: str = "sr_frac") -> DataFrame:
    """Risk 0..3 from a predicted burned fraction."""
    frac = F.when(F.col(sr) > 1, F.lit(1.0)).otherwise(F.col(sr))
    out = df.withColumns(
        {
            "FRI": F.lit(1.0) / F.nullif(F.col(pred), F.lit(0.0)),
            "SR_FRI": F.lit(1.0) / F.nullif(F.col(pred) * frac, F.lit(0.0)),
        }
    )
    trio = _trio("FRI", "SR_FRI")
    return out.withColumn("risk", sum((f.cast("int") for f in trio[1:]), trio[0].cast("int")))


def fire_attributed_loss(loss: DataFrame, detections: DataFrame, g: GridSpec, km: float = 4.0) -> DataFrame:
    """Forest loss near a detection of the same or the previous year."""
    return fire_or_prev_year(loss, cells_near_points(detections, g, km, by=["year"]))


def forest_mask(
    cover: DataFrame, g_in: GridSpec, g_out: GridSpec, k: int, sf: int, min_fraction: float = 0.30
) -> DataFrame:
    """Forest mask on a product's grid (D8): block mean, moving mean, nearest cell, threshold."""
    blocks = coarsen(cover.select(*CELL, "treecover"), "treecover", k, k, "mean", boundary="pad", g=g_in)
    g_mid = g_in.coarser(k, k)
    smooth = moving_mean(blocks, "treecover", sf, out="fraction").select(*CELL, "fraction")
    return reindex_nearest(smooth, g_mid, g_out).withColumn("forest", F.col("fraction") / 100.0 >= min_fraction)


def zone_stack(layers: Mapping[str, DataFrame], g_in: GridSpec, g_out: GridSpec, k: int) -> DataFrame:
    """Zone layers on one grid (D9): rounded block median, read at the nearest cell.

    ``layers``: cells with ``value``. All layers are stacked first, so the work
    is one aggregate and one lookup whatever their number.
    """
    stacked = None
    for name, df in layers.items():
        part = df.select(*CELL, F.lit(name).alias("layer"), F.col("value").cast("double").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    blocks = coarsen(stacked, "value", k, k, "median", part=["layer"])
    wide = blocks.groupBy(*CELL).agg(
        *[F.max(F.when(F.col("layer") == n, F.floor(F.col("value") + 0.5))).cast("int").alias(n) for n in layers]
    )
    return reindex_nearest(wide, g_in.coarser(k, k), g_out)


def species_histogram(sr: DataFrame, species: DataFrame, mask: DataFrame, group: str = "species", bins: int = 50) -> DataFrame:
    """Distribution of the stand-replacing fraction per species inside a mask."""
    rows = sr.join(species, list(CELL)).join(mask.where("mask").select(*CELL), list(CELL), "left_semi")
    return histogram(rows.where(F.col(group).isNotNull()), "sr_frac", bins, 0.0, 1.0, by=[group])


def burnt_of_original(
    loss: DataFrame,
    nonforest: DataFrame,
    g_loss: GridSpec,
    g_mask: GridSpec,
    sf: int,
    years: float = 18.0,
    min_periods: int | None = None,
) -> DataFrame:
    """Yearly share of the original forest that was lost.

    ``loss``: cells with ``lossyear``; ``nonforest``: target cells with ``nonforest`` share.
    """
    need = max(1, int(sf / 4 - 0.5)) if min_periods is None else min_periods
    lost = loss.withColumn("_l", (F.col("lossyear") > 0).cast("double"))
    smooth = moving_mean(lost, "_l", sf, need, out="fl").select(*CELL, "fl")
    at = reindex_nearest(smooth, g_loss, g_mask).withColumn("fl", clip("fl", lo=0.0, hi=1.0))
    original = F.when(F.col("nonforest") < 1, F.lit(1.0) - F.col("nonforest"))
    joined = at.join(nonforest, list(CELL)).withColumn("_bf", F.col("fl") / original)
    # cells without original forest have no fraction and count as burnt
    joined = joined.withColumn("burnt_fraction", F.when(F.col("_bf") <= 1, F.col("_bf")).otherwise(F.lit(1.0)))
    return joined.select(*CELL, "burnt_fraction", (F.col("burnt_fraction") / F.lit(years)).alias("annual_fraction"))


def forest_weights(cover: DataFrame, k: int, tcf: float, g: GridSpec) -> DataFrame:
    """Share of forested fine cells per block, empty when any is missing."""
    return coarsen_fraction(cover, F.col("treecover") >= tcf, k, k, out="w", boundary="trim", skipna=False, g=g)


__all__: Sequence[str] = [
    "burnt_of_original",
    "fire_attributed_loss",
    "forest_mask",
    "forest_weights",
    "fri",
    "fri_forest_weighted",
    "fri_loss",
    "future_risk",
    "reciprocal_floor",
    "risk_class",
    "species_histogram",
    "stand_replacing_fraction",
    "zone_stack",
]
