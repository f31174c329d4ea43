"""Scene catalogues and scene pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.operators.ordered import exact_percentiles

# fixed values: months and sensors with the dark-pixel problem
WINTER_MONTHS = (11, 12, 1, 2, 3)
WINTER_SENSORS = ("LANDSAT_7", "LANDSAT_8")
# fixed values: luminance weights of red, green and blue
LUMA = (0.2125, 0.7154, 0.0721)


def scene_null_share(pixels: DataFrame, scene: str = "scene", value: str = "value") -> DataFrame:
    return pixels.groupBy(scene).agg(F.avg(F.col(value).isNull().cast("double")).alias("null_share"))


def scene_qc(pixels: DataFrame, max_null: float = 0.5, scene: str = "scene", value: str = "value") -> DataFrame:
    """Pixels of scenes that are complete enough (F16)."""
    good = scene_null_share(pixels, scene, value).where(F.col("null_share") <= max_null)
    return pixels.join(good.select(scene), scene, "left_semi")


def scene_dedup(
    scenes: DataFrame,
    max_gap_seconds: int = 86_400,
    keys: Sequence[str] = ("site",),
    qc: Column | str = "qc",
    chunk: str = "month",
) -> DataFrame:
    """Repeats of a scene dropped (F17): adds ``keep``.

    A scene is linked to the catalogue row before it when that is less than ``max_gap``
    older and of the same satellite; the first two rows of a site never are. A linked
    scene is kept only when the row before it was not, so along a chain of linked good
    scenes every second one is kept: position in the chain decides.

    A site's catalogue is never sorted in one task. Rows are ordered inside (site,
    ``chunk``); a small table of chunks hands over what lies before each: the last row, the number of
    rows, the start of the open chain.
    """
    ok = F.col(qc) if isinstance(qc, str) else qc
    part = [*keys, "_chunk"]
    local = Window.partitionBy(*part).orderBy("ts", "seq")
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct(F.col("ts"), F.col("satellite"), F.col("_ok"))
    rows = scenes.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_chunk": F.date_trunc(chunk, "ts")})
    level = (
        rows.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"), F.max_by(row, F.struct("ts", "seq")).alias("_last"))
        .select(
            *part,
            F.lag("_last").over(over_chunks).alias("_prev_last"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    rows = rows.join(level, part).withColumns(
        {
            "_idx": F.col("_offset") + F.row_number().over(local),
            "_prev": F.coalesce(F.lag(row).over(local), F.col("_prev_last")),
        }
    )
    gap = F.col("ts").cast("double") - F.col("_prev.ts").cast("double")
    linked = (F.col("_idx") > 2) & (gap < max_gap_seconds) & F.col("satellite").eqNullSafe(F.col("_prev.satellite"))
    goes_on = F.coalesce(linked & F.col("_ok") & F.col("_prev._ok"), F.lit(False))
    rows = rows.withColumn("_start", F.when(~goes_on, F.col("_idx")))
    carry = rows.groupBy(*part).agg(F.max("_start").alias("_m")).select(
        *part, F.max("_m").over(earlier).alias("_carry")
    )
    running = F.max("_start").over(local.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.join(carry, part)
        .withColumn("keep", F.col("_ok") & ((F.col("_idx") - F.coalesce(running, F.col("_carry"))) % 2 == 0))
        .select(*scenes.columns, "keep")
    )


def winter_floor(
    pixels: DataFrame,
    value: str = "value",
    months: Sequence[int] = WINTER_MONTHS,
    satellites: Sequence[str] = WINTER_SENSORS,
    t: str = "ts",
) -> DataFrame:
    """Missing and slightly negative winter values of some sensors to zero, then range check."""
    v = F.col(value)
    winter = F.month(t).isin(*months) & F.col("satellite").isin(*satellites)
    fixed = F.when(winter & (v.isNull() | ((v >= -0.2) & (v < 0))), F.lit(0.0)).otherwise(v)
    return pixels.withColumn(value, F.when((fixed >= 0) & (fixed <= 1), fixed))


def scene_brightness(pixels: DataFrame, bands: Sequence = ("R", "G", "B"), scene: str = "scene") -> DataFrame:
    """Band means, brightness and share of usable pixels (A32); one aggregate, no pivot shuffle."""
    means = [F.avg(F.when(F.col("band") == b, F.col("value"))) for b in bands]
    luma = sum((m * w for m, w in zip(means[1:], LUMA[1:], strict=True)), means[0] * LUMA[0])
    return pixels.groupBy(scene).agg(
        *[m.alias(f"mean_{b}") for m, b in zip(means, bands, strict=True)],
        luma.alias("brightness"),
        F.avg(F.col("value").isNotNull().cast("double")).alias("good_share"),
    )


def contrast_stretch(
    pixels: DataFrame, by: Sequence[str] = ("scene", "combo"), value: str = "value", lo: float = 1, hi: float = 99
) -> DataFrame:
    """Values between two percentiles stretched to [0, 1], the rest clipped.

    Percentiles are exact for scenes of any size; a flat scene keeps its values clipped.
    """
    ends = exact_percentiles(pixels, value, (lo / 100.0, hi / 100.0), by).select(
        *by, F.col("q0").alias("_lo"), F.col("q1").alias("_hi")
    )
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    scaled = (F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo")) - F.col("_lo")) / span
    out = pixels.join(ends, list(by), "left").withColumn("stretched", F.when(F.col(value).isNotNull(), scaled))
    return out.drop("_lo", "_hi")
