"""Row filters, raster masks and polygon masks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec, as_col
from firegrid.operators.windows import moving_sum


def bbox(df: DataFrame, lon0: float, lon1: float, lat0: float, lat1: float, g: GridSpec | None = None) -> DataFrame:
    """Bounding box, ends included (F1).

    With a grid the box is turned into index bounds on the driver, so the filter
    reaches the parquet scan as plain integer comparisons.
    """
    if g is None:
        return df.where(F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1))
    bounds = []
    for base, step, n, lo, hi in ((g.lat0, g.dlat, g.nlat, lat0, lat1), (g.lon0, g.dlon, g.nlon, lon0, lon1)):
        # places of the ends on the axis; rounding keeps centres that lie on an end
        a, b = sorted((round((lo - base) / step, 9), round((hi - base) / step, 9)))
        bounds.append((max(math.ceil(a), 0), min(math.floor(b), n - 1)) if lo <= hi else (0, -1))
    (south, north), (west, east) = bounds
    return df.where(F.col("lat_idx").between(south, north) & F.col("lon_idx").between(west, east))


def between_dates(df: DataFrame, start: str, end: str, col: str = "t") -> DataFrame:
    """Inclusive time slice (F2)."""
    return df.where(F.col(col).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def apply_mask(df: DataFrame, mask: DataFrame, value_cols: Sequence[str], flag: str = "mask") -> DataFrame:
    """Keep values where the mask is true, NULL elsewhere."""
    joined = df.join(mask.select(*CELL, F.col(flag).alias("_m")), list(CELL), "left")
    return joined.withColumns({c: F.when(F.col("_m"), F.col(c)) for c in value_cols}).drop("_m")


def combine_masks(masks: Sequence[DataFrame], flag: str = "mask") -> DataFrame:
    """Cells on which every mask is true (F4): one aggregate, no chain of joins."""
    stacked = None
    for m in masks:
        part = m.select(*CELL, F.col(flag).alias("_m"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*CELL).agg((F.count_if(F.col("_m")) == len(masks)).alias(flag))


def enough_cells(n_valid: Column, sf: int) -> Column:
    """More than a quarter of the window's cells."""
    return n_valid > (sf / 2.0) ** 2


def sufficiency_mask(mask: DataFrame, sf: int, flag: str = "mask") -> DataFrame:
    """Cells whose window holds more than (sf/2)^2 valid cells (F5); outside the domain counts as not valid."""
    ones = mask.withColumn("_one", F.when(F.col(flag), F.lit(1.0)).otherwise(F.lit(0.0)))
    summed = moving_sum(ones, "_one", sf, out="n_valid", skipna=False)
    return summed.select(*CELL, "n_valid", enough_cells(F.col("n_valid"), sf).alias("enough"))


def land_mask(raw: DataFrame, rule: str, code: str = "code", min_months: int = 5, water: int = 254) -> DataFrame:
    """Land mask from product codes.

    ``code``: a cell is land when its code is 2. ``coverage``: land when at least
    ``min_months`` observations exist. ``water``: land unless the water code
    appears.
    """
    c = F.col(code)
    test = {
        "code": F.max((c == 2).cast("int")) == 1,
        "coverage": F.count(c) >= min_months,
        "water": F.coalesce(F.max((c == water).cast("int")), F.lit(0)) == 0,
    }[rule]
    return raw.groupBy(*CELL).agg(test.alias("land"))


def filter_fires(df: DataFrame, min_conf: float = 30, conf: str = "confidence", when: str = "acq_date") -> DataFrame:
    """Trusted detections with their year."""
    return df.where(F.col(conf) >= min_conf).withColumn("year", F.year(when))


def filter_months(df: DataFrame, first: int = 6, last: int = 8, col: str = "t") -> DataFrame:
    """Months in which the sensor is valid."""
    return df.where(F.month(col).between(first, last))


def model_domain(df: DataFrame, var: str, bf_min: float) -> DataFrame:
    """Rows usable for modelling (F11): burned fraction above its floor, or intervals below its reciprocal."""
    if var == "AnBF":
        return df.where(F.col(var) >= bf_min)
    if var == "FRI":
        return df.where(F.col(var) <= 1.0 / bf_min)
    raise ValueError(f"no model domain for {var!r}")


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Complete rows only."""
    return df.dropna("any", subset=list(subset) if subset else None)


def _edges(vertices: DataFrame, poly: str, shorter: bool) -> DataFrame:
    """``poly, lon, lat, lon2, lat2`` of every edge, with longitudes that go on beyond 180 degrees."""
    ring = Window.partitionBy(poly, "ring").orderBy("seq")
    whole = Window.partitionBy(poly, "ring")
    closed = vertices.withColumns(
        {
            "lon2": F.coalesce(F.lead("lon").over(ring), F.min_by("lon", "seq").over(whole)),
            "lat2": F.coalesce(F.lead("lat").over(ring), F.min_by("lat", "seq").over(whole)),
        }
    )
    if not shorter:
        return closed.select(poly, "lon", "lat", "lon2", "lat2")
    step = F.col("lon2") - F.col("lon")
    turn = F.when(step > 180, F.lit(-360.0)).when(step < -180, F.lit(360.0)).otherwise(F.lit(0.0))
    before = ring.rowsBetween(Window.unboundedPreceding, -1)
    unrolled = closed.withColumn("_turn", turn).withColumns(
        {"_off": F.coalesce(F.sum("_turn").over(before), F.lit(0.0)), "_round": F.sum("_turn").over(whole), "_pole": F.signum(F.avg("lat").over(whole)) * 90, "_first": F.min("seq").over(whole)}
    )
    edge = lambda lon, lat, lon2, lat2: F.struct(lon.alias("lon"), lat.alias("lat"), lon2.alias("lon2"), lat2.alias("lat2"))
    lon, lat = F.col("lon") + F.col("_off"), F.col("lat")
    own = edge(lon, lat, F.col("lon2") + F.col("_off") + F.col("_turn"), F.col("lat2"))
    # a ring once round the globe is closed over the pole on its side
    up, down = edge(lon, lat, lon, F.col("_pole")), edge(lon + F.col("_round"), lat, lon + F.col("_round"), F.col("_pole"))
    around = (F.col("_round") != 0) & (F.col("seq") == F.col("_first"))
    return unrolled.select(poly, F.inline(F.when(around, F.array(own, up, down)).otherwise(F.array(own))))


def polygon_cells(vertices: DataFrame, g: GridSpec, poly: str = "poly_id", shorter: bool = True) -> DataFrame:
    """Cells whose centre lies inside a polygon, even-odd rule.

    ``vertices``: (poly, ring, seq, lon, lat); rings close themselves. Scanline
    form: each edge yields one crossing per grid row it spans; crossings are
    merged per (row, column), and the span between an odd crossing and the next one is
    inside. Work is edges x rows and the cells reported; cells are never paired
    with edges.

    An edge goes the shorter way round the globe, over the date line if need be, unless ``shorter`` is off: then
    longitudes are plain numbers. A ring that goes once round holds the pole on its side of the equator.
    """
    edges = _edges(vertices, poly, shorter).where(F.col("lat") != F.col("lat2"))
    south, north = F.least("lat", "lat2"), F.greatest("lat", "lat2")
    step, base = F.lit(g.dlat), F.lit(g.lat0)
    ends = [(south - base) / step, (north - base) / step]
    first = F.greatest(F.floor(F.least(*ends)).cast("int"), F.lit(0))
    last = F.least(F.ceil(F.greatest(*ends)).cast("int"), F.lit(g.nlat - 1))
    y = g.lat("lat_idx")
    crossing = F.col("lon") + (y - F.col("lat")) / (F.col("lat2") - F.col("lat")) * (F.col("lon2") - F.col("lon"))
    # column from which on the centre is no longer left of the crossing; the division may round to a neighbour
    near = F.ceil((crossing - F.lit(g.lon0)) / F.lit(g.dlon)).cast("long")
    at = near + F.when(g.lon(near) < crossing, 1).when(g.lon(near - 1) >= crossing, -1).otherwise(0)
    # the polygon as it stands, and one turn further west and east
    turns = F.explode(F.array(*[F.lit(t) for t in ((0.0, -360.0, 360.0) if shorter else (0.0,))]))
    edges = edges.withColumn("_t", turns).withColumns({"lon": F.col("lon") + F.col("_t"), "lon2": F.col("lon2") + F.col("_t")})
    toggles = (
        edges.where(last >= first)
        .withColumn("lat_idx", F.explode(F.sequence(first, last)))
        .where((y >= south) & (y < north))
        .select(poly, "_t", "lat_idx", F.greatest(F.least(at, F.lit(g.nlon)), F.lit(0)).cast("int").alias("at"))
        .groupBy(poly, "_t", "lat_idx", "at")
        .agg((F.count(F.lit(1)) % 2).alias("odd"))
        .where(F.col("odd") == 1)
    )
    row = Window.partitionBy(poly, "_t", "lat_idx").orderBy("at")
    spans = (
        toggles.withColumns({"k": F.row_number().over(row), "stop": F.lead("at").over(row)})
        .where((F.col("k") % 2 == 1) & (F.col("stop") > F.col("at")))
        .select(poly, "lat_idx", F.explode(F.sequence(F.col("at"), F.col("stop") - 1)).alias("lon_idx"))
    )
    return spans.select(poly, F.col("lat_idx").cast("int"), F.col("lon_idx").cast("int"))


def fire_or_prev_year(loss: DataFrame, fires: DataFrame) -> DataFrame:
    """Loss kept where a fire was seen in the same or the previous year.

    ``loss``: cells with ``year``; ``fires``: cells with ``year``.
    """
    seen = fires.select(*CELL, F.explode(F.array(F.col("year"), F.col("year") + 1)).alias("year")).distinct()
    return loss.join(seen, [*CELL, "year"], "left_semi")


def testable_events(events: DataFrame, start: Column | int, end: Column | int, margin: int = 3) -> DataFrame:
    """Events far enough from both ends of a series."""
    lo = as_col(start) if not isinstance(start, int) else F.lit(start)
    hi = as_col(end) if not isinstance(end, int) else F.lit(end)
    y = F.col("year")
    return events.where(y.isNotNull() & (y - lo >= margin) & (hi - y >= margin))


def nonempty_years(df: DataFrame, value: str, keys: Sequence[str] = ("site", "year")) -> DataFrame:
    """Site-years with at least one burned cell."""
    return df.groupBy(*keys).agg(F.sum(value).alias("burned")).where(F.col("burned") > 0)


def null_if_any_band(pixels: DataFrame, keys: Sequence[str] = ("scene", "y", "x"), value: str = "value") -> DataFrame:
    """All bands of a pixel become NULL when one is missing (F19). A pixel's bands are few."""
    w = Window.partitionBy(*keys)
    return pixels.withColumn(value, F.when(F.max(F.col(value).isNull().cast("int")).over(w) == 0, F.col(value)))
