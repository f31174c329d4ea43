"""Alignment of rasters, nearest-cell lookups and tolerance joins.

No join here compares coordinates row against row: nearest cells and boxes are index
arithmetic, tolerances are exploded into a few equal keys. What remains are
equi-joins, for which Spark chooses broadcast or sort-merge by size and AQE
splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.grid import CELL, EARTH_RADIUS_KM, GridSpec


def align(a: DataFrame, b: DataFrame, how: str = "inner", keys: Sequence[str] = CELL) -> DataFrame:
    """Two rasters on one grid, side by side."""
    return a.join(b, list(keys), how)


def _nearest(at: DataFrame, g: GridSpec, lat: str, lon: str, tolerance: float | None) -> dict[str, Column]:
    """Indices of the nearest cell: beyond the edge the edge cell, or NULL if it is farther than ``tolerance`` cells."""
    out = {}
    for name, place, index, base, step, n in (("y", lat, g.lat_index(lat), g.lat0, g.dlat, g.nlat), ("x", lon, g.lon_index(lon), g.lon0, g.dlon, g.nlon)):
        inside = F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))
        off = F.abs((F.col(place) - F.lit(float(base))) / F.lit(float(step)) - inside)
        near = inside if tolerance is None else F.when(off <= tolerance, inside)
        out[name] = F.when(F.col(place).isNotNull(), near)  # least and greatest skip NULL
    return out


def reindex_nearest(df: DataFrame, g_in: GridSpec, g_out: GridSpec, tolerance: float | None = None) -> DataFrame:
    """Raster read at the centres of another grid.

    The target lattice carries the source index of each of its cells, so the lookup is
    an equi-join. A centre half-way between two cells takes the larger index, one beyond the edge the edge cell;
    ``tolerance`` leaves out centres that are more cells away than that.
    """
    axes = g_out.axes(df.sparkSession)
    at = _nearest(axes, g_in, "lat", "lon", tolerance)
    target = axes.select(*CELL, at["y"].alias("_y"), at["x"].alias("_x"))
    source = df.withColumnsRenamed({"lat_idx": "_y", "lon_idx": "_x"})
    return target.join(source, ["_y", "_x"]).drop("_y", "_x")


def lookup_points(df: DataFrame, points: DataFrame, g: GridSpec, how: str = "inner", tolerance: float | None = None) -> DataFrame:
    """Cell values at points (J3), the edge cell's beyond the edge unless that is more than ``tolerance`` cells away."""
    at = _nearest(points, g, "lat", "lon", tolerance)
    return points.withColumns({"lat_idx": at["y"], "lon_idx": at["x"]}).join(df, list(CELL), how)


def box_cells(boxes: DataFrame, g: GridSpec) -> DataFrame:
    """The cells whose centre lies inside each box, ends included."""

    def ids(lo, hi, base, step, n):
        a, b = (F.col(lo) - F.lit(base)) / F.lit(step), (F.col(hi) - F.lit(base)) / F.lit(step)
        first = F.greatest(F.ceil(F.round(F.least(a, b), 9)).cast("int"), F.lit(0))
        last = F.least(F.floor(F.round(F.greatest(a, b), 9)).cast("int"), F.lit(n - 1))
        return F.when(last >= first, F.sequence(first, last))

    return boxes.withColumn("lat_idx", F.explode(ids("lat_min", "lat_max", g.lat0, g.dlat, g.nlat))).withColumn(
        "lon_idx", F.explode(ids("lon_min", "lon_max", g.lon0, g.dlon, g.nlon))
    )


def cells_in_boxes(df: DataFrame, boxes: DataFrame, g: GridSpec) -> DataFrame:
    """Raster rows inside each box (J4): boxes become their cells, then an equi-join."""
    return box_cells(boxes, g).join(df, list(CELL))


def cells_near_points(points: DataFrame, g: GridSpec, km: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """Cells whose centre is within ``km`` of any point (J5), once per group.

    A point covers one span of columns per grid row, computed in closed form from
    the haversine formula. Spans are merged per row before any cell is emitted, so
    work follows the number of rows a point reaches and the cells
    reported: a pile of points in one place costs no pairs. On a grid that closes around the globe
    spans go on beyond the date line.
    """
    reach = int(km / (EARTH_RADIUS_KM * 3.141592653589793 / 180.0 * abs(g.dlat))) + 1
    row0 = g.lat_index("lat")
    rows = F.sequence(F.greatest(row0 - reach, F.lit(0)), F.least(row0 + reach, F.lit(g.nlat - 1)))
    unique = points.groupBy(*by, "lat", "lon").agg(F.lit(1).alias("_one"))
    lat = F.radians(g.lat("lat_idx"))
    p = F.radians(F.col("lat"))
    left = F.pow(F.sin(F.lit(km / (2 * EARTH_RADIUS_KM))), 2) - F.pow(F.sin((lat - p) / 2), 2)
    ratio = left / (F.cos(lat) * F.cos(p))
    half = F.degrees(F.lit(2.0) * F.asin(F.sqrt(F.least(ratio, F.lit(1.0)))))
    spans = (
        unique.where((row0 >= -reach) & (row0 <= g.nlat - 1 + reach))
        .withColumn("lat_idx", F.explode(rows))
        .where(left >= 0)
        .select(
            *by,
            "lat_idx",
            F.explode(_turns(F.ceil((F.col("lon") - half - F.lit(g.lon0)) / F.lit(g.dlon)), F.floor((F.col("lon") + half - F.lit(g.lon0)) / F.lit(g.dlon)), g)).alias("span"),
        )
        .select(*by, "lat_idx", "span.lo", "span.hi")
        .where(F.col("hi") >= F.col("lo"))
        .groupBy(*by, "lat_idx", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    # spans of a row, at most one per column: report only what no earlier span reached
    w = Window.partitionBy(*by, "lat_idx").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("lo", F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(w) + 1, F.col("lo"))))
        .where(F.col("hi") >= F.col("lo"))
        .select(*by, F.col("lat_idx").cast("int"), F.explode(F.sequence("lo", "hi")).alias("lon_idx"))
    )


def _turns(lo: Column, hi: Column, g: GridSpec) -> Column:
    """A span of columns cut to the grid; where the grid closes on itself, also its parts one turn east and west."""
    turns = (0, -g.nlon, g.nlon) if abs(g.nlon * abs(g.dlon) - 360.0) < abs(g.dlon) / 2 else (0,)
    return F.array(
        *[F.struct(F.greatest(lo + t, F.lit(0)).cast("int").alias("lo"), F.least(hi + t, F.lit(g.nlon - 1)).cast("int").alias("hi")) for t in turns]
    )


def recode(df: DataFrame, col: str, lookup: DataFrame, code: str, out: Sequence[str], null_groups=(0,)) -> DataFrame:
    """Class codes to groups and names (J8); groups in ``null_groups`` become NULL."""
    table = lookup.select(F.col(code).alias("_code"), *out).dropDuplicates(["_code"])
    joined = df.join(table, F.col(col) == F.col("_code"), "left").drop("_code")
    if null_groups:
        joined = joined.withColumn(out[0], F.when(~F.col(out[0]).isin(*null_groups), F.col(out[0])))
    return joined


def resolve_dates(events: DataFrame, catalogue: DataFrame, tol_days: int = 90, keys=("site", "frame")) -> DataFrame:
    """Event dates replaced by the catalogue's when they are near enough.

    ``date_ok`` is false where both dates exist but differ by more.
    """
    cat = catalogue.groupBy(*keys).agg(F.min("date").alias("_cat"))
    gap = F.abs(F.datediff("date", "_cat"))
    near = F.coalesce(gap < tol_days, F.lit(False))
    return (
        events.join(cat, list(keys), "left")
        .withColumn("date_ok", F.col("_cat").isNull() | F.col("date").isNull() | near)
        .withColumn("date", F.when(near, F.col("_cat")).otherwise(F.col("date")))
        .drop("_cat")
    )


def merge_cells(*dfs: DataFrame) -> DataFrame:
    """Inner join of several rasters on the cell (J10); all share one partitioning, so one exchange each."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, list(CELL))
    return out


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Number of keys on one side only."""
    both = (
        a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(*keys)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    return both.agg(
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_a"),
        F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("only_b"),
    )


def assert_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = CELL) -> None:
    row = key_differences(a, b, keys).first()
    if row["only_a"] or row["only_b"]:
        raise ValueError(f"tables differ in keys: {row['only_a']} only left, {row['only_b']} only right")


def missing_from(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` without a partner in ``b``."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def site_box_evidence(site_hist: DataFrame, box_hist: DataFrame, keys=("site", "year")) -> DataFrame:
    """Per site-year: burned at the site itself, and anywhere in its box."""
    stacked = site_hist.select(*keys, F.lit(1).alias("at_site"), F.lit(0).alias("in_box")).unionByName(
        box_hist.select(*keys, F.lit(0).alias("at_site"), F.lit(1).alias("in_box"))
    )
    return stacked.groupBy(*keys).agg(F.max("at_site").alias("at_site"), F.max("in_box").alias("in_box"))


def match_years(a: DataFrame, b: DataFrame, tol: int = 1, keys=("site",)) -> DataFrame:
    """Distinct year pairs of two event lists at most ``tol`` apart.

    Both lists are first reduced to distinct years, then one side is spread over the
    offsets: an equi-join with at most 2*tol+1 partners per row.
    """
    left = a.select(*keys, "year").distinct()
    offsets = F.array(*[F.lit(i) for i in range(-tol, tol + 1)])
    right = (
        b.select(*keys, F.col("year").alias("year_b"))
        .distinct()
        .withColumn("year", F.explode(F.transform(offsets, lambda o: F.col("year_b") + o)))
    )
    return left.join(right, [*keys, "year"])


def attach_attributes(df: DataFrame, attrs: DataFrame, key: str) -> DataFrame:
    """Attributes of a site joined by its number or name."""
    return df.join(attrs, key, "left")


def mid_temperature(tmax: DataFrame, tmin: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the daily extremes."""
    return tmax.join(tmin, list(keys)).withColumn("tmean", (F.col("tmax") + F.col("tmin")) / 2)
