"""Regridding by exploding a bounded number of weighted neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec, as_col
from firegrid.operators.aggregate import coarsen
from firegrid.operators.joins import reindex_nearest

nearest = reindex_nearest


def block_regrid(df: DataFrame, col: str, k: int, how: str = "mean", boundary: str = "pad", g: GridSpec | None = None):
    """Integer-factor aggregation (G2), ``how`` including ``mode``."""
    return coarsen(df, col, k, k, how, boundary=boundary, g=g)


def bilinear(df: DataFrame, col: str, g_in: GridSpec, g_out: GridSpec) -> DataFrame:
    """Bilinear remap (G3). Each target reads four cells; a missing one makes it NULL,
    unless its weight is zero. Targets outside the source centres are dropped.

    Longitudes are taken round the globe, so on a grid that goes all the way round the last column neighbours the first.
    On such a grid targets between the last row and a pole lie between that row and the pole's value, the mean of
    the row, which is missing if one of its cells is.
    """
    poles = _pole_rows(g_in) if g_in.all_round else {}
    rows, turn = g_in.nlat, 360.0 / abs(g_in.dlon)
    fy = F.round((F.col("lat") - F.lit(g_in.lat0)) / F.lit(g_in.dlat), 9)
    fx = F.pmod(F.round((F.col("lon") - F.lit(g_in.lon0)) / F.lit(g_in.dlon), 9), F.lit(turn))
    # beyond the first or last row the next step is the way to the pole
    for row, gap in poles.items():
        edge = F.lit(0.0) if row < 0 else F.lit(rows - 1.0)
        beyond = fy < edge if row < 0 else fy > edge
        fy = F.when(beyond, edge + (fy - edge) / F.lit(gap)).otherwise(fy)
    low, high = (-1 if -1 in poles else 0), (rows if rows in poles else rows - 1)
    target = (
        g_out.axes(df.sparkSession)
        .select(*CELL, fy.alias("_fy"), fx.alias("_fx"))
        .where(F.col("_fy").between(low, high))
        .withColumns({"_y0": F.floor("_fy").cast("int"), "_x0": F.floor("_fx").cast("int")})
    )
    if not g_in.all_round:
        target = target.where(F.col("_fx") <= g_in.nlon - 1)
    wy, wx = F.col("_fy") - F.col("_y0"), F.col("_fx") - F.col("_x0")
    column = lambda dx: F.pmod(F.col("_x0") + dx, F.lit(g_in.nlon)) if g_in.all_round else F.col("_x0") + dx
    corners = F.array(
        *[
            F.struct((F.col("_y0") + dy).alias("_y"), column(dx).alias("_x"), ((wy if dy else 1 - wy) * (wx if dx else 1 - wx)).alias("_w"))
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )
    parts = target.select(*CELL, F.inline(corners)).where(F.col("_w") > 0)
    source = df.select(F.col("lat_idx").alias("_y"), F.col("lon_idx").alias("_x"), F.col(col).cast("double").alias("_v"))
    for row in poles:
        edge = source.where(F.col("_y") == (0 if row < 0 else rows - 1))
        mean = edge.agg(F.when(F.count("_v") == g_in.nlon, F.avg("_v")).alias("_v"))
        source = source.unionByName(mean.select(F.lit(row).alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(g_in.nlon - 1))).alias("_x"), "_v"))
    return (
        parts.join(source, ["_y", "_x"], "left")
        .groupBy(*CELL)
        .agg(F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("_w") * F.col("_v"))).alias(col))
    )


def _pole_rows(g: GridSpec) -> dict[int, float]:
    """The row numbers -1 and ``nlat`` where they are a pole, with its distance from the outermost centres in rows."""
    out = {}
    for row, edge, sign in ((-1, g.lat0, -1), (g.nlat, g.lat0 + (g.nlat - 1) * g.dlat, 1)):
        gap = (90.0 - edge if sign * g.dlat > 0 else 90.0 + edge) / abs(g.dlat)
        if 1e-9 < gap <= 1 + 1e-9:
            out[row] = gap
    return out


def _centroid(south: Column, north: Column) -> Column:
    """Latitude of the centre of gravity of the area between two parallels, in degrees; free of cancellation."""
    middle, half = F.radians((south + north) / 2), F.radians((north - south) / 2)
    return F.degrees(middle - F.tan(middle) * (1 - half / F.tan(half)))


def gradients(df: DataFrame, col: str, g: GridSpec) -> DataFrame:
    """``*CELL, col, gy, gx``: change per degree of latitude and of longitude, between the centres of gravity of the two
    neighbours of a cell, or of it and the only one known; zero where none is.

    Every cell tells its value to its four neighbours, in one exchange. On a grid that goes all the way round, the
    last column neighbours the first.
    """
    half = abs(g.dlat) / 2.0
    own = df.where(F.col(col).isNotNull()).select(F.col("lat_idx").cast("long"), F.col("lon_idx").cast("long"), F.col(col).cast("double").alias("_v"))
    own = own.withColumn("_c", _centroid(g.lat() - half, g.lat() + half))
    x = F.col("lon_idx")
    places = [(F.col("lat_idx"), x, "own"), *[(F.col("lat_idx") + i, x, k) for i, k in ((1, "below"), (-1, "above"))]]
    places += [(F.col("lat_idx"), F.pmod(x + i, F.lit(g.nlon)) if g.all_round else x + i, k) for i, k in ((1, "left"), (-1, "right"))]
    told = own.select("_v", "_c", F.inline(F.array(*[F.struct(r.alias("lat_idx"), c.alias("lon_idx"), F.lit(k).alias("_k")) for r, c, k in places])))
    took = {k: F.max(F.when(F.col("_k") == k, F.struct("_v", "_c"))).alias(k) for k in ("own", "below", "above", "left", "right")}
    near = told.groupBy(*CELL).agg(*took.values()).where(F.col("own").isNotNull())
    v = lambda k: F.coalesce(F.col(f"{k}._v"), F.col("own._v"))
    c = lambda k: F.coalesce(F.col(f"{k}._c"), F.col("own._c"))
    steps = F.col("left").isNotNull().cast("int") + F.col("right").isNotNull().cast("int")
    gy = F.coalesce((v("above") - v("below")) / F.nullif(c("above") - c("below"), F.lit(0.0)), F.lit(0.0))
    gx = F.coalesce((v("right") - v("left")) / F.nullif(steps * F.lit(g.dlon), F.lit(0.0)), F.lit(0.0))
    return near.select(*CELL, F.col("own._v").alias(col), gy.alias("gy"), gx.alias("gx"))


def conservative(df: DataFrame, col: str, g_in: GridSpec, g_out: GridSpec, order: int = 1) -> DataFrame:
    """Conservative remap of area means (G4): mean of the covering cells by overlap area.

    Each source cell is split over the target cells it touches, also across the date line; missing sources are
    left out of both sums. Partial sums combine before the exchange.

    With ``order=2`` a source cell is not flat but a plane through its centre of gravity with the :func:`gradients` of
    its neighbourhood, and each overlap takes the plane's mean over it (first moments of area). A field that is
    linear in latitude and longitude is reproduced exactly; the integral over the area is kept by either order.
    """
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")

    def spans(lo, step, obase, ostep, on):
        a, b = (lo - F.lit(obase)) / F.lit(ostep), (lo + F.lit(abs(step)) - F.lit(obase)) / F.lit(ostep)
        first = F.floor(F.round(F.least(a, b), 9) + 0.5).cast("int")
        last = (F.ceil(F.round(F.greatest(a, b), 9) + 0.5) - 1).cast("int")
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(on - 1))
        return F.when(last >= first, F.sequence(first, last))

    planes = gradients(df, col, g_in) if order == 2 else df.where(F.col(col).isNotNull()).select(*CELL, col)
    south, west = g_in.lat() - abs(g_in.dlat) / 2.0, g_in.lon() - abs(g_in.dlon) / 2.0
    parts = (
        planes.select(
            F.col(col).alias("_v"),
            *(("gy", "gx") if order == 2 else ()),
            south.alias("_a0"),
            # the same cell one turn further west and east
            F.explode(F.array(west, west - 360.0, west + 360.0)).alias("_o0"),
        )
        .withColumns({"_a1": F.col("_a0") + abs(g_in.dlat), "_o1": F.col("_o0") + abs(g_in.dlon)})
        .withColumn("lat_idx", F.explode(spans(F.col("_a0"), g_in.dlat, g_out.lat0, g_out.dlat, g_out.nlat)))
        .withColumn("lon_idx", F.explode(spans(F.col("_o0"), g_in.dlon, g_out.lon0, g_out.dlon, g_out.nlon)))
    )
    half_y, half_x = abs(g_out.dlat) / 2.0, abs(g_out.dlon) / 2.0
    bounds = {
        "_s": F.greatest("_a0", g_out.lat() - half_y),
        "_n": F.least("_a1", g_out.lat() + half_y),
        "_w": F.greatest("_o0", g_out.lon() - half_x),
        "_e": F.least("_o1", g_out.lon() + half_x),
    }
    over = parts.withColumns(bounds).where("_n - _s > 1e-9 AND _e - _w > 1e-9")
    area = (F.sin(F.radians("_n")) - F.sin(F.radians("_s"))) * F.radians(F.col("_e") - F.col("_w"))
    value = F.col("_v")
    if order == 2:
        up = _centroid(F.col("_s"), F.col("_n")) - _centroid(F.col("_a0"), F.col("_a1"))
        right = (F.col("_e") + F.col("_w") - F.col("_o0") - F.col("_o1")) / 2
        value = value + F.col("gy") * up + F.col("gx") * right
    weighted = over.select(*CELL, value.alias("_v"), area.alias("_area"))
    return weighted.groupBy(*CELL).agg((F.sum(F.col("_v") * F.col("_area")) / F.sum("_area")).alias(col))


def enlarge(df: DataFrame, g: GridSpec) -> DataFrame:
    """Tile on the full grid, NULL where it has no cells."""
    return g.lattice(df.sparkSession).join(df, list(CELL), "left")


def binarize(col: Column | str, strict: bool = False) -> Column:
    """Remapped mask back to true/NULL (G6). ``strict`` keeps only cells that are exactly 1."""
    c = as_col(col)
    return F.when(c == 1 if strict else c > 0.5, F.lit(True))
