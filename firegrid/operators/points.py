"""Operators on point sets: nearest neighbour, thinning, site lists."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.functions.geo import haversine_km
from firegrid.grid import EARTH_RADIUS_KM, GridSpec
from firegrid.operators.windows import site_box
from firegrid.session import cut_lineage

_LEVELS = tuple(45.0 / 8**i for i in range(10))


def _blocks(step: float, lat: str, lon: str) -> list[Column]:
    return [F.floor(F.col(lat) / F.lit(step)).cast("long"), F.floor(F.col(lon) / F.lit(step)).cast("long")]


def _box_lower_km(step: float) -> Column:
    """Distance no point of block (by, bx) can undercut."""
    la0, lo0 = F.col("by") * F.lit(step), F.col("bx") * F.lit(step)
    la1, lo1 = la0 + step, lo0 + step
    dlat = F.greatest(la0 - F.col("lat"), F.col("lat") - la1, F.lit(0.0))
    # nearest way round in longitude
    dlon = F.lit(0.0) + F.least(
        F.greatest(lo0 - F.col("lon"), F.col("lon") - lo1, F.lit(0.0)),
        F.greatest(lo0 + 360 - F.col("lon"), F.lit(0.0)),
        F.greatest(F.col("lon") - (lo1 - 360), F.lit(0.0)),
    )
    cos_box = F.greatest(F.least(F.cos(F.radians(la0)), F.cos(F.radians(la1))), F.lit(0.0))
    h = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(F.col("lat"))) * cos_box * F.pow(
        F.sin(F.radians(F.least(dlon, F.lit(180.0))) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _nearest_by_descent(todo: DataFrame, spots: DataFrame, sid: str) -> DataFrame:
    """Branch and bound down a fixed quadtree, all locations at once.

    Each level holds, per location, the blocks that may still contain its nearest
    spot: a block's real spot gives an upper bound, its edge a lower one. Only
    occupied blocks are looked up, by equi-join: at the top on every block there can be, then on the parent.
    """
    cand, prev = todo, None
    place = Window.partitionBy("lat", "lon")
    for step in _LEVELS:
        by, bx = _blocks(step, "_rlat", "_rlon")
        parent = _blocks(prev, "_rlat", "_rlon") if prev else [by, bx]
        level = (
            spots.select("_rlat", "_rlon", by.alias("by"), bx.alias("bx"), parent[0].alias("py"), parent[1].alias("px"))
            .groupBy("py", "px", "by", "bx")
            .agg(F.min(F.struct("_rlat", "_rlon")).alias("_spot"))
        )
        if prev is None:
            # latitudes -90..90 and longitudes -180..360 in blocks of this size
            rows, cols = (F.sequence(F.lit(-lo // int(step)).cast("long"), F.lit(hi // int(step)).cast("long")) for lo, hi in ((90, 90), (180, 360)))
            cand = cand.withColumn("py", F.explode(rows)).withColumn("px", F.explode(cols))
        else:
            cand = cand.withColumnsRenamed({"by": "py", "bx": "px"})
        cand = (
            cand.join(level, ["py", "px"])
            .withColumn("_up", haversine_km("lat", "lon", "_spot._rlat", "_spot._rlon"))
            .withColumn("_best", F.min("_up").over(place))
            .where(_box_lower_km(step) <= F.col("_best") + 1e-9)
            .select("lat", "lon", "by", "bx")
        )
        prev = step
    by, bx = _blocks(prev, "_rlat", "_rlon")
    last = cand.join(spots.withColumns({"by": by, "bx": bx}), ["by", "bx"])
    km = haversine_km("lat", "lon", "_rlat", "_rlon")
    return last.groupBy("lat", "lon").agg(F.min(F.struct(km.alias("km"), F.col(sid).alias("id"))).alias("_n"))


def nearest_site(left: DataFrame, right: DataFrame, right_id: str) -> DataFrame:
    """Nearest right-hand site of every left-hand one with its distance.

    Repeats of a location are searched once, by quadtree descent. Rows without coordinates (NULL or NaN) find
    nothing and are found by nothing, as all rows do if the right side is empty.
    """

    def placed(df: DataFrame) -> DataFrame:
        lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
        return df.withColumns({"lat": lat, "lon": lon}).where(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))

    spots = placed(right).groupBy(F.col("lat").alias("_rlat"), F.col("lon").alias("_rlon")).agg(F.min(right_id).alias(right_id))
    found = _nearest_by_descent(placed(left).select("lat", "lon").distinct(), spots, right_id)
    return left.join(found, ["lat", "lon"], "left").select(
        *left.columns, F.col("_n.id").alias(f"near_{right_id}"), F.col("_n.km").alias("km")
    )


def thin_points(points: DataFrame, km: float = 1.0, order: str = "seq") -> DataFrame:
    """Greedy thinning (J7): in order, a point is kept unless an earlier kept one is closer than ``km``.

    Exact and free of pair lists. Points are binned to blocks so small that two points of
    a block are always in reach of each other, so a block keeps at most one point.
    In each round a block's first open point is kept when no block around it has an
    earlier open one; then open points near a newly kept point are dropped. Only
    block minima and kept points are ever exchanged with neighbours. The number of
    rounds follows the longest chain of ever later neighbours, short unless the order
    runs along a line of points.
    """
    deg = math.degrees(km / EARTH_RADIUS_KM)
    side = 0.69 * deg  # diagonal of a block < km
    reach_rows = F.sequence(F.lit(-2), F.lit(2))

    def cos_deg(lat):
        return F.greatest(F.cos(F.radians(lat)), F.lit(1e-3))

    def edges(row):
        return F.abs(row * F.lit(side)), F.abs((row + 1) * F.lit(side))

    def width(row):
        """Width of a row's blocks in degrees of longitude, for its edge nearest the equator."""
        low = F.when(row * F.lit(side) * ((row + 1) * F.lit(side)) <= 0, F.lit(0.0)).otherwise(F.least(*edges(row)))
        return F.lit(side) / cos_deg(low)

    def around(df: DataFrame) -> DataFrame:
        """Every block that may hold a point within reach of the row's point, also across the date line."""
        near = df.withColumn("_nby", F.explode(F.transform(reach_rows, lambda i: F.col("_by") + i)))
        row = F.col("_nby")
        span = F.lit(deg * 1.02) / cos_deg(F.greatest(F.abs(F.col("lat")), *edges(row)))

        def ids(lon):
            return F.sequence(F.floor((lon - span) / width(row)), F.floor((lon + span) / width(row)))

        lon, none = F.col("lon"), F.array().cast("array<bigint>")
        blocks = F.concat(
            ids(lon),
            F.when(lon - span < -180, ids(lon + 360)).otherwise(none),
            F.when(lon + span > 180, ids(lon - 360)).otherwise(none),
        )
        return near.withColumn("_nbx", F.explode(F.array_distinct(blocks)))

    row = F.floor(F.col("lat") / F.lit(side)).cast("long")
    # copies of a location after its first can never be kept
    open_ = cut_lineage(
        points.groupBy("lat", "lon")
        .agg(F.min(order).alias("_seq"))
        .withColumn("_by", row)
        .withColumn("_bx", F.floor(F.col("lon") / width(F.col("_by"))))
    )
    kept = None
    while True:
        heads = (
            open_.groupBy("_by", "_bx")
            .agg(F.min(F.struct("_seq", "lat", "lon")).alias("h"))
            .select("_by", "_bx", "h._seq", "h.lat", "h.lon")
        )
        rivals = heads.select(F.col("_by").alias("_nby"), F.col("_bx").alias("_nbx"), F.col("_seq").alias("_rseq"))
        winners = (
            around(heads)
            .join(rivals, ["_nby", "_nbx"])
            .groupBy("_by", "_bx", "_seq", "lat", "lon")
            .agg(F.min("_rseq").alias("_low"))
            .where(F.col("_low") >= F.col("_seq"))
            .drop("_low")
        )
        # a block is reached by a bounded number of kept points, which lie km apart
        reach = around(winners).select(
            F.col("_nby").alias("_by"), F.col("_nbx").alias("_bx"), F.col("lat").alias("_klat"), F.col("lon").alias("_klon")
        )
        same = (F.col("o.lat") == F.col("k._klat")) & (F.col("o.lon") == F.col("k._klon"))
        near = same | (haversine_km("o.lat", "o.lon", "k._klat", "k._klon") < km)
        block = (F.col("o._by") == F.col("k._by")) & (F.col("o._bx") == F.col("k._bx"))
        still = open_.alias("o").join(reach.alias("k"), block & near, "left_anti")
        # one stored table per round holds what it kept and what stays open
        state = cut_lineage(
            still.withColumn("_kept", F.lit(False)).unionByName(winners.withColumn("_kept", F.lit(True)))
        )
        new, open_ = state.where("_kept").drop("_kept"), state.where("NOT _kept").drop("_kept")
        kept = new if kept is None else kept.unionByName(new)
        if open_.isEmpty():
            break
    chosen = kept.select("lat", "lon", F.col("_seq").alias(order))
    return points.join(chosen, ["lat", "lon", order], "left_semi")


def build_sites(lists: Sequence[tuple[DataFrame, int]], km: float = 1.0) -> DataFrame:
    """Site lists of several campaigns as one, thinned in order of the lists.

    A name already present in an earlier list is not added again. Each list has
    ``name, lat, lon, seq``.
    """
    stacked = None
    for i, (df, year) in enumerate(lists):
        part = df.select("name", "lat", "lon", F.lit(year).alias("year"), F.lit(i).alias("_list"), "seq")
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy("name").agg(F.min("_list").alias("_list"))
    merged = stacked.join(best, ["name", "_list"]).withColumn(
        "order_key", F.struct(F.col("_list"), F.col("seq"), F.col("name"))
    )
    return thin_points(merged, km, "order_key").drop("order_key", "_list")


def site_boxes(sites: DataFrame, grids: Mapping[str, tuple[GridSpec, int]]) -> DataFrame:
    """Box of each site on every product grid, as columns ``lat_min_<product>`` ...."""
    for name, (g, half) in grids.items():
        sites = site_box(sites, g, half).withColumnsRenamed(
            {c: f"{c}_{name}" for c in ("lat_min", "lat_max", "lon_min", "lon_max")}
        )
    return sites


def union_box(
    df: DataFrame, lows: Mapping[str, Sequence[str]], highs: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Smallest box holding several boxes."""
    return df.withColumns(
        {**{out: F.least(*cols) for out, cols in lows.items()}, **{out: F.greatest(*cols) for out, cols in highs.items()}}
    )
