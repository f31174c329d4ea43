"""Regular grids as metadata: a raster is a long table keyed by integer indices.

Coordinates never take part in a join. Everything that is a "nearest cell" or
"slice" lookup on a dense array becomes arithmetic on ``GridSpec`` fields, so the
joins left over are plain equi-joins on ``CELL``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ("lat_idx", "lon_idx")
EARTH_RADIUS_KM = 6371.0088


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_least(c: Column, lo: float) -> Column:
    """Lower bound that leaves NULL alone (``greatest`` would skip it)."""
    return F.when(c < lo, F.lit(lo)).otherwise(c)


@dataclass(frozen=True)
class GridSpec:
    """Centre of cell (0, 0), signed steps and axis lengths."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    nlat: int
    nlon: int

    @property
    def all_round(self) -> bool:
        """Whether the columns go round the whole globe."""
        return abs(self.nlon * abs(self.dlon) - 360.0) < 1e-6

    def lat(self, idx: Column | str = "lat_idx") -> Column:
        return F.lit(float(self.lat0)) + as_col(idx) * F.lit(float(self.dlat))

    def lon(self, idx: Column | str = "lon_idx") -> Column:
        return F.lit(float(self.lon0)) + as_col(idx) * F.lit(float(self.dlon))

    def lat_index(self, lat: Column | str) -> Column:
        """Nearest row; a point half-way between two centres goes to the larger index."""
        return F.floor((as_col(lat) - F.lit(float(self.lat0))) / F.lit(float(self.dlat)) + 0.5).cast("int")

    def lon_index(self, lon: Column | str) -> Column:
        return F.floor((as_col(lon) - F.lit(float(self.lon0))) / F.lit(float(self.dlon)) + 0.5).cast("int")

    def holds(self, lat_idx: Column | str = "lat_idx", lon_idx: Column | str = "lon_idx") -> Column:
        return as_col(lat_idx).between(0, self.nlat - 1) & as_col(lon_idx).between(0, self.nlon - 1)

    def cells_per_degree(self, degrees: float) -> int:
        """Side of a moving window, in cells, for a width given in degrees."""
        return max(1, round(degrees / abs(self.dlat)))

    def area_km2(self, lat_idx: Column | str = "lat_idx") -> Column:
        """Area of a cell on the sphere: R^2 * dlon * (sin north - sin south)."""
        lat = self.lat(lat_idx)
        half = abs(self.dlat) / 2.0
        strip = F.sin(F.radians(lat + half)) - F.sin(F.radians(lat - half))
        return F.lit(EARTH_RADIUS_KM**2 * math.radians(abs(self.dlon))) * strip

    def lattice(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid, generated in parallel."""
        return spark.range(self.nlat * self.nlon).select(
            F.expr(f"CAST(id DIV {self.nlon} AS INT)").alias("lat_idx"),
            F.expr(f"CAST(id % {self.nlon} AS INT)").alias("lon_idx"),
        )

    def axes(self, spark: SparkSession) -> DataFrame:
        """Cells with their coordinates."""
        return self.lattice(spark).withColumns({"lat": self.lat(), "lon": self.lon()})

    def coarser(self, ky: int, kx: int, boundary: str = "pad") -> GridSpec:
        """Grid of k-by-k blocks; centres are the block centres."""
        div = (lambda n, k: -(-n // k)) if boundary == "pad" else (lambda n, k: n // k)
        return GridSpec(
            self.lat0 + self.dlat * (ky - 1) / 2.0,
            self.lon0 + self.dlon * (kx - 1) / 2.0,
            self.dlat * ky,
            self.dlon * kx,
            div(self.nlat, ky),
            div(self.nlon, kx),
        )

    def finer(self, k: int) -> GridSpec:
        return GridSpec(
            self.lat0 - self.dlat * (k - 1) / (2.0 * k),
            self.lon0 - self.dlon * (k - 1) / (2.0 * k),
            self.dlat / k,
            self.dlon / k,
            self.nlat * k,
            self.nlon * k,
        )


def scale_factor(fine: GridSpec, coarse: GridSpec) -> tuple[int, int]:
    """Whole-number block size between two grids (P11); both axes must agree."""
    ky = round(abs(coarse.dlat) / abs(fine.dlat))
    kx = round(abs(coarse.dlon) / abs(fine.dlon))
    if ky != kx or ky < 1:
        raise ValueError(f"grids do not nest evenly: {ky} x {kx}")
    return ky, kx
