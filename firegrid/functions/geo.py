"""Distances and weights on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firegrid.grid import EARTH_RADIUS_KM, as_col


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(as_col(lat1)), F.radians(as_col(lat2))
    dlon = F.radians(as_col(lon2)) - F.radians(as_col(lon1))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    known = as_col(lat1).isNotNull() & as_col(lon1).isNotNull() & as_col(lat2).isNotNull() & as_col(lon2).isNotNull()
    # the bound only guards against rounding; ``least`` would turn a NULL into it
    return F.when(known, F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def cos_weight(lat) -> Column:
    """Relative area of a grid cell by latitude."""
    return F.cos(F.radians(as_col(lat)))
