"""All registered queries."""

from firegrid.plans import queries_agg, queries_climate, queries_fire, queries_joins, queries_model, queries_sites, queries_sources, queries_trend  # noqa: F401
from firegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
