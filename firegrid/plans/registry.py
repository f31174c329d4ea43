"""Registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.plans.fixtures import ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, also: str = ""):
    """Register a query. ``views`` names shared CTEs, ``also`` adds query-specific ones."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            head = ctes(*views.split()) if views else ""
            if also:
                head = f"{head},\n {also}" if head else f"WITH RECURSIVE {also}"
            ORACLES[name] = f"{head}\n{sql}".strip()
        return fn

    return add


def _shift(digits: int) -> float:
    return 0.0123 * 10.0**-digits


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines.

    Averages of decimals often end in an exact half of the last digit, where the order of
    summation decides the rounding; a shift of a hundredth of that digit puts such ties on one
    side in both engines. Adding zero drops negative zeros.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(_shift(digits)), digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE) + {_shift(digits):e}, {digits}) + 0.0e0)"


def i1(col: Column | str) -> Column:
    """Boolean as 0/1."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("int")


def p_sql(r: str, nu: str) -> str:
    """Two-sided p of a correlation in SQL: the same finite series, its coefficients by log-gamma."""
    s, c2 = f"least(abs({r}), 1.0e0)", f"greatest(1.0e0 - least(abs({r}), 1.0e0) * least(abs({r}), 1.0e0), 0.0e0)"
    even = (
        f"({s} * list_sum(list_transform(range(0, CAST({nu} AS BIGINT) // 2), lambda j: pow({c2}, j) * "
        f"exp(lgamma(j + 0.5e0) - lgamma(j + 1.0e0) - 0.5e0 * ln(pi())))))"
    )
    odd = (
        f"(2.0e0 / pi() * (asin({s}) + {s} * sqrt({c2}) * coalesce(list_sum(list_transform(range(0, (CAST({nu} AS BIGINT) - 1) // 2), lambda j: "
        f"pow({c2}, j) * exp(lgamma(j + 1.0e0) - lgamma(j + 1.5e0) + 0.5e0 * ln(pi()) - ln(2.0e0)))), 0.0e0)))"
    )
    area = f"CASE WHEN {nu} % 2 = 1 THEN {odd} ELSE {even} END"
    return f"(CASE WHEN {nu} >= 1 AND {r} IS NOT NULL AND NOT isnan({r}) THEN least(greatest(1.0e0 - ({area}), 0.0e0), 1.0e0) END)"
