"""Column expressions: decoding of stored values, dates, ranges and flags.

All of them are built-in Spark expressions, so they fuse into the scan's
whole-stage code and cost no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firegrid.grid import as_col


def in_range(col: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Value when lo <= value <= hi, else NULL."""
    c = as_col(col)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return F.when(ok, c)


def scale_valid(col, factor: float, lo: float | None = None, hi: float | None = None) -> Column:
    """Packed integer to physical value, out-of-range to NULL."""
    return in_range(as_col(col) / F.lit(float(factor)), lo, hi)


def unpack_flag(col) -> tuple[Column, Column]:
    """``2000*flag + 10*percent`` packed in one number, as (flag, percent)."""
    c = as_col(col)
    flag = F.floor(c / F.lit(2000.0))
    return flag.cast("int"), (c - flag * 2000) / F.lit(10.0)


def frac_month_date(year, month) -> Column:
    """Fractional month (7.5 = middle of July) to a date."""
    m = as_col(month)
    return F.make_date(as_col(year), F.floor(m).cast("int"), ((m - F.floor(m)) * 30 + 1).cast("int"))


def doy_date(year, doy, offset: int = -1) -> Column:
    """Year and day number to a date; ``offset=0`` reproduces the one-day-late variant."""
    jan1 = F.make_date(as_col(year), F.lit(1), F.lit(1))
    return F.date_add(jan1, (as_col(doy) + F.lit(offset)).cast("int"))


def ms_timestamp(col) -> Column:
    """Epoch milliseconds to a timestamp (P5)."""
    return F.timestamp_millis(as_col(col).cast("long"))


def date_from_name(col, pattern: str, fmt: str) -> Column:
    """Date taken out of a file name by the first group of ``pattern``."""
    return F.try_to_timestamp(F.regexp_extract(as_col(col), pattern, 1), F.lit(fmt)).cast("date")


def restamp(year, month: int, day: int) -> Column:
    """Fixed day of a year, for annual products."""
    return F.make_date(as_col(year), F.lit(month), F.lit(day))


def null_sentinels(col, codes: Sequence[float] = (), lo=None, hi=None) -> Column:
    """Fill codes and out-of-range values to NULL."""
    c = as_col(col)
    if codes:
        c = F.when(~c.isin(*codes), c)
    return in_range(c, lo, hi)


def reciprocal_floor(col, floor: float = 1e-6) -> Column:
    """``1/value`` where a zero or missing value counts as ``floor``."""
    c = as_col(col)
    return F.lit(1.0) / F.when(c > 0, c).otherwise(F.lit(float(floor)))


def clip(col, lo=None, hi=None, over=None) -> Column:
    """Clamp; ``over`` replaces values above ``hi`` instead of clamping them (P14). NULL stays NULL."""
    c = as_col(col)
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(float(hi if over is None else over))).otherwise(out)
    return out


def label_year(flag, year) -> Column:
    """Year where the flag is set, else NULL."""
    return F.when(as_col(flag), as_col(year))


def threshold(col, op: str, value: float) -> Column:
    """Comparison mask (F7); NULL outside the domain stays NULL."""
    c = as_col(col)
    return {
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        "==": lambda: c == value,
    }[op]()


def burn_flag(col, rule: str, year=None) -> Column:
    """Burn flag from a product's own coding (F8).

    ``date``: burn day above 0; ``code``: value 1; ``loss``: loss-year offset
    from 2000 equals the given year.
    """
    c = as_col(col)
    if rule == "date":
        return c > 0
    if rule == "code":
        return c == 1
    if rule == "loss":
        return (c > 0) & (c == as_col(year) - 2000)
    raise ValueError(f"unknown burn rule {rule!r}")


def season_of(month) -> Column:
    """Meteorological season label of a month number."""
    m = as_col(month)
    return (
        F.when(m.isin(12, 1, 2), "DJF")
        .when(m.isin(3, 4, 5), "MAM")
        .when(m.isin(6, 7, 8), "JJA")
        .when(m.isin(9, 10, 11), "SON")
    )


def season_year(year, month, convention: str = "dec_shift") -> Column:
    """Year a season belongs to: December opens the next winter, or stays in its calendar year (A5)."""
    if convention == "calendar":
        return as_col(year)
    if convention == "dec_shift":
        return as_col(year) + F.when(as_col(month) == 12, 1).otherwise(0)
    raise ValueError(f"unknown season convention {convention!r}")


def lat_band(idx, nlat: int, n: int) -> Column:
    """Equal-size latitude band, remainder in the last one."""
    size = max(1, nlat // n)
    return F.least(F.floor(as_col(idx) / F.lit(size)), F.lit(n - 1)).cast("int")


def right_closed_bin(col, edges: Sequence[float]) -> Column:
    """Index i of the bin ``edges[i] < x <= edges[i+1]``; NULL outside."""
    c = as_col(col)
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out
