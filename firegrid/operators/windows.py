"""Moving neighbourhoods in space and time.

Spatial windows run along one axis at a time, with the same work per cell at any width
(:func:`_slide`). They are ranges on the integer index, so missing cells do not shift the window.
Inputs hold one row per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec, as_col


def frame_ends(sf: int) -> tuple[int, int]:
    """Offsets of a centred window; an even width reaches one further to the left."""
    return -(sf // 2), (sf - 1) // 2


_SUFFIX, _PREFIX, _RESULT = 0, 1, 2


def _slide(df: DataFrame, cols: Sequence[str], sf: int, axis: str, part: Sequence[str]) -> DataFrame:
    """``df`` with sum, value count and row count of the window around each row: ``_s_<col>``, ``_n_<col>``, ``_rows``.

    The axis is cut into blocks as long as the window, so that a window is the end of one block and the beginning of the
    next. Running sums from the end of the former and from the beginning of the latter meet in it: the work per cell
    is the same at any width, and since nothing is ever subtracted, far large values leave no residue in small ones.

    A group holds two neighbouring blocks of one grid row and the windows that start in the first, so long rows are
    split. A cell enters two groups as a value and one as a result, all in one exchange.
    """
    other = "lon_idx" if axis == "lat_idx" else "lat_idx"
    first, last = frame_ends(sf)
    at, cols = F.col(axis).cast("long"), list(dict.fromkeys(cols))
    block = lambda c: F.floor(c / F.lit(sf)).cast("long")
    # a value stands at its place, a result where its window starts, or ends, behind the value of that place
    role = lambda kind, group, low, high: F.struct(F.lit(kind).alias("_role"), group.alias("_block"), low.alias("_low"), high.alias("_high"))
    roles = F.array(
        role(_SUFFIX, block(at), at, at),
        role(_PREFIX, block(at) - 1, at, at),
        role(_RESULT, block(at + first), at + first, at + last),
    )
    kept = {*cols, *part, *CELL}
    rows = df.select("*", F.inline(roles)).withColumns({c: F.when(F.col("_role") == _RESULT, F.col(c)) for c in df.columns if c not in kept})
    group = Window.partitionBy(*part, other, "_block")
    sums = {}
    for kind, place in ((_SUFFIX, F.desc("_low")), (_PREFIX, F.asc("_high"))):
        so_far = group.orderBy(place, "_role").rowsBetween(Window.unboundedPreceding, 0)
        mine = F.col("_role") == kind
        sums[f"_rows{kind}"] = F.count(F.when(mine, F.lit(1))).over(so_far)
        for c in cols:
            sums[f"_s{kind}_{c}"] = F.sum(F.when(mine, F.col(c).cast("double"))).over(so_far)
            sums[f"_n{kind}_{c}"] = F.count(F.when(mine, F.col(c))).over(so_far)
    both = lambda name: F.col(name.format(_SUFFIX)) + F.col(name.format(_PREFIX))
    out = {"_rows": both("_rows{}")}
    for c in cols:
        one, two = F.col(f"_s{_SUFFIX}_{c}"), F.col(f"_s{_PREFIX}_{c}")
        out |= {f"_s_{c}": F.coalesce(one + two, one, two), f"_n_{c}": both("_n{}_" + c)}
    found = rows.withColumns(sums).where(F.col("_role") == _RESULT).withColumns(out)
    return found.drop(*sums, "_role", "_block", "_low", "_high")


def _stats(col: str) -> dict[str, Column]:
    return {"s": F.col(f"_s_{col}"), "n": F.col(f"_n_{col}"), "rows": F.col("_rows")}


def _drop_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop("_rows", *[f"_{k}_{c}" for k in "sn" for c in cols])


Fold = Callable[[dict[str, Column]], Column]


def mean_fold(min_periods: int = 1) -> Fold:
    """Mean of the values present, NULL below ``min_periods`` of them."""
    return lambda s: F.when(s["n"] >= min_periods, s["s"] / F.nullif(s["n"], F.lit(0)))


def sum_fold(skipna: bool = False) -> Fold:
    """Sum; without ``skipna`` one missing value empties the window."""
    return lambda s: s["s"] if skipna else F.when(s["n"] == s["rows"], s["s"])


def separable(
    df: DataFrame, stats: Mapping[str, tuple[str, Fold]], sf: int, part: Sequence[str] = ()
) -> DataFrame:
    """Several sf x sf neighbourhood statistics at once, ``{out: (column, fold)}``.

    The first pass runs along longitude, the second along latitude over the first one's
    results. All statistics share the two exchanges.
    """
    for axis in ("lon_idx", "lat_idx"):
        cols = [col if axis == "lon_idx" else out for out, (col, _) in stats.items()]
        slid = _slide(df, cols, sf, axis, part)
        found = {out: fold(_stats(c)) for c, (out, (_, fold)) in zip(cols, stats.items(), strict=True)}
        df = _drop_stats(slid.withColumns(found), cols)
    return df


def moving_mean(
    df: DataFrame,
    col: str | Sequence[str],
    sf: int,
    min_periods: int = 1,
    out: str | None = None,
    part: Sequence[str] = (),
) -> DataFrame:
    """Separable moving mean over sf x sf cells (W1, W3): along longitude, then latitude.

    NULL cells are skipped; a pass yields NULL below ``min_periods`` values. A
    mean of means differs from the flat mean where cells are missing, which is
    the behaviour wanted here; see :func:`moving_mean_2d` for the other. A list of columns
    is smoothed in place, in the same two passes.
    """
    if isinstance(col, str):
        stats = {out or f"{col}_mean": (col, mean_fold(min_periods))}
    else:
        stats = {c: (c, mean_fold(min_periods)) for c in col}
    return separable(df, stats, sf, part)


def moving_mean_2d(df: DataFrame, col: str, sf: int, out: str | None = None, part: Sequence[str] = ()) -> DataFrame:
    """Flat mean over the sf x sf window (W5): sums and counts are separable, so two passes are exact."""
    out = out or f"{col}_mean2d"
    df = _slide(df, [col], sf, "lon_idx", part).withColumnsRenamed({f"_s_{col}": "_s", f"_n_{col}": "_n"}).drop("_rows")
    df = _slide(df, ["_s", "_n"], sf, "lat_idx", part).withColumn(out, F.col("_s__s") / F.nullif(F.col("_s__n"), F.lit(0.0)))
    return _drop_stats(df, ["_s", "_n"]).drop("_s", "_n")


def moving_sum(
    df: DataFrame,
    col: str,
    sf: int,
    skipna: bool = False,
    out: str | None = None,
    part: Sequence[str] = (),
) -> DataFrame:
    """Moving sum over sf x sf cells; one missing value empties the window unless ``skipna``.

    At the edge of the grid the window is cut to the cells that exist.
    """
    return separable(df, {out or f"{col}_sum": (col, sum_fold(skipna))}, sf, part)


def weighted_moving_fraction(
    df: DataFrame, value: str, weight: str, sf: int, out: str = "fraction", part: Sequence[str] = ()
) -> DataFrame:
    """Moving sum of value*weight over moving sum of weight (W4); NULL where the weight is zero.

    A missing value counts as zero, a missing weight empties the window.
    """
    df = df.withColumn("_vw", F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight))
    df = separable(df, {"_svw": ("_vw", sum_fold()), "_sw": (weight, sum_fold())}, sf, part)
    return df.withColumn(out, F.col("_svw") / F.nullif(F.col("_sw"), F.lit(0.0))).drop("_vw", "_svw", "_sw")


def trailing_mean(
    df: DataFrame,
    col: str,
    n: int,
    min_periods: int | None = None,
    keys: Sequence[str] = CELL,
    order: str = "year",
    out: str | None = None,
    zero_to_null: bool = False,
) -> DataFrame:
    """Mean of the last n steps of each series."""
    need = n if min_periods is None else min_periods
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    mean = F.when(F.count(col).over(w) >= need, F.avg(col).over(w))
    if zero_to_null:
        mean = F.nullif(mean, F.lit(0.0))
    return df.withColumn(out or f"{col}_trail", mean)


def trend_grid(
    df: DataFrame,
    col: str,
    windows: Sequence[int],
    starts: Sequence[int],
    keys: Sequence[str] = CELL,
    order: str = "year",
    min_share: float = 0.5,
) -> DataFrame:
    """Slope of every (window, start year) smoothing variant.

    All windows share one sort of the series and all start years share one
    aggregate, so the number of variants adds no exchange.
    """
    for n in windows:
        df = trailing_mean(df, col, n, max(1, int(n * min_share)), keys, order, out=f"_w{n}")
    y, x = (lambda n: F.col(f"_w{n}")), F.col(order).cast("double")
    aggs = [
        F.struct(
            F.lit(n).alias("window"),
            F.lit(s).alias("start"),
            F.regr_slope(F.when(x >= s, y(n)), x).alias("slope"),
            F.regr_count(F.when(x >= s, y(n)), x).alias("n"),
        ).alias(f"r{n}_{s}")
        for n in windows
        for s in starts
    ]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[f"r{n}_{s}" for n in windows for s in starts])))


def average_rank(col: Column | str, part: Sequence[str]) -> Column:
    """Rank with ties averaged."""
    c = as_col(col)
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(w.partitionBy(*part, c)) - 1) / 2.0


def time_index(df: DataFrame, part: Sequence[str], order: str = "t", out: str = "step") -> DataFrame:
    """Position 0..n-1 inside each series."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1)


def after_first(df: DataFrame, flag: str, part: Sequence[str], order: str, out: str = "after") -> DataFrame:
    """1 from the first flagged row of each series on (W11); rows at the same position count alike."""
    w = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.max(F.col(flag).cast("int")).over(w), F.lit(0)))


def first_after_event(df: DataFrame, cond: Column, part: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Attributes of the first row meeting a condition (W12): an aggregate, no window needed."""
    return df.where(cond).groupBy(*part).agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in cols if c != order]
    )


def cumulative_trapezoid(
    df: DataFrame, y: str, x: str, part: Sequence[str] = (), out: str = "integral"
) -> DataFrame:
    """Running integral by the trapezoid rule."""
    w = Window.partitionBy(*part).orderBy(x)
    area = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return (
        df.withColumn("_a", F.coalesce(area, F.lit(0.0)))
        .withColumn(out, F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_a")
    )


def site_box(points: DataFrame, g: GridSpec, half: int) -> DataFrame:
    """Coordinates of the box of (2*half+1)^2 cells around each point."""
    row, col = g.lat_index("lat"), g.lon_index("lon")
    pad_y, pad_x = abs(g.dlat) * (half + 0.5), abs(g.dlon) * (half + 0.5)
    return points.withColumns(
        {
            "lat_min": g.lat(row) - pad_y,
            "lat_max": g.lat(row) + pad_y,
            "lon_min": g.lon(col) - pad_x,
            "lon_max": g.lon(col) + pad_x,
        }
    )


def focal_fill(
    df: DataFrame, value: str, radius: int = 1, iterations: int = 2, part: Sequence[str] = (), out: str = "filled"
) -> DataFrame:
    """Gaps filled with the mean of their neighbourhood, known values kept."""
    df = df.withColumn(out, F.col(value))
    for _ in range(iterations):
        df = moving_mean_2d(df, out, 2 * radius + 1, out="_focal", part=part)
        df = df.withColumn(out, F.coalesce(F.col(out), F.col("_focal"))).drop("_focal")
    return df
