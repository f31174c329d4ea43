"""Trends, tests and regressions per series.

Regressions are conditional aggregates, so they combine before the exchange and
hold nothing per series. Rank and pairwise statistics need the series itself:
it is gathered as an array of one value per time step, bounded by the time axis,
and evaluated in Arrow batches, many series at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firegrid.functions.ranks import LISTED, inversions, median_slope
from firegrid.functions.stats import correlation, f_pvalue_df1_1, f_pvalue_df1_2, t_pvalue_from_r
from firegrid.grid import CELL, at_least
from firegrid.operators.ordered import adjust_p
from firegrid.operators.windows import average_rank
from firegrid.session import cut_lineage

__all__ = ["adjust_p"]

_BLOCK = 4_000_000  # pairs held at a time


def one_per_step(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """At most one value per key and time step (mean), which bounds every series by its axis."""
    return df.groupBy(*keys, x).agg(F.avg(y).alias(y))


def series(df: DataFrame, keys: Sequence[str], x: str, y: str, complete: int | None = None) -> DataFrame:
    """Sorted arrays ``xs``/``ys`` per key without missing values; ``complete`` keeps only
    series with that many values.

    Repeats of a step are averaged first, so no array is longer than the time axis. When the
    input is already aggregated per key and step this adds no exchange.
    """
    kept = one_per_step(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()), keys, x, y)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    out = kept.groupBy(*keys).agg(pairs.alias("_p"))
    if complete:
        out = out.where(F.size("_p") == complete)
    return out.select(*keys, F.col("_p.x").alias("xs"), F.col("_p.y").alias("ys"))


def _same_length(xs: pd.Series, ys: pd.Series):
    """Batches of equally long series as matrices, small enough for their pairs."""
    n = ys.map(len).to_numpy()
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        step = max(1, _BLOCK // max(1, length * (length - 1) // 2))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, np.stack(xs.iloc[part].to_list()), np.stack(ys.iloc[part].to_list())


@F.pandas_udf(T.StructType([T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType())]))
def _theil_sen(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    out = np.full((len(xs), 2), np.nan)
    for rows, x, y in _same_length(xs, ys):
        n = x.shape[1]
        if n < 2:
            continue
        if n * (n - 1) // 2 > LISTED * n:
            slope = np.array([median_slope(a, b) for a, b in zip(x, y, strict=True)])
        else:  # few enough slopes to be listed from the start, for many series at once
            i, j = np.triu_indices(n, 1)
            dx = x[:, j] - x[:, i]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(dx != 0, (y[:, j] - y[:, i]) / dx, np.nan)
            slope = np.nanmedian(s, axis=1) if np.isnan(s).any() else np.median(s, axis=1)
        out[rows, 0] = slope
        out[rows, 1] = np.median(y, axis=1) - slope * np.median(x, axis=1)
    return pd.DataFrame({"slope": out[:, 0], "intercept": out[:, 1]})


def _nan_to_null(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def theil_sen(
    df: DataFrame, keys: Sequence[str] = CELL, x: str = "step", y: str = "value", complete: int | None = None
) -> DataFrame:
    """Median pairwise slope and its intercept per series (T1). Input: one row per key and step."""
    fit = series(df, keys, x, y, complete).select(*keys, F.size("ys").alias("n"), _theil_sen("xs", "ys").alias("_f"))
    return fit.select(*keys, "n", F.col("_f.slope").alias("slope"), F.col("_f.intercept").alias("intercept")).withColumns(
        {"slope": _nan_to_null("slope"), "intercept": _nan_to_null("intercept")}
    )


def spearman(df: DataFrame, keys: Sequence[str] = CELL, x: str = "step", y: str = "value") -> DataFrame:
    """Rank correlation with time and its p (T2). Both windows and the aggregate share one exchange."""
    kept = one_per_step(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()), keys, x, y)
    ranked = kept.withColumns({"_ry": average_rank(y, keys), "_rx": average_rank(x, keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("rho"))
    return out.withColumn("pval", t_pvalue_from_r("rho", F.col("n") - 2))


def ols(df: DataFrame, keys: Sequence[str] = CELL, x: str = "step", y: str = "value") -> DataFrame:
    """Least squares line with r2 and p (T3): one aggregate."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.withColumns({"_x": F.when(yc.isNotNull(), xc), "_y": F.when(xc.isNotNull(), yc)}).groupBy(*keys).agg(
        F.regr_count("_y", "_x").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        correlation("_x", "_y").alias("r"),
    )
    return out.select(
        *keys,
        "n",
        "slope",
        "intercept",
        (F.col("r") * F.col("r")).alias("r2"),
        t_pvalue_from_r("r", F.col("n") - 2).alias("pval"),
    )


def polyfit_slope(df: DataFrame, keys: Sequence[str] = CELL, x: str = "year", y: str = "value") -> DataFrame:
    """Slope over calendar years with missing values as zero; a slope of zero means no data (T4).

    Zero is judged against the size of the values, since summation order leaves residue.
    """
    v = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    s = F.regr_slope(v, F.col(x).cast("double"))
    return df.groupBy(*keys).agg(F.when(F.abs(s) > F.max(F.abs(v)) * 1e-12, s).alias("slope"))


@F.pandas_udf(T.DoubleType())
def _tau_b(xs: pd.Series, ys: pd.Series) -> pd.Series:
    out = np.full(len(xs), np.nan)
    for rows, x, y in _same_length(xs, ys):
        n = x.shape[1]
        if n < 2:
            continue
        # steps are distinct and ascending: a pair is tied in y, an inversion of y, or in order
        ordered = np.sort(y, axis=1)
        same = ordered[:, 1:] == ordered[:, :-1]
        run = np.cumsum(same, axis=1)
        tied = (run - np.maximum.accumulate(np.where(same, 0, run), axis=1)).sum(axis=1)
        pairs = n * (n - 1) / 2
        untied = pairs - tied
        with np.errstate(divide="ignore", invalid="ignore"):
            out[rows] = np.where(untied > 0, (untied - 2 * inversions(y)) / np.sqrt(pairs * untied), np.nan)
    return pd.Series(out)


def kendall_tau(df: DataFrame, keys: Sequence[str] = CELL, x: str = "step", y: str = "value") -> DataFrame:
    """Kendall's tau-b of each series (T5)."""
    s = series(df, keys, x, y)
    out = s.select(*keys, F.size("ys").alias("n"), _tau_b("xs", "ys").alias("tau"))
    return out.withColumn("tau", _nan_to_null("tau"))


def _rss(x: Column, y: Column) -> Column:
    return F.regr_syy(y, x) - F.coalesce(F.pow(F.regr_sxy(y, x), 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)), F.lit(0.0))


def chow_test(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    x: str = "step",
    y: str = "value",
    inclusive: str = "both",
) -> DataFrame:
    """Chow test for a break at column ``at`` (T7): three residual sums in one aggregate.

    ``inclusive="both"`` puts the break step in both halves, and then counts it in both for F's degrees of freedom;
    p is that of n - 4. F of zero gives p = 1.
    """
    xc, yc, b = F.col(x).cast("double"), F.col(y).cast("double"), F.col(at)
    left = F.col(x) <= b
    right = F.col(x) >= b if inclusive == "both" else F.col(x) > b
    parts = df.where(yc.isNotNull()).withColumns(
        {
            "_x1": F.when(left, xc),
            "_y1": F.when(left, yc),
            "_x2": F.when(right, xc),
            "_y2": F.when(right, yc),
            "_x": xc,
            "_y": yc,
        }
    )
    out = parts.groupBy(*keys).agg(
        F.count("_y").alias("n"),
        _rss(F.col("_x"), F.col("_y")).alias("_all"),
        (_rss(F.col("_x1"), F.col("_y1")) + _rss(F.col("_x2"), F.col("_y2"))).alias("_split"),
        F.count("_y1").alias("n_before"),
        F.count("_y2").alias("n_after"),
    )
    d2 = F.col("n") - 4
    within = F.col("n_before") + F.col("n_after") - 4
    f = (F.col("_all") - F.col("_split")) / 2 / (F.nullif(F.col("_split"), F.lit(0.0)) / F.nullif(within, F.lit(0)))
    return out.withColumn("F", F.when(d2 > 0, at_least(f, 0.0))).select(
        *keys, "n", "n_before", "n_after", "F", f_pvalue_df1_2("F", d2).alias("pval")
    )


def nested_anova(
    df: DataFrame, keys: Sequence[str], dummy: str, x: str = "step", y: str = "value"
) -> DataFrame:
    """``y ~ x`` against ``y ~ x + dummy`` (T8): overall p of both and p of the gain.

    Closed-form normal equations on centred sums; a mean-shifted pass is not needed because
    the ``regr_*`` aggregates are centred already.
    """
    base = df.where(F.col(y).isNotNull()).withColumns(
        {"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double"), "_d": F.col(dummy).cast("double")}
    )
    s = base.groupBy(*keys).agg(
        F.count("_y").alias("n"),
        F.regr_syy("_y", "_x").alias("yy"),
        F.regr_sxx("_y", "_x").alias("xx"),
        F.regr_sxy("_y", "_x").alias("xy"),
        F.regr_sxx("_y", "_d").alias("dd"),
        F.regr_sxy("_y", "_d").alias("dy"),
        F.regr_sxy("_x", "_d").alias("xd"),
    )
    c = F.col
    det = c("xx") * c("dd") - c("xd") * c("xd")
    ess1 = c("xy") * c("xy") / F.nullif(c("xx"), F.lit(0.0))
    # tolerance: a dummy that never changes, or is the trend itself, adds nothing
    usable = det > c("xx") * c("dd") * 1e-12
    ess2 = F.when(
        usable,
        (c("xy") * c("xy") * c("dd") - c("xy") * c("dy") * c("xd") * 2 + c("dy") * c("dy") * c("xx")) / F.nullif(det, F.lit(0.0)),
    )
    s = s.withColumns({"rss1": c("yy") - ess1, "rss2": c("yy") - ess2, "ess1": ess1, "ess2": ess2})
    zero = F.lit(0.0)
    f1 = c("ess1") / (F.nullif(F.greatest(c("rss1"), zero), zero) / (c("n") - 2))
    f2 = c("ess2") / 2 / (F.nullif(F.greatest(c("rss2"), zero), zero) / (c("n") - 3))
    fa = F.greatest(c("rss1") - c("rss2"), zero) / (F.nullif(F.greatest(c("rss2"), zero), zero) / (c("n") - 3))
    out = s.where(c("n") > 3).withColumns({"F_trend": f1, "F_both": f2, "F_gain": fa})
    return out.select(
        *keys,
        "n",
        "F_trend",
        f_pvalue_df1_1("F_trend", c("n") - 2).alias("p_trend"),
        "F_both",
        f_pvalue_df1_2("F_both", c("n") - 3).alias("p_both"),
        "F_gain",
        f_pvalue_df1_1("F_gain", c("n") - 3).alias("p_gain"),
    )


def ols_formula(df: DataFrame, formula: str):
    """Least squares by formula, interactions included (T10): (model, coefficient table)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import LinearRegression

    rf = RFormula(formula=formula, featuresCol="_features", labelCol="_label")
    lr = LinearRegression(featuresCol="_features", labelCol="_label", solver="normal")
    model = Pipeline(stages=[rf, lr]).fit(df)
    fit = model.stages[-1]
    attrs = model.transform(df).schema["_features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for g in attrs.values() for a in g), key=lambda a: a["idx"])] + ["intercept"]
    try:
        errors, pvals = list(fit.summary.coefficientStandardErrors), list(fit.summary.pValues)
    except UnsupportedOperationException:  # a constant label leaves nothing to test
        errors = pvals = [None] * len(names)
    rows = list(zip(names, [*map(float, fit.coefficients), float(fit.intercept)], errors, pvals, strict=True))
    return model, df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, pval double")


def post_event_trend(
    data: DataFrame,
    events: DataFrame,
    until: int,
    method: Callable[..., DataFrame] = ols,
    latest_event: int | None = None,
    key: str = "site",
    x: str = "year",
    y: str = "value",
) -> DataFrame:
    """Trend from each site's event to ``until``."""
    first = events.groupBy(key).agg(F.min("year").alias("_event"))
    if latest_event is not None:
        first = first.where(F.col("_event") <= latest_event)
    return method(data.join(first, key).where(F.col(x).between(F.col("_event"), F.lit(until))), [key], x, y)


def site_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """r2 and Kendall's tau-b of two site attributes over the whole table (T12): see :func:`whole_table_tau`."""
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    line = pts.agg(F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("r"))
    tau = whole_table_tau(pts, "x", "y")
    return line.join(tau).select("n", (F.col("r") * F.col("r")).alias("r2"), "tau")  # one row each


_STRIP_ROWS = 50_000


def _discordant(pts: DataFrame) -> DataFrame:
    """``pairs``, to be summed up: weights of the pairs of distinct points (``x, y, w``) that x and y order differently.

    The points are cut into even ranges twice, in the order (x, y) and in the order (y, x). A pair tied in x or in y
    stands the same way round in both orders, and a value that many points share is spread over ranges like any other. The
    pairs of one x range are counted in its task. Two points of different x ranges part at the highest differing bit
    of the ranges' numbers, as in a merge sort: at that level one lies in the left half of a node and one in the right
    half. A running sum along y counts the right points below each left one, first over the node's y ranges as
    wholes, then inside each.
    """
    pts = cut_lineage(pts)
    k = max(-(-pts.count() // _STRIP_ROWS), 1)
    placed = pts.repartitionByRange(k, "x", "y").withColumn("xb", F.spark_partition_id())
    placed = cut_lineage(placed.repartitionByRange(k, "y", "x").withColumn("yb", F.spark_partition_id()))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        along_y = np.argsort(np.lexsort((pdf["x"], pdf["y"])))
        return pd.DataFrame({"pairs": inversions(along_y[None, :], pdf["w"].to_numpy(float)[None, :])})

    level = F.explode(F.array(*[F.lit(i) for i in range((k - 1).bit_length())]).cast("array<int>"))
    halves = placed.withColumn("level", level).withColumn("half", F.call_function("shiftright", "xb", "level"))
    w, is_left = F.col("w").cast("double"), F.col("half").bitwiseAND(F.lit(1)) == 0
    halves = halves.withColumns({"node": F.shiftright("half", 1), "lw": F.when(is_left, w).otherwise(0.0), "rw": F.when(is_left, 0.0).otherwise(w)})
    ranges = halves.groupBy("level", "node", "yb").agg(F.sum("lw").alias("lw"), F.sum("rw").alias("rw"))

    def counted(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        below = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select((F.col("lw") * F.sum("rw").over(below)).alias("pairs"))

    node = ["level", "node"]
    across = counted(ranges, node, ["yb"]).unionByName(counted(halves, [*node, "yb"], ["y", "x"]))
    return across.unionByName(placed.groupBy("xb").applyInPandas(inside, "pairs double"))


def whole_table_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b over all rows with both values, one row of output; NULL where x or y never changes.

    Rows are merged to distinct points first, with their number as weight. No task holds more than a range of about
    ``_STRIP_ROWS`` points; their number is free.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pts = known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    among = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    ties = lambda c: pts.groupBy(c).agg(F.sum("w").alias("t")).agg(among("t").alias(f"same_{c}"))
    whole = pts.agg(F.sum("w").alias("n"), among("w").alias("same"))
    swapped = _discordant(pts).agg(F.sum("pairs").alias("swapped"))
    s = whole.join(ties("x")).join(ties("y")).join(swapped)  # one row each
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    untied = pairs - F.col("same_x") - F.col("same_y") + F.col("same")
    scale = F.sqrt((pairs - F.col("same_x")) * (pairs - F.col("same_y")))
    return s.select(((untied - 2 * F.coalesce("swapped", F.lit(0.0))) / F.nullif(scale, F.lit(0.0))).alias("tau"))


def zero_insignificant(df: DataFrame, slope: str = "slope", sig: str = "reject") -> DataFrame:
    """Slopes without significance set to zero."""
    return df.withColumn(slope, F.when(F.col(sig), F.col(slope)).otherwise(F.lit(0.0)))


def apply_series(
    df: DataFrame, keys: Sequence[str], order: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Escape hatch: any function of one whole ordered series (bounded by its time axis)."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: fn(pdf.sort_values(order)), schema)
