"""Climate and vegetation trend maps, and the chain from drivers to future risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.grid import CELL
from firegrid.operators import model as L
from firegrid.operators.aggregate import season_reduce
from firegrid.operators.ordered import adjust_p
from firegrid.operators.trend import spearman, theil_sen
from firegrid.operators.windows import trailing_mean
from firegrid.plans.fire import future_risk


def season_trends(
    monthly: DataFrame,
    col: str,
    how: str,
    window: int = 20,
    min_periods: int = 10,
    method: str = "fdr_bh",
    alpha: float = 0.10,
    complete: int | None = None,
) -> DataFrame:
    """Trend of every cell and season: seasonal value, trailing mean (zero means missing),
    median slope, rank correlation with its p, and false discovery control per season.

    Smoothing, slope and correlation all work on (cell, season) series, so they
    share one partitioning after the seasonal aggregate.
    """
    keys = (*CELL, "season")
    seasons = season_reduce(monthly, {col: how})
    smooth = trailing_mean(
        seasons, col, window, min_periods, keys=keys, order="season_year", out="value", zero_to_null=True
    ).select(*keys, "season_year", "value")
    slopes = theil_sen(smooth, keys, "season_year", "value", complete)
    ranks = spearman(smooth, keys, "season_year", "value").select(*keys, "rho", "pval")
    return adjust_p(slopes.join(ranks, list(keys)), "pval", method, alpha, by=["season"])


def drivers_to_risk(
    training: DataFrame,
    features: Sequence[str],
    target: str,
    future: DataFrame,
    stand: DataFrame,
    floor: float,
    kinds: Sequence[str] = ("linear",),
) -> DataFrame:
    """Fit on the training cells, predict the burned fraction under a future climate, and class the risk.

    ``future``: cells (and any run labels) with the features; ``stand``: cells with ``sr_frac``.
    """
    split = L.hash_split(training)
    models = L.fit_models(split.where("is_train"), features, target, kinds)
    first = f"pred_{kinds[0]}"
    predicted = L.predict(models, future, floor)
    return future_risk(predicted.join(stand, list(CELL)), first).withColumn("has_prediction", F.col(first).isNotNull())
