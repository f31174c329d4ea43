"""Queries: whole chains from tables to maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.grid import CELL
from firegrid.operators import model as L
from firegrid.plans import climate as C
from firegrid.plans import fixtures as X
from firegrid.plans.queries_fire import _flag_fraction
from firegrid.plans.queries_joins import SEASON_SQL
from firegrid.plans.queries_model import BF_MIN, FEATS, TARGET, _burn
from firegrid.plans.fixtures import G
from firegrid.plans.registry import p_sql, q6, query, r6

_CHAIN = f"""se AS (SELECT lat_idx, lon_idx, {SEASON_SQL} AS season, year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS sy, avg(value) AS v FROM grid_obs GROUP BY ALL),
  sm AS (SELECT lat_idx, lon_idx, season, sy, nullif(CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END, 0) AS value FROM se WINDOW w AS (PARTITION BY lat_idx, lon_idx, season ORDER BY sy ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  sx AS (SELECT * FROM sm WHERE value IS NOT NULL),
  ts AS (SELECT a.lat_idx, a.lon_idx, a.season, median((b.value - a.value) / (b.sy - a.sy)) AS slope FROM sx a JOIN sx b ON a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx AND a.season = b.season AND b.sy > a.sy GROUP BY ALL),
  rk AS (SELECT lat_idx, lon_idx, season, rank() OVER (PARTITION BY lat_idx, lon_idx, season ORDER BY sy) AS rx, rank() OVER (PARTITION BY lat_idx, lon_idx, season ORDER BY value) + (count(*) OVER (PARTITION BY lat_idx, lon_idx, season, value) - 1) / 2.0e0 AS ry FROM sx),
  rh AS (SELECT lat_idx, lon_idx, season, count(*) AS n, CASE WHEN min(ry) < max(ry) AND min(rx) < max(rx) THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL),
  pv AS (SELECT lat_idx, lon_idx, season, n, rho, {p_sql("rho", "(n - 2)")} AS p FROM rh WHERE rho IS NOT NULL AND n > 2),
  rn AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY p) AS k, count(*) OVER (PARTITION BY season) AS m FROM pv),
  bh AS (SELECT lat_idx, lon_idx, season, min(p * m / k) OVER (PARTITION BY season ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM rn)"""


@query(
    "e2_season_trends",
    "grid_obs",
    f"""SELECT lat_idx, lon_idx, season, n, {q6("slope")} AS slope, {q6("rho")} AS rho, {q6("p")} AS pval, {q6("least(q, 1.0e0)")} AS p_adj FROM pv JOIN bh USING (lat_idx, lon_idx, season) LEFT JOIN ts USING (lat_idx, lon_idx, season)""",
    also=_CHAIN,
)
def e2(spark, d):
    monthly = X.grid_obs(spark, d).select(*CELL, "year", "month", "value")
    out = C.season_trends(monthly, "value", "mean", 3, 2).where("pval IS NOT NULL")
    return out.select(
        *CELL, "season", F.col("n").cast("long").alias("n"), r6("slope").alias("slope"), r6("rho").alias("rho"), r6("pval").alias("pval"), r6("p_adj").alias("p_adj")
    )


@query("e3_drivers_to_risk")
def e3(spark, d):
    cover = X.grid_static(spark, d).select(*CELL, "treecover")
    training = L.feature_table(_burn(spark, d), X.climate(spark, d), cover, G, BF_MIN, sf=9)
    warmer = [f"tmean{s}" for s in ("DJF", "MAM", "JJA", "SON")]
    future = training.select(*CELL, *[(F.col(c) + 4 if c in warmer else F.col(c)).alias(c) for c in FEATS])
    stand = _flag_fraction(spark, d, 49).select(*CELL, F.col("AnBF").alias("sr_frac"))
    return C.drivers_to_risk(training, FEATS, TARGET, future, stand, 0.01).select(*CELL, "risk")
