"""Queries: drivers model and scenarios (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions.geo import cos_weight
from firegrid.functions.stats import correlation
from firegrid.grid import CELL
from firegrid.operators import model as L
from firegrid.operators.aggregate import annual_burned_fraction
from firegrid.plans import fixtures as X
from firegrid.plans.fixtures import G, table
from firegrid.plans.queries_joins import SEASON_SQL
from firegrid.plans.registry import q6, query, r6

BF_MIN = 0.1
COSW = "cos(radians(40.0e0 + lat_idx * 1.5e0))"
TARGET, FEATS = "AnBF", (*L.FEATURES, "treecover")

_BURN = """hits AS (SELECT DISTINCT lat_idx, lon_idx, year FROM grid_obs WHERE value >= 45),
  bf AS (SELECT lat_idx, lon_idx, count(*) / 7.0e0 AS f FROM hits GROUP BY ALL)"""


def _burn(spark, d):
    return annual_burned_fraction(X.grid_obs(spark, d).withColumn("hit", F.col("value") >= 45), len(X.YEARS), "hit")


def _training(spark, d, sf=None):
    cover = X.grid_static(spark, d).select(*CELL, "treecover")
    return L.feature_table(_burn(spark, d), X.climate(spark, d), cover, G, BF_MIN, sf=sf)


_SEAS = ", ".join(
    f"avg(CASE WHEN {SEASON_SQL} = '{s}' THEN {v} END) AS {v}{s}" for v in ("ppt", "tmean") for s in ("DJF", "MAM", "JJA", "SON")
)
_FT = f"""{_BURN}, cl AS (SELECT lat_idx, lon_idx, {_SEAS} FROM climate GROUP BY ALL),
  ft AS (SELECT lat_idx, lon_idx, f, cl.* EXCLUDE (lat_idx, lon_idx), treecover FROM bf JOIN cl USING (lat_idx, lon_idx) JOIN grid_static USING (lat_idx, lon_idx) WHERE f >= {BF_MIN}e0),
  fc AS (SELECT * FROM ft WHERE {" AND ".join(f"{c} IS NOT NULL" for c in FEATS)})"""


@query(
    "l1_feature_table",
    "grid_obs grid_static climate",
    f"""SELECT lat_idx, lon_idx, {q6("f")} AS "AnBF", {", ".join(f'{q6(c, 9)} AS "{c}"' for c in FEATS)} FROM fc""",
    also=_FT,
)
def l1(spark, d):
    t = _training(spark, d)
    return t.select(*CELL, r6("AnBF").alias("AnBF"), *[r6(c, 9).alias(c) for c in FEATS])


def hash_sql(*keys: str, salt: int = 0) -> str:
    """SQL twin of the key hash."""
    p, out = L.HASH_PRIME, f"CAST({salt} AS BIGINT)"
    for k in keys:
        for half in (f"CAST({k} AS BIGINT)", f"(CAST({k} AS BIGINT) >> 31)"):
            out = f"(({out} * 31 + (({half} % {p}) + {p}) % {p} + 17) % {p})"
            out = f"(({out} * 48271 + 104729) % {p})"
    return f"({out} % 100)"


@query(
    "l2_hash_split",
    "grid_obs",
    f"""SELECT year, count(*) AS n, count(CASE WHEN {hash_sql("lat_idx", "lon_idx")} < 80 THEN 1 END) AS n_train FROM grid_obs GROUP BY year""",
)
def l2(spark, d):
    return L.hash_split(X.grid_obs(spark, d)).groupBy("year").agg(F.count("*").alias("n"), F.count_if("is_train").alias("n_train"))


_PLACE = "CASE WHEN hi = lo THEN (hi - 1 + CASE WHEN ks[hi + 1] > ks[hi] THEN (x - ks[hi]) / (ks[hi + 1] - ks[hi]) ELSE 0 END) / 10.0e0 ELSE (lo + hi - 1) / 2.0e0 / 10.0e0 END"


@query(
    "l3_quantile_uniform",
    "",
    f"""SELECT id, {q6(f"CASE WHEN x <= ks[1] THEN 0.0e0 WHEN x >= ks[11] THEN 1.0e0 ELSE {_PLACE} END")} AS u FROM (
        SELECT id, x, ks, len(list_filter(ks, lambda k: k < x)) AS lo, len(list_filter(ks, lambda k: k <= x)) AS hi FROM v, kn)""",
    also="""v AS (SELECT l_orderkey * 100 + l_partkey % 100 AS id, l_quantity AS x FROM lineitem),
  kn AS (SELECT quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS ks FROM v)""",
)
def l3(spark, d):
    v = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_partkey") % 100).alias("id"), F.col("l_quantity").alias("u"))
    return L.QuantileUniform.fit(v, ["u"], 11).transform(v).select("id", r6("u").alias("u"))


@query(
    "l4_linear_model",
    "grid_obs grid_static climate",
    f"""SELECT lat_idx, lon_idx, {q6("b + a * treecover", 5)} AS pred FROM fc, (SELECT CASE WHEN min(treecover) < max(treecover) THEN regr_slope(f, treecover) ELSE 0 END AS a, CASE WHEN min(treecover) < max(treecover) THEN regr_intercept(f, treecover) ELSE avg(f) END AS b FROM fc)""",
    also=_FT,
)
def l4(spark, d):
    t = _training(spark, d)
    m = L.fit_models(t, ["treecover"], TARGET, ["linear"])
    return m["linear"].transform(t).select(*CELL, r6("pred_linear", 5).alias("pred"))


@query("l5_boosted_trees")
def l5(spark, d):
    t = L.hash_split(_training(spark, d, sf=9))
    m = L.fit_models(t.where("is_train"), FEATS, TARGET, ["gbt"], trees=5, depth=4)
    return m["gbt"].transform(t.where(~F.col("is_train"))).select(*CELL, TARGET, "pred_gbt")


@query("l5_boosted_forests")
def l5_forests(spark, d):
    t = L.hash_split(_training(spark, d, sf=9))
    m = L.fit_boosted_forests(t.where("is_train"), FEATS, TARGET, rounds=4, trees=5, depth=4)
    return m.transform(t.where(~F.col("is_train"))).select(*CELL, TARGET, "pred_forests")


@query(
    "l6_r2",
    "",
    f"""SELECT g, n, {q6("1 - sse / nullif(sst, 0)")} AS r2 FROM (SELECT o_orderpriority AS g, count(*) AS n, sum(pow(o_totalprice - o_custkey * 150.0e0, 2)) AS sse, var_pop(o_totalprice) * count(*) AS sst FROM orders WHERE o_custkey > 20 GROUP BY 1)""",
)
def l6(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice", "o_custkey", (F.col("o_custkey") * 150.0).alias("yhat"))
    return L.r2(o, "o_totalprice", "yhat", F.col("o_custkey") > 20, ["g"]).select("g", "n", r6("r2").alias("r2"))


@query("l7_permutation_importance")
def l7(spark, d):
    t = L.hash_split(_training(spark, d, sf=9))
    feats = ["pptJJA", "tmeanJJA", "treecover"]
    m = L.fit_models(t.where("is_train"), feats, TARGET, ["linear"])
    return L.permutation_importance(m["linear"], t.where(~F.col("is_train")), feats, TARGET, "pred_linear", repeats=3)


def place_sql(row: str, n: str, run: str) -> str:
    """SQL twin of the keyed order of rows."""
    p = L.HASH_PRIME
    c = f"(({run} * 48271 + i * 69621 + 104729) % {p})"
    other = f"((((({c} * {c} + 16807) % {p}) * {p} + ({c} * 39373 + i) % {p}) % {n} - x + {n}) % {n})"
    top = f"greatest(x, {other})"
    bit = f"((({top} % {p}) * (({c} * 69621 + 12345) % {p}) + ({top} // {p}) * 39373 + {c}) % {p})"
    return f"list_reduce(list_prepend({row}, range(1, {L.ROUNDS + 1})), lambda x, i: CASE WHEN (({bit} * {bit} + 16807) % {p}) % 2 = 1 THEN {other} ELSE x END)"


_MOVED = f"""{_FT}, nr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lat_idx, lon_idx) - 1 AS r, count(*) OVER () AS n FROM fc),
  mv AS MATERIALIZED (SELECT nr.*, feature, rep, {place_sql("r", "n", "run")} AS src FROM nr, (VALUES ('treecover', 0, 0::BIGINT), ('treecover', 1, 1::BIGINT), ('pptDJF', 0, 2::BIGINT), ('pptDJF', 1, 3::BIGINT)) AS u(feature, rep, run))"""


@query(
    "l7_permuted_rows",
    "grid_obs grid_static climate",
    f"""SELECT a.lat_idx, a.lon_idx, a.feature, a.rep, {q6("CASE WHEN a.feature = 'treecover' THEN b.treecover ELSE a.treecover END", 9)} AS treecover, {q6("""CASE WHEN a.feature = 'pptDJF' THEN b.pptDJF ELSE a.pptDJF END""", 9)} AS ppt FROM mv AS a JOIN nr AS b ON b.r = a.src""",
    also=_MOVED,
)
def l7_rows(spark, d):
    rows = _training(spark, d).select(*CELL, "treecover", "pptDJF")
    return L.permuted_rows(rows, ["treecover", "pptDJF"], 2).select(*CELL, "feature", "rep", r6("treecover", 9).alias("treecover"), r6("pptDJF", 9).alias("ppt"))


@query(
    "l7_cover_importance",
    "grid_obs grid_static climate",
    f"""SELECT 'treecover' AS feature, {q6("avg(base - score)", 5)} AS importance, {q6("stddev_pop(base - score)", 5)} AS spread FROM (
        SELECT rep, 1 - sum(pow(y - b - a * x, 2)) / (var_pop(y) * count(*)) AS score, 1 - sum(pow(y - b - a * own, 2)) / (var_pop(y) * count(*)) AS base FROM (
          SELECT m.rep, m.f AS y, m.treecover AS own, o.treecover AS x, s.* FROM mv AS m JOIN nr AS o ON o.r = m.src, sl AS s WHERE m.feature = 'treecover') GROUP BY rep)""",
    also=f"""{_MOVED}, sl AS (SELECT CASE WHEN min(treecover) < max(treecover) THEN regr_slope(f, treecover) ELSE 0 END AS a, CASE WHEN min(treecover) < max(treecover) THEN regr_intercept(f, treecover) ELSE avg(f) END AS b FROM fc)""",
)
def l7_cover(spark, d):
    t = _training(spark, d)
    m = L.fit_models(t, ["treecover"], TARGET, ["linear"])
    out = L.permutation_importance(m["linear"], t, ["treecover"], TARGET, "pred_linear", repeats=2)
    return out.select("feature", r6("importance", 5).alias("importance"), r6("spread", 5).alias("spread"))


@query("l7_tree_importance")
def l7_tree(spark, d):
    t = _training(spark, d, sf=9)
    m = L.fit_models(t, FEATS, TARGET, ["forest"], trees=5, depth=4)
    return L.tree_importance(spark, m["forest"], FEATS)


_SCEN = """cm AS (SELECT lat_idx, lon_idx, avg(ppt) AS ppt, avg(tmean) AS tmean FROM climate GROUP BY ALL),
  ct AS (SELECT lat_idx, lon_idx, regr_slope(ppt, year) AS sp, regr_slope(tmean, year) AS st, CASE WHEN min(year) < max(year) AND min(tmean) < max(tmean) THEN abs(corr(year, tmean)) > 0.3e0 ELSE false END AS sig FROM climate GROUP BY ALL HAVING count(*) >= 15)"""


def _scenario_inputs(spark, d):
    c = X.climate(spark, d)
    y = F.col("year").cast("double")
    clim = c.groupBy(*CELL).agg(F.avg("ppt").alias("ppt"), F.avg("tmean").alias("tmean"))
    slopes = (
        c.groupBy(*CELL)
        .agg(
            F.count("*").alias("n"),
            F.regr_slope("ppt", y).alias("slope_ppt"),
            F.regr_slope("tmean", y).alias("slope_tmean"),
            F.coalesce(F.abs(correlation(y, F.col("tmean"))) > 0.3, F.lit(False)).alias("sig_tmean"),
        )
        .where("n >= 15")
        .withColumn("sig_ppt", F.lit(False))
        .drop("n")
    )
    return clim, slopes


@query(
    "l8_trend_scenario",
    "climate",
    f"""SELECT lat_idx, lon_idx, CAST(h AS INTEGER) AS horizon, {q6("ppt + coalesce(sp, 0) * h")} AS ppt, {q6("tmean + coalesce(st, 0) * h")} AS tmean FROM cm LEFT JOIN ct USING (lat_idx, lon_idx), (VALUES (30), (60), (100)) v(h)""",
    also=_SCEN,
)
def l8(spark, d):
    clim, slopes = _scenario_inputs(spark, d)
    out = L.trend_scenario(clim, slopes, ["ppt", "tmean"], (30, 60, 100))
    return out.select(*CELL, "horizon", r6("ppt").alias("ppt"), r6("tmean").alias("tmean"))


@query(
    "l8_trend_scenario_sig",
    "climate",
    f"""SELECT lat_idx, lon_idx, CAST(30 AS INTEGER) AS horizon, {q6("tmean + CASE WHEN coalesce(sig, false) THEN coalesce(st, 0) ELSE 0 END * 30")} AS tmean FROM cm LEFT JOIN ct USING (lat_idx, lon_idx)""",
    also=_SCEN,
)
def l8_sig(spark, d):
    clim, slopes = _scenario_inputs(spark, d)
    out = L.trend_scenario(clim, slopes, ["tmean"], (30,), sig_only=True)
    return out.select(*CELL, "horizon", r6("tmean").alias("tmean"))


@query(
    "l9_given_scenario",
    "cells climate",
    f"""SELECT c.lat_idx, c.lon_idx, {q6("ppt", 9)} AS ppt, {q6("tmean", 9)} AS tmean, CASE WHEN ppt IS NULL THEN 1 ELSE 0 END + CASE WHEN tmean IS NULL THEN 1 ELSE 0 END AS n_missing
        FROM cells c LEFT JOIN (SELECT lat_idx, lon_idx, avg(ppt) AS ppt, avg(tmean + 4) AS tmean FROM climate GROUP BY ALL) USING (lat_idx, lon_idx)""",
)
def l9(spark, d):
    fut = X.climate(spark, d).groupBy(*CELL).agg(F.avg("ppt").alias("ppt"), F.avg(F.col("tmean") + 4).alias("tmean"))
    out = L.given_scenario(fut, X.cells(spark), ["ppt", "tmean"])
    return out.select(*CELL, r6("ppt", 9).alias("ppt"), r6("tmean", 9).alias("tmean"), "n_missing")


@query(
    "l10_predict",
    "grid_obs grid_static climate",
    f"""SELECT lat_idx, lon_idx, {q6("greatest(b + a * treecover, 0.45e0)", 5)} AS pred FROM grid_static, (SELECT CASE WHEN min(treecover) < max(treecover) THEN regr_slope(f, treecover) ELSE 0 END AS a, CASE WHEN min(treecover) < max(treecover) THEN regr_intercept(f, treecover) ELSE avg(f) END AS b FROM fc) WHERE treecover IS NOT NULL AND land
        UNION ALL SELECT lat_idx, lon_idx, NULL FROM grid_static WHERE treecover IS NULL OR NOT land""",
    also=_FT,
)
def l10(spark, d):
    m = L.fit_models(_training(spark, d), ["treecover"], TARGET, ["linear"])
    now = X.grid_static(spark, d).select(*CELL, F.when(F.col("land"), F.col("treecover")).alias("treecover"))
    return L.predict(m, now, 0.45).select(*CELL, r6("pred_linear", 5).alias("pred"))


_PRED = f"""pv AS (SELECT line, value, {COSW} AS w FROM grid_obs),
  pm AS (SELECT line, sum(w * value) / sum(w) AS m FROM pv GROUP BY line),
  pd AS (SELECT line, value, sum(w) AS w FROM pv GROUP BY ALL),
  pc AS (SELECT line, value, sum(w) OVER (PARTITION BY line ORDER BY value) AS c, sum(w) OVER (PARTITION BY line) AS tw FROM pd)"""


@query(
    "l11_prediction_stats",
    "grid_obs",
    f"""SELECT line, {q6("any_value(m)")} AS mean, {q6("sqrt(sum(w * (value - m) * (value - m)) / sum(w))")} AS std, {q6("any_value(q)")} AS median, {q6("sum(CASE WHEN value <= 15 THEN w ELSE 0 END) / sum(w)")} AS share_0_15
        FROM pv JOIN pm USING (line) JOIN (SELECT line, min(CASE WHEN c >= 0.5e0 * tw THEN value END) AS q FROM pc GROUP BY line) USING (line) GROUP BY line""",
    also=_PRED,
)
def l11(spark, d):
    out = L.prediction_stats(X.grid_obs(spark, d), ["line"], "value", cos_weight(G.lat()), (15, 30))
    return out.select("line", r6("mean").alias("mean"), r6("std").alias("std"), r6("q1").alias("median"), r6("share_0_15").alias("share_0_15"))


@query(
    "l12_prediction_frames",
    "grid_obs",
    f"""SELECT lat_idx, lon_idx, horizon, {q6("1 / CASE WHEN x > 0 THEN x ELSE 1e-6 END", 3)} AS "FRI" FROM (
        SELECT lat_idx, lon_idx, CAST(0 AS INTEGER) AS horizon, avg(b) AS x FROM (SELECT lat_idx, lon_idx, year, avg(CASE WHEN value >= 45 THEN 1.0e0 ELSE 0.0e0 END) AS b FROM grid_obs GROUP BY ALL) GROUP BY ALL
        UNION ALL SELECT lat_idx, lon_idx, CAST(line AS INTEGER), avg(CASE WHEN value >= 45 THEN 1.0e0 ELSE 0.0e0 END) FROM grid_obs GROUP BY ALL)""",
)
def l12(spark, d):
    o = X.grid_obs(spark, d).withColumn("x", (F.col("value") >= 45).cast("double"))
    current = o.groupBy(*CELL, "year").agg(F.avg("x").alias("x"))
    futures = o.groupBy(*CELL, F.col("line").alias("horizon")).agg(F.avg("x").alias("x"))
    return L.prediction_frames(current, futures, "x").select(*CELL, "horizon", r6("FRI", 3).alias("FRI"))


@query(
    "l13_residuals",
    "",
    f"""SELECT o_orderkey, {q6("o - p")} AS res_fraction, {q6("1 / nullif(o, 0) - 1 / nullif(p, 0)")} AS res_interval FROM (SELECT o_orderkey, o_custkey % 50 / 50.0e0 AS o, o_orderkey % 40 / 40.0e0 AS p FROM orders)""",
)
def l13(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50 / 50.0).alias("o"), (F.col("o_orderkey") % 40 / 40.0).alias("p"))
    return L.residuals(o, "o", "p").select("o_orderkey", r6("res_fraction").alias("res_fraction"), r6("res_interval").alias("res_interval"))


