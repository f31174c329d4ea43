"""Queries: aggregations (A) and moving windows (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions.geo import cos_weight
from firegrid.grid import CELL, GridSpec
from firegrid.operators import aggregate as A
from firegrid.operators import field as Fd
from firegrid.operators import scenes as Sc
from firegrid.operators import sites as St
from firegrid.operators import windows as W
from firegrid.plans import fire as P
from firegrid.plans import fixtures as X
from firegrid.plans.fixtures import G, table
from firegrid.plans.queries_fire import two_pass, two_pass_sum
from firegrid.plans.queries_joins import SEASON_SQL
from firegrid.plans.registry import i1, q6, query, r6

LAT = "(40.0e0 + lat_idx * 1.5e0)"
COSW = f"cos(radians({LAT}))"
AREA = f"(6371.0088e0 * 6371.0088e0 * radians(5.0e0) * (sin(radians({LAT} + 0.75e0)) - sin(radians({LAT} - 0.75e0))))"


@query("a1_annual_any", "grid_obs", "SELECT lat_idx, lon_idx, year, max(CASE WHEN burnt THEN 1 ELSE 0 END) AS burnt FROM grid_obs GROUP BY ALL")
def a1(spark, d):
    return A.annual_any(X.grid_obs(spark, d), "burnt").select(*CELL, "year", i1("burnt").alias("burnt"))


@query("a2_annual_max", "grid_obs", "SELECT lat_idx, lon_idx, year, max(value) AS value FROM grid_obs GROUP BY ALL")
def a2(spark, d):
    return A.annual_max(X.grid_obs(spark, d), "value")


@query(
    "a3_monthly_max",
    "grid_obs",
    "SELECT lat_idx, lon_idx, strftime(date_trunc('month', t), '%Y-%m-%d') AS month_start, max(value) AS value FROM grid_obs GROUP BY ALL",
)
def a3(spark, d):
    out = A.monthly_max(X.grid_obs(spark, d), "value")
    return out.select(*CELL, F.col("month_start").cast("string").alias("month_start"), "value")


@query(
    "a4_annual_reduce",
    "climate",
    f"SELECT lat_idx, lon_idx, year, {q6('sum(ppt)')} AS ppt, {q6('avg(tmean)', 9)} AS tmean FROM climate GROUP BY ALL",
)
def a4(spark, d):
    out = A.annual_reduce(X.climate(spark, d), {"ppt": "sum", "tmean": "mean"})
    return out.select(*CELL, "year", r6("ppt").alias("ppt"), r6("tmean", 9).alias("tmean"))


def _season(conv: str, year_sql: str):
    @query(
        f"a5_season_{conv}",
        "climate",
        f"SELECT lat_idx, lon_idx, {year_sql} AS season_year, {SEASON_SQL} AS season, {q6('sum(ppt)')} AS ppt, {q6('avg(tmean)', 9)} AS tmean FROM climate GROUP BY ALL",
    )
    def a5(spark, d):
        out = A.season_reduce(X.climate(spark, d), {"ppt": "sum", "tmean": "mean"}, conv)
        return out.select(*CELL, "season_year", "season", r6("ppt").alias("ppt"), r6("tmean", 9).alias("tmean"))


_season("dec_shift", "year + CASE WHEN month = 12 THEN 1 ELSE 0 END")
_season("calendar", "year")


@query(
    "a6_season_climatology",
    "climate",
    f"SELECT lat_idx, lon_idx, {SEASON_SQL} AS season, {q6('avg(ppt)', 9)} AS ppt, {q6('avg(tmean)', 9)} AS tmean FROM climate GROUP BY ALL",
)
def a6(spark, d):
    out = A.season_climatology(X.climate(spark, d), ["ppt", "tmean"])
    return out.select(*CELL, "season", r6("ppt", 9).alias("ppt"), r6("tmean", 9).alias("tmean"))


@query(
    "a7_burned_fraction",
    "anbf",
    f"""SELECT lat_idx, lon_idx, {q6('"AnBF"')} AS "AnBF" FROM anbf WHERE "AnBF" > 0""",
)
def a7(spark, d):
    out = A.annual_burned_fraction(X.grid_obs(spark, d), len(X.YEARS))
    return out.select(*CELL, r6("AnBF").alias("AnBF"))


_BLK = "CAST(lat_idx // 3 AS INTEGER) AS lat_idx, CAST(lon_idx // 3 AS INTEGER) AS lon_idx"


@query(
    "a8_coarsen_pad",
    "grid_static",
    f"SELECT {_BLK}, {q6('avg(treecover)', 9)} AS mean, max(treecover) AS max, sum(treecover) AS sum, median(treecover) AS median FROM grid_static GROUP BY lat_idx // 3, lon_idx // 3",
)
def a8(spark, d):
    s = X.grid_static(spark, d)
    out = None
    for how in ("mean", "max", "sum", "median"):
        part = A.coarsen(s, "treecover", 3, 3, how, out=how)
        out = part if out is None else out.join(part, list(CELL))
    return out.withColumn("mean", r6("mean", 9))


@query(
    "a8_coarsen_trim_strict",
    "grid_static",
    f"""SELECT {_BLK}, {q6("CASE WHEN count(CASE WHEN land THEN treecover END) = count(*) THEN avg(treecover) END", 9)} AS treecover FROM grid_static
        WHERE lat_idx < 18 AND lon_idx < 39 GROUP BY lat_idx // 3, lon_idx // 3""",
)
def a8_trim(spark, d):
    s = X.grid_static(spark, d).withColumn("treecover", F.when(F.col("land"), F.col("treecover")))
    out = A.coarsen(s, "treecover", 3, 3, "mean", boundary="trim", skipna=False, g=G)
    return out.withColumn("treecover", r6("treecover", 9))


@query(
    "a9_coarsen_fraction",
    "grid_static",
    f"""SELECT {_BLK}, {q6("CASE WHEN count(treecover) = count(*) THEN avg(CASE WHEN treecover >= 30 THEN 1.0e0 WHEN treecover < 30 THEN 0.0e0 END) END")} AS w FROM grid_static
        WHERE lat_idx < 18 AND lon_idx < 39 GROUP BY lat_idx // 3, lon_idx // 3""",
)
def a9(spark, d):
    return P.forest_weights(X.grid_static(spark, d), 3, 30.0, G).select(*CELL, r6("w").alias("w"))


@query("a10_annual_sum", "grid_obs", f"SELECT lat_idx, lon_idx, year, {q6('sum(disc)')} AS disc FROM grid_obs GROUP BY ALL")
def a10(spark, d):
    return A.annual_sum(X.grid_obs(spark, d), "disc").withColumn("disc", r6("disc"))


@query(
    "a11_regional_series",
    "grid_obs grid_static",
    f"SELECT year, {q6('avg(value)', 9)} AS value FROM grid_obs o JOIN grid_static s USING (lat_idx, lon_idx) WHERE s.land GROUP BY year",
)
def a11(spark, d):
    out = A.regional_series(X.grid_obs(spark, d), X.grid_static(spark, d), "value", "year", "land")
    return out.withColumn("value", r6("value", 9))


@query(
    "a12_coslat_fraction",
    "grid_static",
    f"SELECT landcover, {q6(f'sum(CASE WHEN treecover > 50 THEN {COSW} ELSE 0 END) / sum({COSW})')} AS fraction FROM grid_static WHERE treecover IS NOT NULL GROUP BY landcover",
)
def a12(spark, d):
    s = X.grid_static(spark, d).where("treecover IS NOT NULL")
    out = A.coslat_fraction(s, F.col("treecover") > 50, F.col("treecover").isNotNull(), G.lat(), ["landcover"])
    return out.withColumn("fraction", r6("fraction"))


@query(
    "a13_area_sum",
    "grid_static",
    f"SELECT landcover, {q6(f'sum(CASE WHEN treecover > 50 THEN {AREA} ELSE 0 END)', 3)} AS km2 FROM grid_static GROUP BY landcover",
)
def a13(spark, d):
    return A.area_sum(X.grid_static(spark, d), F.col("treecover") > 50, G, ["landcover"]).withColumn("km2", r6("km2", 3))


_WOBS = f"""wobs AS (SELECT line, value, {COSW} AS w FROM grid_obs)"""


def _weighted(spark, d):
    return X.grid_obs(spark, d).select("line", "value", cos_weight(G.lat()).alias("w"))


@query(
    "a14_weighted_mean_std",
    "grid_obs",
    f"""SELECT line, {q6("any_value(m)")} AS mean, {q6("sqrt(sum(w * (value - m) * (value - m)) / sum(w))")} AS std
        FROM wobs JOIN (SELECT line, sum(w * value) / sum(w) AS m FROM wobs GROUP BY line) USING (line) GROUP BY line""",
    also=_WOBS,
)
def a14(spark, d):
    out = A.weighted_mean_std(_weighted(spark, d), "value", "w", ["line"])
    return out.select("line", r6("mean").alias("mean"), r6("std").alias("std"))


# fixed values: the probabilities reported for weighted distributions
PROBS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def _wq(p: float) -> str:
    return (
        f"(min(CASE WHEN c >= {p}e0 * tw - tw * 1e-12 THEN value END) + coalesce(min(CASE WHEN c > {p}e0 * tw + tw * 1e-12 THEN value END), "
        f"min(CASE WHEN c >= {p}e0 * tw - tw * 1e-12 THEN value END))) / 2"
    )


@query(
    "a15_weighted_quantiles",
    "grid_obs",
    "SELECT line, " + ", ".join(f"{q6(_wq(p))} AS q{i}" for i, p in enumerate(PROBS)) + " FROM cum GROUP BY line",
    also=_WOBS
    + """, dv AS (SELECT line, value, sum(w) AS w FROM wobs GROUP BY ALL),
  cum AS (SELECT line, value, sum(w) OVER (PARTITION BY line ORDER BY value) AS c, sum(w) OVER (PARTITION BY line) AS tw FROM dv)""",
)
def a15(spark, d):
    out = A.weighted_percentiles(_weighted(spark, d), "value", "w", PROBS, ["line"])
    return out.select("line", *[r6(f"q{i}").alias(f"q{i}") for i in range(len(PROBS))])


@query(
    "a16_interval_shares",
    "grid_obs",
    f"""SELECT line, {q6(f"sum(CASE WHEN value <= 15 THEN {COSW} ELSE 0 END) / sum({COSW})")} AS share_0_15, {q6(f"sum(CASE WHEN value <= 15 THEN {COSW} ELSE 0 END)", 4)} AS sum_0_15,
        {q6(f"sum(CASE WHEN value > 15 AND value <= 30 THEN {COSW} ELSE 0 END) / sum({COSW})")} AS share_15_30, {q6(f"sum(CASE WHEN value > 15 AND value <= 30 THEN {COSW} ELSE 0 END)", 4)} AS sum_15_30
        FROM grid_obs GROUP BY line""",
)
def a16(spark, d):
    out = A.interval_shares(X.grid_obs(spark, d), "value", (15, 30), cos_weight(G.lat()), ["line"])
    return out.select(
        "line", *[r6(c, 6 if c.startswith("share") else 4).alias(c) for c in out.columns if c != "line"]
    )


@query(
    "a17_class_shares",
    "grid_static",
    f"""SELECT landcover, {q6(f"sum({AREA})", 3)} AS weight, {q6(f"sum({AREA}) / sum(sum({AREA})) OVER () * 100")} AS percent FROM grid_static WHERE landcover IS NOT NULL GROUP BY landcover""",
)
def a17(spark, d):
    out = A.class_shares(X.grid_static(spark, d), "landcover", G.area_km2())
    return out.select("landcover", r6("weight", 3).alias("weight"), r6("percent").alias("percent"))


_SLOPES = """sl AS (SELECT lat_idx, lon_idx, CASE WHEN min(year) < max(year) THEN regr_slope(value, year) END AS slope, count(*) AS n FROM grid_obs GROUP BY ALL)"""


@query(
    "a18_trend_summary",
    "grid_obs",
    f"""SELECT {q6("avg(slope)")} AS mean, {q6("stddev_pop(slope)")} AS sd, {q6("var_pop(slope)")} AS var, {q6("max(slope)")} AS max, {q6("min(slope)")} AS min,
        {q6("count(CASE WHEN abs(slope) > 0.5e0 AND slope > 0 THEN 1 END) / count(slope)")} AS sig_up, {q6("count(CASE WHEN abs(slope) > 0.5e0 AND slope < 0 THEN 1 END) / count(slope)")} AS sig_down,
        {q6("count(CASE WHEN abs(slope) <= 0.5e0 THEN 1 END) / count(slope)")} AS no_change FROM sl""",
    also=_SLOPES,
)
def a18(spark, d):
    sl = X.grid_obs(spark, d).groupBy(*CELL).agg(F.regr_slope("value", F.col("year").cast("double")).alias("slope"))
    out = A.trend_summary(sl.withColumn("reject", F.abs("slope") > 0.5))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "a19_ratio_of_totals",
    "grid_obs",
    f"""SELECT a.lat_idx, a.lon_idx, {q6("sa / nullif(sb, 0)")} AS ratio FROM (SELECT CAST(lat_idx // 5 AS INTEGER) AS lat_idx, CAST(lon_idx // 5 AS INTEGER) AS lon_idx, sum(CASE WHEN value >= 45 THEN value END) AS sa, sum(value) AS sb FROM grid_obs GROUP BY 1, 2) a WHERE sa IS NOT NULL""",
)
def a19(spark, d):
    o = X.grid_obs(spark, d).select(
        F.expr("CAST(lat_idx DIV 5 AS INT)").alias("lat_idx"), F.expr("CAST(lon_idx DIV 5 AS INT)").alias("lon_idx"), "value"
    )
    return A.ratio_of_totals(o.where("value >= 45"), o, "value").withColumn("ratio", r6("ratio"))


_COUNTS = """pf AS (SELECT site, observer, count(*) AS "TotDist", CAST(sum(is_fire) AS BIGINT) AS "TotFire", CAST(sum(site_impacted) AS BIGINT) AS "SiteDist", CAST(sum(is_fire * site_impacted) AS BIGINT) AS "SiteFire" FROM event_form GROUP BY ALL)"""
_CN = ("TotDist", "TotFire", "SiteDist", "SiteFire")


@query(
    "a20_observer_counts",
    "event_form",
    "SELECT site, count(*) AS n_forms, "
    + ", ".join(f"""{q6(f'avg("{c}")', 9)} AS "Mean{c}", min("{c}") AS "Min{c}", max("{c}") AS "Max{c}" """ for c in _CN)
    + "FROM pf GROUP BY site",
    also=_COUNTS,
)
def a20(spark, d):
    out = St.observer_counts(X.event_form(spark, d))
    return out.withColumns({f"Mean{c}": r6(f"Mean{c}", 9) for c in _CN})


@query(
    "a22_accuracy_table",
    "ref_events",
    f"""SELECT nation, sum(ev)::BIGINT AS n_events, {q6("avg(a / nullif(ev, 0) * 100)")} AS pct_CorrectDetection, {q6("avg(a / 7.0e0 * 100)")} AS annual_CorrectDetection, {q6("avg((7 - ev) / 7.0e0 * 100)")} AS annual_CorrectNonDetection
        FROM (SELECT site % 5 AS nation, site, count(CASE WHEN o_orderkey % 5 = 0 THEN 1 END) AS a, count(CASE WHEN o_orderkey % 5 < 5 THEN 1 END) AS ev FROM ref_events GROUP BY ALL) GROUP BY nation""",
)
def a22(spark, d):
    ev = X.ref_events(spark, d)
    kinds = St.EVENT_CLASSES[:-1]
    scores = ev.groupBy("site").agg(*[F.count_if(F.col("o_orderkey") % 5 == i).alias(k) for i, k in enumerate(kinds)])
    out = St.accuracy_table(scores.withColumn("nation", F.col("site") % 5), 7, ["nation"])
    cols = ("pct_CorrectDetection", "annual_CorrectDetection", "annual_CorrectNonDetection")
    return out.select("nation", "n_events", *[r6(c).alias(c) for c in cols])


@query(
    "a23_histogram",
    "grid_obs",
    f"""SELECT line, CAST(least(floor((value - 1) / (49.0e0 / 10)), 9) AS INTEGER) AS bin, {q6(f"sum({COSW})", 4)} AS weight, {q6(f"sum({COSW}) / sum(sum({COSW})) OVER (PARTITION BY line)")} AS share
        FROM grid_obs WHERE value BETWEEN 1 AND 50 GROUP BY 1, 2""",
)
def a23(spark, d):
    out = A.histogram(X.grid_obs(spark, d), "value", 10, 1.0, 50.0, ["line"], cos_weight(G.lat()))
    return out.select("line", "bin", r6("weight", 4).alias("weight"), r6("share").alias("share"))


@query(
    "a24_percentiles",
    sql=f"""SELECT l_returnflag AS flag, count(*) AS n, {q6("quantile_cont(l_extendedprice, 0.01)", 4)} AS q0, {q6("quantile_cont(l_extendedprice, 0.5)", 4)} AS q1, {q6("quantile_cont(l_extendedprice, 0.99)", 4)} AS q2 FROM lineitem GROUP BY 1""",
)
def a24(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = A.percentiles(li, "l_extendedprice", (0.01, 0.5, 0.99), ["flag"])
    return out.select("flag", "n", *[r6(f"q{i}", 4).alias(f"q{i}") for i in range(3)])


@query(
    "a25_block_significance",
    "grid_obs",
    f"""SELECT CAST(lat_idx // 4 AS INTEGER) AS by, CAST(lon_idx // 4 AS INTEGER) AS bx, count(CASE WHEN abs(slope) > 0.2e0 THEN 1 END)::DOUBLE AS n_sig, count(*) AS n_cells,
        {q6("median(40.0e0 + lat_idx * 1.5e0)")} AS lat, {q6("median(-10.0e0 + lon_idx * 5.0e0)")} AS lon FROM sl GROUP BY 1, 2
        HAVING count(CASE WHEN abs(slope) > 0.2e0 THEN 1 END) / count(slope) > 0.5e0 AND 1 - count(slope) / count(*) < 0.3e0""",
    also=_SLOPES,
)
def a25(spark, d):
    sl = X.grid_obs(spark, d).groupBy(*CELL).agg(F.regr_slope("value", F.col("year").cast("double")).alias("slope"))
    out = A.block_significance(sl.withColumn("sig", F.abs("slope") > 0.2), 4, "sig", G, 0.5, 0.3)
    return out.select("by", "bx", "n_sig", "n_cells", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query(
    "a25_block_hatch",
    "grid_obs",
    """SELECT CAST(lat_idx // 4 AS INTEGER) AS by, CAST(lon_idx // 4 AS INTEGER) AS bx, count(CASE WHEN abs(slope) > 0.2e0 THEN 1 END)::DOUBLE AS n_sig FROM sl GROUP BY 1, 2
       HAVING count(CASE WHEN abs(slope) > 0.2e0 THEN 1 END) / 16.0e0 >= 0.6e0""",
    also=_SLOPES,
)
def a25_hatch(spark, d):
    sl = X.grid_obs(spark, d).groupBy(*CELL).agg(F.regr_slope("value", F.col("year").cast("double")).alias("slope"))
    return A.block_significance(sl.withColumn("sig", F.abs("slope") > 0.2), 4, "sig", G, 0.6).select("by", "bx", "n_sig")


_SEED = """sd AS (SELECT l_suppkey AS site, l_quantity / 20.0e0 AS h, CASE l_returnflag WHEN 'R' THEN 'healthy' WHEN 'A' THEN 'weakened' ELSE 'dead' END AS vigor,
  CASE l_suppkey % 3 WHEN 0 THEN 40.0e0 WHEN 1 THEN 180.0e0 ELSE 706.5e0 END AS area FROM lineitem),
  dens AS (SELECT site, sum((CASE WHEN h <= 0.5e0 THEN 0.5e0 WHEN h > 0.5e0 AND h < 1.5e0 THEN 0.8e0 WHEN h > 1.5e0 THEN 1.0e0 ELSE 0 END) * (CASE vigor WHEN 'healthy' THEN 1.0e0 WHEN 'weakened' THEN 0.5e0 ELSE 0 END)) / max(area) * 10 AS density, count(*) AS n FROM sd GROUP BY site)"""


def _density(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        (F.col("l_quantity") / 20.0).alias("h"),
        F.when(F.col("l_returnflag") == "R", "heaithy").when(F.col("l_returnflag") == "A", "weakened").otherwise("dead").alias("vigor"),
        F.element_at(
            F.array(F.lit("seedlings per 2 x 2 m plot "), F.lit("seedlings per 2 m x 30 m"), F.lit(" seedlings per 15-m radius circle")),
            (F.col("l_suppkey") % 3 + 1).cast("int"),
        ).alias("fmt"),
    )
    return Fd.stocking_density(li, Fd.height_weight("h"), Fd.vigor_weight("vigor"), Fd.plot_area("fmt"))


@query("a26_stocking_density", "", f"SELECT site, {q6('density')} AS density, n FROM dens", also=_SEED)
def a26(spark, d):
    return _density(spark, d).withColumn("density", r6("density"))


_CLASSES = (*Fd.SHORT_CLASSES, *Fd.MEDIUM_CLASSES, *Fd.TALL_CLASSES, "dead")
_CLASS_W = " ".join(f"WHEN '{c}' THEN {w}e0" for cs, w in zip((Fd.SHORT_CLASSES, Fd.MEDIUM_CLASSES, Fd.TALL_CLASSES), Fd.HEIGHT_WEIGHTS, strict=True) for c in cs)


@query(
    "a26_categorical_density",
    "",
    f"""SELECT site, {q6("sum(w) / 10.0e0 * 10")} AS density, {q6("sum(CASE WHEN plot <= 30 AND c NOT IN ('1 yr sdlng', 'gte 0.1') THEN w ELSE 0 END) / 4.0e0 * 10")} AS density_near FROM cw GROUP BY site""",
    also=f"""cs AS (SELECT l_suppkey AS site, {list(_CLASSES)}[1 + l_orderkey % 8] AS c, l_quantity AS plot, CASE l_returnflag WHEN 'A' THEN 1.0e0 WHEN 'R' THEN 0.5e0 ELSE 0.0e0 END AS v FROM lineitem),
  cw AS (SELECT site, c, plot, v * (CASE c {_CLASS_W} ELSE 0.0e0 END) AS w FROM cs)""",
)
def a26_categorical(spark, d):
    li = X.table(spark, d, "lineitem")
    c = F.element_at(F.array(*[F.lit(x) for x in _CLASSES]), (F.col("l_orderkey") % 8 + 1).cast("int"))
    v = F.when(F.col("l_returnflag") == "A", "healthy").when(F.col("l_returnflag") == "R", "weakened").otherwise("dead")
    out = Fd.categorical_density(li.withColumn("site", F.col("l_suppkey")), c, v, F.col("l_quantity"))
    return out.select("site", r6("density").alias("density"), r6("density_near").alias("density_near"))


@query(
    "a27_fraction_of_threshold",
    "",
    f"""SELECT site, {q6("density / nullif(s_nationkey::DOUBLE, 0)")} AS fraction FROM dens LEFT JOIN supplier ON s_suppkey = site""",
    also=_SEED,
)
def a27(spark, d):
    limits = X.site(spark, d).select("site", F.col("nation").cast("double").alias("threshold"))
    return Fd.fraction_of_threshold(_density(spark, d), limits).select("site", r6("fraction").alias("fraction"))


@query(
    "a28_ensemble_mean",
    "grid_obs climate",
    f"""SELECT lat_idx, lon_idx, year, {q6("avg(v)", 9)} AS v FROM (SELECT lat_idx, lon_idx, year, max(value) AS v FROM grid_obs GROUP BY ALL UNION ALL SELECT lat_idx, lon_idx, year, max(tmean) AS v FROM climate GROUP BY ALL) GROUP BY ALL""",
)
def a28(spark, d):
    a = X.grid_obs(spark, d).groupBy(*CELL, "year").agg(F.max("value").alias("v"))
    b = X.climate(spark, d).groupBy(*CELL, "year").agg(F.max("tmean").alias("v"))
    return A.ensemble_mean([a, b], "v", [*CELL, "year"]).withColumn("v", r6("v", 9))


# fixed values: interval classes of the confusion matrix, in years
FRI_EDGES = (0, 15, 30, 60, 120, 500, 1000, 3000, 10000)


def _bin_sql(c: str) -> str:
    whens = " ".join(f"WHEN {c} > {a} AND {c} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(FRI_EDGES, FRI_EDGES[1:])))
    return f"CASE {whens} END"


@query(
    "a29_confusion_matrix",
    "",
    f"""SELECT CAST(o.i AS INTEGER) AS obs_bin, CAST(p.i AS INTEGER) AS pred_bin, coalesce(n, 0) AS n, {q6("coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY o.i), 0)")} AS share
        FROM range(8) o(i) CROSS JOIN range(8) p(i) LEFT JOIN (SELECT {_bin_sql("o_custkey * 4")} AS a, {_bin_sql("o_totalprice / 100.0e0")} AS b, count(*) AS n FROM orders GROUP BY 1, 2) c ON c.a = o.i AND c.b = p.i""",
)
def a29(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") * 4).alias("obs"), (F.col("o_totalprice") / 100.0).alias("pred"))
    return A.confusion_matrix(o, "obs", "pred", FRI_EDGES).withColumn("share", r6("share"))


@query(
    "a30_box_numbers",
    sql=f"""SELECT o_orderpriority AS g, count(*) AS n, min(o_totalprice) AS min, {q6("quantile_cont(o_totalprice, 0.25)", 4)} AS q25, {q6("quantile_cont(o_totalprice, 0.5)", 4)} AS median, {q6("quantile_cont(o_totalprice, 0.75)", 4)} AS q75, max(o_totalprice) AS max FROM orders GROUP BY 1""",
)
def a30(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice")
    out = A.box_numbers(o, "o_totalprice", ["g"])
    return out.select("g", "n", "min", r6("q25", 4).alias("q25"), r6("median", 4).alias("median"), r6("q75", 4).alias("q75"), "max")


@query(
    "a31_regional_burned_fraction",
    "grid_obs",
    f"""SELECT year, {q6("sum(b) / count(b)")} AS fraction FROM (SELECT lat_idx, lon_idx, year, sum(CASE WHEN burnt THEN 1.0e0 ELSE 0 END) AS b FROM grid_obs GROUP BY ALL) GROUP BY year""",
)
def a31(spark, d):
    return A.regional_burned_fraction(X.grid_obs(spark, d), "burnt").withColumn("fraction", r6("fraction"))


_BR = "avg(CASE WHEN band = {i} THEN value END)"


@query(
    "a32_scene_brightness",
    "scene_pixels",
    f"""SELECT scene, {", ".join(f'{q6(_BR.format(i=i))} AS "mean_{i}"' for i in (3, 2, 1))}, {q6(f"0.2125e0 * {_BR.format(i=3)} + 0.7154e0 * {_BR.format(i=2)} + 0.0721e0 * {_BR.format(i=1)}")} AS brightness, {q6("count(value) / count(*)")} AS good_share
        FROM (SELECT scene, band, CASE WHEN value >= -0.2e0 THEN value END AS value FROM scene_pixels) GROUP BY scene""",
)
def a32(spark, d):
    px = X.scene_pixels(spark, d).withColumn("value", F.when(F.col("value") >= -0.2, F.col("value")))
    out = Sc.scene_brightness(px, (3, 2, 1))
    return out.select("scene", *[r6(c).alias(c) for c in out.columns if c != "scene"])


@query(
    "a33_mean_annual_max",
    "climate",
    f"SELECT lat_idx, lon_idx, {q6('avg(m)', 9)} AS tmean FROM (SELECT lat_idx, lon_idx, year, max(tmean) AS m FROM climate WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL) GROUP BY ALL",
)
def a33(spark, d):
    return A.mean_annual_max(X.climate(spark, d), "tmean", 1996, 1999).withColumn("tmean", r6("tmean", 9))


@query(
    "a34_forest_rule",
    "grid_static",
    f"""SELECT {_BLK}, CASE WHEN coalesce(avg(treecover / 100.0e0) >= 0.45e0 AND avg(CASE WHEN land THEN 0.0e0 WHEN NOT land THEN 1.0e0 END) <= 0.2e0, false) THEN 1 ELSE 0 END AS forest FROM grid_static GROUP BY lat_idx // 3, lon_idx // 3""",
)
def a34(spark, d):
    s = X.grid_static(spark, d).select(
        *CELL, (F.col("treecover") / 100.0).alias("cover"), (~F.col("land")).cast("double").alias("nf")
    )
    return A.forest_rule(s, "cover", "nf", 3, 3, 0.45, 0.2).select(*CELL, i1("forest").alias("forest"))


_NOISY = """obsmean AS (SELECT lat_idx, lon_idx, CASE WHEN avg(value) > 24.5e0 THEN avg(value) END AS v FROM grid_obs GROUP BY ALL)"""


def _noisy(spark, d):
    m = F.avg("value")
    return X.grid_obs(spark, d).groupBy(*CELL).agg(F.when(m > 24.5, m).alias("v"))


def _w1(name: str, sf: int, need: int = 1):
    @query(
        name,
        "grid_obs",
        f"SELECT lat_idx, lon_idx, {q6('m2')} AS v_mean FROM mm",
        also=_NOISY + ",\n " + two_pass("obsmean", "v", sf, "mm", need=need),
    )
    def w1(spark, d):
        out = W.moving_mean(_noisy(spark, d), "v", sf, need)
        return out.select(*CELL, r6("v_mean").alias("v_mean"))


_w1("w1_moving_mean", 3)
_w1("w1_moving_mean_even", 4)
_w1("w1_moving_mean_wide", 15)
_w1("w3_moving_mean_min_count", 5, 3)


@query(
    "w2_window_size",
    "grid_obs",
    f"SELECT lat_idx, lon_idx, {q6('m2')} AS v_mean FROM mm",
    also=_NOISY + ",\n " + two_pass("obsmean", "v", 2, "mm"),
)
def w2(spark, d):
    """A window of three degrees is two cells of this grid."""
    out = W.moving_mean(_noisy(spark, d), "v", G.cells_per_degree(3.0))
    return out.select(*CELL, r6("v_mean").alias("v_mean"))


_COVERW = "CASE WHEN treecover >= 30 THEN 1.0e0 WHEN treecover < 30 THEN 0.0e0 END"


@query(
    "w4_weighted_fraction",
    "anbf grid_static",
    f"SELECT a.lat_idx, a.lon_idx, {q6('a.s / nullif(b.s, 0)')} AS fraction FROM sv a JOIN sw b USING (lat_idx, lon_idx)",
    also=f"""base AS (SELECT lat_idx, lon_idx, "AnBF" AS f, {_COVERW} AS w FROM anbf JOIN grid_static USING (lat_idx, lon_idx)),
  """
    + two_pass_sum("base", "f * w", 4, "sv")
    + ",\n "
    + two_pass_sum("base", "w", 4, "sw"),
)
def w4(spark, d):
    base = X.anbf(spark, d).join(X.grid_static(spark, d), list(CELL))
    base = base.withColumn("w", (F.col("treecover") >= 30).cast("double"))
    out = W.weighted_moving_fraction(base.select(*CELL, "AnBF", "w"), "AnBF", "w", 4)
    return out.select(*CELL, r6("fraction").alias("fraction"))


@query(
    "w5_moving_mean_2d",
    "grid_obs",
    f"""SELECT a.lat_idx, a.lon_idx, {q6("avg(b.v)")} AS v2 FROM obsmean a JOIN obsmean b ON b.lat_idx BETWEEN a.lat_idx - 2 AND a.lat_idx + 1 AND b.lon_idx BETWEEN a.lon_idx - 2 AND a.lon_idx + 1 GROUP BY ALL""",
    also=_NOISY,
)
def w5(spark, d):
    return W.moving_mean_2d(_noisy(spark, d), "v", 4, out="v2").select(*CELL, r6("v2").alias("v2"))


def _w6(name: str, sf: int):
    @query(
        name,
        "grid_obs",
        f"SELECT lat_idx, lon_idx, {q6('s')} AS s FROM ms",
        also=_NOISY + ",\n " + two_pass_sum("obsmean", "v", sf, "ms"),
    )
    def w6(spark, d):
        return W.moving_sum(_noisy(spark, d), "v", sf, out="s").select(*CELL, r6("s").alias("s"))


_w6("w6_moving_sum", 3)
_w6("w6_moving_sum_wide", 9)


@query(
    "w7_trailing_mean",
    "cell_year_value",
    f"""SELECT lat_idx, lon_idx, year, {q6("CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END", 9)} AS v FROM cell_year_value WINDOW w AS (PARTITION BY lat_idx, lon_idx ORDER BY year ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
)
def w7(spark, d):
    out = W.trailing_mean(X.cell_year_value(spark, d), "value", 4, 2, out="v")
    return out.select(*CELL, "year", r6("v", 9).alias("v"))


def _tg(n, s):
    return f"""SELECT lat_idx, lon_idx, {n} AS "window", {s} AS "start", CASE WHEN count(DISTINCT CASE WHEN year >= {s} AND w{n} IS NOT NULL THEN year END) > 1 THEN regr_slope(CASE WHEN year >= {s} THEN w{n} END, CASE WHEN year >= {s} AND w{n} IS NOT NULL THEN year END) END AS slope, count(CASE WHEN year >= {s} THEN w{n} END) AS n FROM tw GROUP BY ALL"""


@query(
    "w8_trend_grid",
    "cell_year_value",
    f"""SELECT lat_idx, lon_idx, "window", "start", {q6('slope')} AS slope, n FROM ({' UNION ALL '.join(_tg(n, s) for n in (2, 4) for s in (1995, 1997))})""",
    also="""tw AS (SELECT lat_idx, lon_idx, year, CASE WHEN count(value) OVER a >= 1 THEN avg(value) OVER a END AS w2, CASE WHEN count(value) OVER b >= 2 THEN avg(value) OVER b END AS w4 FROM cell_year_value
      WINDOW a AS (PARTITION BY lat_idx, lon_idx ORDER BY year ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), b AS (PARTITION BY lat_idx, lon_idx ORDER BY year ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
)
def w8(spark, d):
    out = W.trend_grid(X.cell_year_value(spark, d), "value", (2, 4), (1995, 1997))
    return out.withColumn("slope", r6("slope"))


@query(
    "w9_average_rank",
    "site_series",
    """SELECT site, step, rank() OVER (PARTITION BY site ORDER BY floor(value)) + (count(*) OVER (PARTITION BY site, floor(value)) - 1) / 2.0e0 AS r FROM site_series""",
)
def w9(spark, d):
    s = X.site_series(spark, d).withColumn("f", F.floor("value"))
    return s.select("site", "step", W.average_rank("f", ["site"]).alias("r"))


@query(
    "w9_whole_table_rank",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS r FROM lineitem""",
)
def w9_all(spark, d):
    from firegrid.operators.ordered import whole_table_rank

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = whole_table_rank(li, "l_quantity", "r", ["l_orderkey", "l_linenumber"])
    return out.drop("l_quantity")


@query("w10_time_index", "site_series", "SELECT site, step, CAST(row_number() OVER (PARTITION BY site ORDER BY step) - 1 AS INTEGER) AS k FROM site_series")
def w10(spark, d):
    return W.time_index(X.site_series(spark, d), ["site"], "step", "k").select("site", "step", "k")


@query(
    "w11_after_first",
    "site_series",
    """SELECT site, step, max(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY step ROWS UNBOUNDED PRECEDING) AS after FROM site_series""",
)
def w11(spark, d):
    s = X.site_series(spark, d).withColumn("hit", F.col("value") > 80)
    return W.after_first(s, "hit", ["site"], "step").select("site", "step", "after")


@query(
    "w12_first_after_event",
    "site_series",
    "SELECT site, min(step) AS step, arg_min(value, step) AS value FROM site_series WHERE value > 60 GROUP BY site",
)
def w12(spark, d):
    return W.first_after_event(X.site_series(spark, d), F.col("value") > 60, ["site"], "step", ["value"])


@query(
    "w14_cumulative_trapezoid",
    "site_series",
    f"""SELECT site, step, {q6("sum(a) OVER (PARTITION BY site ORDER BY step ROWS UNBOUNDED PRECEDING)")} AS integral FROM (
        SELECT site, step, coalesce((value + lag(value) OVER w) / 2 * (step - lag(step) OVER w), 0) AS a FROM site_series WINDOW w AS (PARTITION BY site ORDER BY step))""",
)
def w14(spark, d):
    out = W.cumulative_trapezoid(X.site_series(spark, d), "value", "step", ["site"])
    return out.select("site", "step", r6("integral").alias("integral"))


@query(
    "w15_site_box",
    "site",
    f"""SELECT site, {q6("40.0e0 + floor((lat - 40.0e0) / 1.5e0 + 0.5e0) * 1.5e0 - 3.75e0")} AS lat_min, {q6("40.0e0 + floor((lat - 40.0e0) / 1.5e0 + 0.5e0) * 1.5e0 + 3.75e0")} AS lat_max,
        {q6("-10.0e0 + floor((lon + 10.0e0) / 5.0e0 + 0.5e0) * 5.0e0 - 12.5e0")} AS lon_min, {q6("-10.0e0 + floor((lon + 10.0e0) / 5.0e0 + 0.5e0) * 5.0e0 + 12.5e0")} AS lon_max FROM site""",
)
def w15(spark, d):
    out = W.site_box(X.site(spark, d), G, 2)
    return out.select("site", *[r6(c).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


def _focal(src: str, col: str, out: str) -> str:
    return f"""{out} AS (SELECT a.scene, a.lat_idx, a.lon_idx, coalesce(any_value(a.{col}), avg(b.{col})) AS v FROM {src} a JOIN {src} b ON a.scene = b.scene
      AND b.lat_idx BETWEEN a.lat_idx - 1 AND a.lat_idx + 1 AND b.lon_idx BETWEEN a.lon_idx - 1 AND a.lon_idx + 1 GROUP BY ALL)"""


@query(
    "w16_focal_fill",
    "scene_pixels image_pixels",
    f"SELECT scene, lat_idx, lon_idx, {q6('v')} AS filled FROM it2",
    also=_focal("image_pixels", "value", "it1") + ",\n " + _focal("it1", "v", "it2"),
)
def w16(spark, d):
    out = W.focal_fill(X.image_pixels(spark, d), "value", 1, 2, part=["scene"])
    return out.select("scene", *CELL, r6("filled").alias("filled"))
