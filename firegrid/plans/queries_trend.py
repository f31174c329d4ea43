"""Queries: trends, tests and regressions (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions.stats import t_pvalue_from_r
from firegrid.grid import CELL
from firegrid.operators import trend as T
from firegrid.plans import fixtures as X
from firegrid.plans.fixtures import table
from firegrid.plans.registry import i1, p_sql, q6, query, r6

SITE = ["site"]


@query(
    "t1_theil_sen",
    "site_series",
    f"""SELECT s.site, s.n, {q6("m.slope")} AS slope, {q6("s.my - m.slope * s.mx")} AS intercept
        FROM (SELECT site, count(*) AS n, median(value) AS my, median(step) AS mx FROM site_series GROUP BY site) s
        LEFT JOIN (SELECT a.site, median((b.value - a.value) / (b.step - a.step)) AS slope FROM site_series a JOIN site_series b ON a.site = b.site AND b.step > a.step GROUP BY a.site) m USING (site)""",
)
def t1(spark, d):
    out = T.theil_sen(X.site_series(spark, d), SITE)
    return out.select("site", F.col("n").cast("long").alias("n"), r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(
    "t1_theil_sen_cells",
    "cell_year_value",
    f"""SELECT a.lat_idx, a.lon_idx, {q6("median((b.value - a.value) / (b.year - a.year))")} AS slope FROM cell_year_value a JOIN cell_year_value b ON a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx AND b.year > a.year
        WHERE (a.lat_idx, a.lon_idx) IN (SELECT (lat_idx, lon_idx) FROM cell_year_value GROUP BY lat_idx, lon_idx HAVING count(*) = 7) GROUP BY ALL""",
)
def t1_cells(spark, d):
    out = T.theil_sen(X.cell_year_value(spark, d), CELL, "year", "value", complete=7)
    return out.select(*CELL, r6("slope").alias("slope"))


_RANK = """rk AS (SELECT site, step, rank() OVER (PARTITION BY site ORDER BY floor(value)) + (count(*) OVER (PARTITION BY site, floor(value)) - 1) / 2.0e0 AS ry, rank() OVER (PARTITION BY site ORDER BY step) AS rx FROM site_series),
  rho AS (SELECT site, count(*) AS n, CASE WHEN min(ry) < max(ry) AND min(rx) < max(rx) THEN corr(rx, ry) END AS rho FROM rk GROUP BY site)"""


@query(
    "t2_spearman",
    "site_series",
    f"SELECT site, n, {q6('rho')} AS rho, {q6(p_sql('rho', '(n - 2)'))} AS pval FROM rho",
    also=_RANK,
)
def t2(spark, d):
    s = X.site_series(spark, d).withColumn("value", F.floor("value").cast("double"))
    out = T.spearman(s, SITE)
    return out.select("site", "n", r6("rho").alias("rho"), r6("pval").alias("pval"))


_OLS = """fit AS (SELECT site, count(*) AS n, regr_slope(value, step) AS slope, regr_intercept(value, step) AS intercept, corr(step, value) AS r FROM site_series GROUP BY site)"""


@query(
    "t3_ols",
    "site_series",
    f"SELECT site, n, {q6('slope')} AS slope, {q6('intercept')} AS intercept, {q6('r * r')} AS r2, {q6(p_sql('r', '(n - 2)'))} AS pval FROM fit",
    also=_OLS,
)
def t3(spark, d):
    out = T.ols(X.site_series(spark, d), SITE)
    return out.select("site", "n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2", "pval")])


@query(
    "t4_polyfit_slope",
    "climate",
    f"SELECT lat_idx, lon_idx, {q6('CASE WHEN abs(regr_slope(coalesce(v, 0), year)) > max(abs(coalesce(v, 0))) * 1e-12 THEN regr_slope(coalesce(v, 0), year) END')} AS slope FROM (SELECT lat_idx, lon_idx, year, max(CASE WHEN tmean > 0 THEN tmean END) AS v FROM climate GROUP BY ALL) GROUP BY lat_idx, lon_idx",
)
def t4(spark, d):
    c = X.climate(spark, d).groupBy(*CELL, "year").agg(F.max(F.when(F.col("tmean") > 0, F.col("tmean"))).alias("value"))
    return T.polyfit_slope(c).withColumn("slope", r6("slope"))


_TAU = """pr AS (SELECT a.site, sign(b.step - a.step) AS sx, sign(floor(b.value) - floor(a.value)) AS sy FROM site_series a JOIN site_series b ON a.site = b.site AND b.step > a.step)"""


@query(
    "t5_kendall_tau",
    "site_series",
    f"SELECT site, {q6('sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0)')} AS tau FROM pr GROUP BY site",
    also=_TAU,
)
def t5(spark, d):
    s = X.site_series(spark, d).withColumn("value", F.floor("value"))
    return T.kendall_tau(s, SITE).where("n > 1").select("site", r6("tau").alias("tau"))


def _fdr(name: str, method: str, factor: str):
    @query(
        name,
        "cell_year_value",
        f"""SELECT lat_idx, lon_idx, {q6("p_adj")} AS p_adj, CASE WHEN p_adj <= 0.1e0 THEN 1.0e0 WHEN p_adj > 0.1e0 THEN 0.0e0 END AS reject FROM adj""",
        also=f"""fit AS (SELECT lat_idx, lon_idx, count(*) AS n, CASE WHEN min(year) < max(year) AND min(value) < max(value) THEN corr(year, value) END AS r FROM cell_year_value GROUP BY ALL),
  pv AS (SELECT lat_idx, lon_idx, round({p_sql("r", "(n - 2)")}, 3) AS p FROM fit),
  m AS (SELECT count(p) AS m FROM pv), h AS (SELECT sum(1.0e0 / i) AS h FROM range(1, (SELECT m + 1 FROM m)) r(i)),
  up AS (SELECT p, max(rn) AS rk FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM pv WHERE p IS NOT NULL) GROUP BY p),
  adj AS (SELECT pv.lat_idx, pv.lon_idx, CASE WHEN a.q IS NOT NULL THEN least(1.0e0, a.q) END AS p_adj FROM pv LEFT JOIN
    (SELECT p, min(p * m / rk * {factor}) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS q FROM up, m, h) a ON a.p = pv.p)""",
    )
    def t6(spark, d):
        fit = T.ols(X.cell_year_value(spark, d), CELL, "year", "value")
        # three digits make ties, which share one adjusted value
        out = T.adjust_p(fit.withColumn("p", F.round("pval", 3)), "p", method)
        return out.select(*CELL, r6("p_adj").alias("p_adj"), i1("reject").cast("double").alias("reject"))


_fdr("t6_fdr_bh", "fdr_bh", "1")
_fdr("t6_fdr_by", "fdr_by", "h")

_RSS = "(regr_syy({y}, {x}) - coalesce(pow(regr_sxy({y}, {x}), 2) / nullif(regr_sxx({y}, {x}), 0), 0))"


def _part(cond):
    return _RSS.format(y=f"CASE WHEN {cond} THEN value END", x=f"CASE WHEN {cond} THEN step END")


_CHOW = f"""rss AS (SELECT site, count(*) AS n, {_RSS.format(y="value", x="step")} AS total, {_part("step <= 10 + site % 10")} + {_part("step >= 10 + site % 10")} AS split FROM site_series GROUP BY site),
  ff AS (SELECT rss.site, n, CASE WHEN n > 4 AND split > 0 THEN greatest((total - split) / 2 / (split / (n + at_break - 4)), 0) END AS f FROM rss
    JOIN (SELECT site, count(CASE WHEN step = 10 + site % 10 THEN value END) AS at_break FROM site_series GROUP BY site) USING (site))"""


@query(
    "t7_chow_test",
    "site_series",
    f"""SELECT site, n, {q6("f")} AS "F", {q6("pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0e0)")} AS pval FROM ff""",
    also=_CHOW,
)
def t7(spark, d):
    s = X.site_series(spark, d).withColumn("brk", F.col("site") % 10 + 10)
    out = T.chow_test(s, SITE, "brk")
    return out.select("site", "n", r6("F").alias("F"), r6("pval").alias("pval"))


_ANOVA = """a0 AS (SELECT site, CAST(step AS DOUBLE) AS x, value AS y, CASE WHEN step > 10 + site % 10 THEN 1.0e0 ELSE 0.0e0 END AS dm FROM site_series),
  a1 AS (SELECT site, count(*) AS n, regr_syy(y, x) AS yy, regr_sxx(y, x) AS xx, regr_sxy(y, x) AS xy, regr_sxx(y, dm) AS dd, regr_sxy(y, dm) AS dy, regr_sxy(x, dm) AS xd FROM a0 GROUP BY site),
  a2 AS (SELECT *, xy * xy / nullif(xx, 0) AS e1, CASE WHEN xx * dd - xd * xd > xx * dd * 1e-12 THEN (xy * xy * dd - 2 * xy * dy * xd + dy * dy * xx) / (xx * dd - xd * xd) END AS e2 FROM a1 WHERE n > 3),
  a3 AS (SELECT site, n, e1 / ((yy - e1) / (n - 2)) AS f1, e2 / 2 / ((yy - e2) / (n - 3)) AS f2, (e2 - e1) / ((yy - e2) / (n - 3)) AS fa FROM a2)"""


@query(
    "t8_nested_anova",
    "site_series",
    f"""SELECT site, n, {q6("f1")} AS "F_trend", {q6(p_sql("sqrt(f1 / (f1 + n - 2))", "(n - 2)"))} AS p_trend, {q6("f2")} AS "F_both", {q6("pow(1 + 2 * f2 / (n - 3), -(n - 3) / 2.0e0)")} AS p_both,
        {q6("fa")} AS "F_gain", {q6(p_sql("sqrt(fa / (fa + n - 3))", "(n - 3)"))} AS p_gain FROM a3""",
    also=_ANOVA,
)
def t8(spark, d):
    s = X.site_series(spark, d).withColumn("after", (F.col("step") > F.col("site") % 10 + 10).cast("int"))
    out = T.nested_anova(s, SITE, "after")
    return out.select("site", "n", *[r6(c).alias(c) for c in ("F_trend", "p_trend", "F_both", "p_both", "F_gain", "p_gain")])


@query(
    "t9_t_pvalue",
    "",
    f"SELECT o_orderkey, {q6(p_sql('r', 'nu'))} AS p FROM tp",
    also="tp AS (SELECT o_orderkey, CAST(o_custkey % 1000 AS DOUBLE) / 1000.0e0 AS r, 1 + o_orderkey % 58 AS nu FROM orders)",
)
def t9(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", ((F.col("o_custkey") % 1000).cast("double") / 1000.0).alias("r"), (F.col("o_orderkey") % 58 + 1).alias("nu")
    )
    return o.select("o_orderkey", r6(t_pvalue_from_r("r", "nu")).alias("p"))


@query("t10_ols_formula")
def t10(spark, d):
    from firegrid.operators.aggregate import annual_burned_fraction

    o = X.grid_obs(spark, d)
    burn = annual_burned_fraction(o.withColumn("hit", F.col("value") >= 50), len(X.YEARS), "hit")
    clim = X.climate(spark, d).groupBy(*CELL).agg(F.avg("tmean").alias("temperature"), F.avg("ppt").alias("precipitation"))
    rows = burn.join(clim, list(CELL)).withColumn("FRI", 1 / F.col("AnBF"))
    _, coefs = T.ols_formula(rows, "FRI ~ temperature + precipitation + temperature:precipitation")
    return coefs


@query(
    "t11_post_event_trend",
    "site_series",
    f"""SELECT site, count(*) AS n, {q6("regr_slope(value, step)")} AS slope FROM site_series WHERE step BETWEEN site % 12 + 1 AND 28 AND site % 12 + 1 <= 10 GROUP BY site""",
)
def t11(spark, d):
    s = X.site_series(spark, d)
    ev = s.select("site", (F.col("site") % 12 + 1).alias("year")).distinct()
    out = T.post_event_trend(s, ev, 28, T.ols, latest_event=10, x="step")
    return out.select("site", "n", r6("slope").alias("slope"))


_PAIRS = """st AS (SELECT s_suppkey AS id, s_nationkey AS a, floor(s_acctbal / 100) AS b FROM supplier),
  kp AS (SELECT sum(sign(p.a - q.a) * sign(p.b - q.b)) AS s, sum(abs(sign(p.a - q.a))) AS ta, sum(abs(sign(p.b - q.b))) AS tb FROM st p JOIN st q ON p.id > q.id)"""


@query(
    "t12_site_correlation",
    "",
    f"""SELECT (SELECT count(*) FROM st) AS n, {q6("(SELECT pow(corr(a, b), 2) FROM st)")} AS r2, {q6("s / sqrt(ta * tb)")} AS tau FROM kp""",
    also=_PAIRS,
)
def t12(spark, d):
    s = X.site(spark, d).select("nation", F.floor(F.col("acctbal") / 100).cast("double").alias("bal"))
    out = T.site_correlation(s, "nation", "bal")
    return out.select("n", r6("r2").alias("r2"), r6("tau").alias("tau"))


@query(
    "t13_zero_insignificant",
    "site_series",
    f"SELECT site, {q6('CASE WHEN ' + p_sql('r', '(n - 2)') + ' < 0.2e0 THEN slope ELSE 0 END')} AS slope FROM fit",
    also=_OLS,
)
def t13(spark, d):
    out = T.ols(X.site_series(spark, d), SITE).withColumn("reject", F.col("pval") < 0.2)
    return T.zero_insignificant(out).select("site", r6("slope").alias("slope"))


@query(
    "udf_apply_series",
    "site_series",
    f"SELECT site, count(*) AS n, {q6('sum(abs(d))')} AS path FROM (SELECT site, value - lag(value) OVER (PARTITION BY site ORDER BY step) AS d FROM site_series) GROUP BY site",
)
def udf_apply_series(spark, d):
    def path(pdf):
        import pandas as pd

        return pd.DataFrame(
            {"site": [pdf["site"].iloc[0]], "n": [len(pdf)], "path": [float(pdf["value"].diff().abs().sum(min_count=1))]}
        )

    out = T.apply_series(X.site_series(spark, d), ["site"], "step", path, "site long, n long, path double")
    return out.withColumn("path", r6(F.when(~F.isnan("path"), F.col("path"))))


@query(
    "t6_fdr_reject",
    "cell_year_value",
    """SELECT lat_idx, lon_idx, CASE WHEN p IS NULL THEN NULL WHEN p <= coalesce((SELECT max(p) FROM up, m WHERE p * m / rk <= 0.5e0), -1) THEN 1.0e0 ELSE 0.0e0 END AS reject FROM pv""",
    also=f"""fit AS (SELECT lat_idx, lon_idx, count(*) AS n, CASE WHEN min(year) < max(year) AND min(value) < max(value) THEN corr(year, value) END AS r FROM cell_year_value GROUP BY ALL),
  pv AS (SELECT lat_idx, lon_idx, round({p_sql("r", "(n - 2)")}, 3) AS p FROM fit), m AS (SELECT count(p) AS m FROM pv),
  up AS (SELECT p, max(rn) AS rk FROM (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM pv WHERE p IS NOT NULL) GROUP BY p)""",
)
def t6_reject(spark, d):
    from firegrid.operators.ordered import reject_p

    fit = T.ols(X.cell_year_value(spark, d), CELL, "year", "value")
    out = reject_p(fit.withColumn("p", F.round("pval", 3)), "p", alpha=0.5)
    return out.select(*CELL, F.col("reject").cast("double").alias("reject"))
