"""Order statistics, trends and tests against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.functions.ranks import inversions, median_slope
from firegrid.functions.stats import f_pvalue_df1_2, t_pvalue_from_r
from firegrid.operators import aggregate as A
from firegrid.operators import ordered as O
from firegrid.operators import trend as T


def adjusted(p, by=False):
    p = np.asarray(p)
    m = len(p)
    order = np.argsort(p)
    q = p[order] * m / np.arange(1, m + 1) * (sum(1 / i for i in range(1, m + 1)) if by else 1)
    q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    out = np.empty(m)
    out[order] = q
    return out


@pytest.mark.parametrize("method", ["fdr_bh", "fdr_by"])
def test_adjust_p_hot_values(spark, method):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(400) ** 3, np.full(300, 1.0), np.full(200, 0.004)])
    df = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(p)] + [(9999, 0, None)], "lat_idx int, lon_idx int, p double")
    got = O.adjust_p(df, "p", method).orderBy("lat_idx").collect()
    assert len(got) == len(p) + 1 and got[-1]["p_adj"] is None and got[-1]["reject"] is None
    np.testing.assert_allclose([r["p_adj"] for r in got[:-1]], adjusted(p, method == "fdr_by"), atol=1e-12)


def test_adjust_p_by_group_and_reject(spark):
    rng = np.random.default_rng(30)
    groups = {"a": rng.random(50) ** 4, "b": np.concatenate([rng.random(200), np.full(80, 0.5)])}
    rows = [(i, 0, g, float(v)) for g, p in groups.items() for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, g string, p double")
    for g, p in groups.items():
        got = O.adjust_p(df, "p", by=["g"]).where(F.col("g") == g).orderBy("lat_idx").collect()
        np.testing.assert_allclose([r["p_adj"] for r in got], adjusted(p), atol=1e-12)
        flags = [r["reject"] for r in O.reject_p(df.where(F.col("g") == g), "p").orderBy("lat_idx").collect()]
        assert flags == [r["reject"] for r in got]
    none = O.reject_p(df.where("g = 'b' AND p > 0.4"), "p").where("reject")
    assert none.count() == 0
    odd = spark.createDataFrame([(1, 0.001), (2, float("nan")), (3, None)], "i int, p double")
    assert [r["reject"] for r in O.reject_p(odd, "p").orderBy("i").collect()] == [True, None, None]


def test_adjust_p_small_with_tie(spark):
    p = [0.01, 0.02, 0.02, 0.03, 0.2, 0.5, 0.7, 0.8, 0.9, 1.0]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(p)], "lat_idx int, lon_idx int, p double")
    got = O.adjust_p(df, "p").orderBy("lat_idx").collect()
    np.testing.assert_allclose([r["p_adj"] for r in got], adjusted(p), atol=1e-12)
    assert [r["reject"] for r in got] == [v <= 0.1 for v in adjusted(p)]


def test_percentiles_one_hot_group(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 100, 5000), np.array([-3.5, 0.0, 0.0, 7.25])
    rows = [("hot", float(v)) for v in a] + [("b", float(v)) for v in b] + [(None, 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in O.exact_percentiles(df, "x", (0.01, 0.5, 0.99), ["g"]).collect()}
    for g, v in (("hot", a), ("b", b), (None, np.array([1.0]))):
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(3)], np.percentile(v, [1, 50, 99]), atol=1e-9)


def test_weighted_quantile_midpoint(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (4.0, 1.0), (9.0, 0.0)], "x double, w double")
    r = O.weighted_quantiles(df, "x", "w", (0.25, 0.5, 0.6, 1.0)).first()
    assert (r.q0, r.q1, r.q2, r.q3) == (1.5, 2.5, 3.0, 4.0)


def test_value_bucket_is_monotone(spark):
    vals = sorted([0.0, -1e300, -5.0, -1e-300, 1e-300, 1e-9, 0.99999, 1.0, 1.00001, 270.0, 270.5, 1e300])
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select("x", O.value_bucket("x").alias("b")).orderBy("x").collect()
    b = [r["b"] for r in rows]
    assert b == sorted(b)


def test_whole_table_rank(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, x double")
    got = [r["rank_avg"] for r in O.whole_table_rank(df, "x").orderBy("i").collect()]
    assert got == [4.0, 1.0, 4.0, 2.0, 4.0]


def series_df(spark, series):
    rows = [(k, i, float(v)) for k, ys in series.items() for i, v in enumerate(ys) if v is not None]
    return spark.createDataFrame(rows, "site int, step int, value double")


def test_theil_sen_and_spearman(spark):
    rng = np.random.default_rng(2)
    s = {1: [1, 2, 3, 4], 2: [1, 1, 2, 2, 2, 5], 3: list(rng.random(31)), 4: [7.0]}
    got = {r.site: r for r in T.theil_sen(series_df(spark, s), ["site"]).collect()}
    for k, y in s.items():
        y = np.array(y, float)
        sl = [(y[j] - y[i]) / (j - i) for i in range(len(y)) for j in range(i + 1, len(y))]
        if not sl:
            assert got[k].slope is None
            continue
        assert got[k].slope == pytest.approx(np.median(sl))
        assert got[k].intercept == pytest.approx(np.median(y) - np.median(sl) * np.median(np.arange(len(y))))
    rho = {r.site: r for r in T.spearman(series_df(spark, s), ["site"]).collect()}
    assert rho[1].rho == pytest.approx(1.0) and rho[1].pval == pytest.approx(0.0, abs=1e-12)
    assert rho[4].rho is None and rho[4].pval is None


def slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    return (y[j] - y[i]) / (x[j] - x[i])


@pytest.mark.parametrize("n", [2, 3, 6, 7, 25, 129, 130, 131, 400, 3000])
def test_median_slope_is_exact(n):
    rng = np.random.default_rng(n)
    steps = np.cumsum(rng.integers(1, 4, n)).astype(float)
    ties = rng.integers(0, 4, n) * 1.0
    ties[rng.random(n) < 0.8] = 2.0
    far = 1e9 + steps * 1e-3 + rng.normal(size=n)
    for x, y in ((np.arange(n) * 1.0, rng.normal(size=n)), (steps, ties), (steps, 3 * steps - 7), (steps, far), (steps, np.full(n, 5.0))):
        assert median_slope(x, y) == pytest.approx(np.median(slopes(x, y)), rel=1e-9, abs=1e-9)


def test_median_slope_of_a_very_long_series():
    rng = np.random.default_rng(1)
    x, y = np.arange(20_000.0), rng.normal(size=20_000).cumsum()
    got = median_slope(x, y)
    # as many pairs below as above, counted by their order along the slope
    below = inversions((y - got * x)[None, :])[0]
    assert abs(below - 20_000 * 19_999 / 4) <= 1


def test_inversions_with_weights():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 17, 64, 65):
        v, w = rng.integers(0, 6, (4, n)), rng.integers(0, 5, (4, n)) * 1.0
        i, j = np.triu_indices(n, 1)
        want = ((v[:, i] > v[:, j]) * w[:, i] * w[:, j]).sum(axis=1)
        assert (inversions(v, w) == want).all() and (inversions(v) == (v[:, i] > v[:, j]).sum(axis=1)).all()


def test_long_and_short_series_in_one_table(spark):
    rng = np.random.default_rng(12)
    s = {1: list(rng.normal(size=200)), 2: list(rng.normal(size=20)), 3: [float(v) for v in rng.integers(0, 2, 300)], 4: [2.0] * 9}
    slope = {r.site: r.slope for r in T.theil_sen(series_df(spark, s), ["site"]).collect()}
    tau = {r.site: r.tau for r in T.kendall_tau(series_df(spark, s), ["site"]).collect()}
    for k, y in s.items():
        x, y = np.arange(len(y)) * 1.0, np.array(y)
        assert slope[k] == pytest.approx(np.median(slopes(x, y)), abs=1e-12)
        assert tau[k] is None if k == 4 else tau[k] == pytest.approx(tau_b(x, y), abs=1e-12)


def t_tail(r, nu):
    t = abs(r) * math.sqrt(nu / (1 - r * r))
    xs = np.linspace(0, t, 400001)
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    return 1 - 2 * np.trapezoid(c * (1 + xs * xs / nu) ** (-(nu + 1) / 2), xs)


def test_t_pvalue(spark):
    cases = [(0.3, n) for n in (1, 2, 3, 4, 7, 20, 57)] + [(-0.8, 5), (0.0, 9)]
    df = spark.createDataFrame([*cases, (None, 5)], "r double, nu int").select("r", "nu", t_pvalue_from_r("r", "nu").alias("p"))
    for r in df.collect():
        if r["r"] is None:
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(t_tail(r["r"], r["nu"]), abs=1e-8)


def test_chow_finds_a_jump(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(0, 0.1, 15), rng.normal(3, 0.1, 15)])
    df = series_df(spark, {1: list(y)}).withColumn("brk", F.lit(14))

    def rss(x, v):
        a = np.vstack([np.ones(len(x)), x]).T
        return ((v - a @ np.linalg.lstsq(a, v, rcond=None)[0]) ** 2).sum()

    x = np.arange(30.0)
    split = rss(x[:15], y[:15]) + rss(x[14:], y[14:])
    # the break step lies in both halves: 15 + 16 - 4 degrees of freedom for F, 30 - 4 for p
    f = (rss(x, y) - split) / 2 / (split / 27)
    r = T.chow_test(df, ["site"], "brk").first()
    assert r["F"] == pytest.approx(f) and r["pval"] == pytest.approx((1 + 2 * f / 26) ** -13) and r["n_before"] == 15 and r["n_after"] == 16


def test_nested_anova(spark):
    rng = np.random.default_rng(8)
    x, dm = np.arange(20.0), (np.arange(20) > 11).astype(float)
    y = 0.3 * x + 2 * dm + rng.normal(size=20)
    df = series_df(spark, {1: list(y)}).withColumn("d", (F.col("step") > 11).cast("int"))
    fit = lambda a: ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
    r1, r2 = fit(np.vstack([np.ones(20), x]).T), fit(np.vstack([np.ones(20), x, dm]).T)
    r = T.nested_anova(df, ["site"], "d").first()
    assert r["F_gain"] == pytest.approx((r1 - r2) / (r2 / 17))
    tot = ((y - y.mean()) ** 2).sum()
    assert r["F_both"] == pytest.approx((tot - r2) / 2 / (r2 / 17))
    flat = T.nested_anova(df.withColumn("d", F.lit(0)), ["site"], "d").first()
    assert flat["F_gain"] is None and flat["F_trend"] == pytest.approx((tot - r1) / (r1 / 18))


def tau_b(x, y):
    s = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, tx, ty = s + a * b, tx + abs(a), ty + abs(b)
    return s / math.sqrt(tx * ty)


@pytest.mark.parametrize("strip", [50_000, 40, 7])
def test_whole_table_tau(spark, monkeypatch, strip):
    monkeypatch.setattr(T, "_STRIP_ROWS", strip)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(100, 5.0), rng.integers(0, 40, 200)]).astype(float)
    for y in (np.round(x * 0.2 + rng.normal(0, 4, 300)), np.where(rng.random(300) < 0.8, 1.0, rng.normal(size=300)), -x):
        df = spark.createDataFrame([*((float(a), float(b)) for a, b in zip(x, y)), (None, 1.0), (1.0, None)], "a double, b double")
        assert T.whole_table_tau(df, "a", "b").first()["tau"] == pytest.approx(tau_b(x, y), abs=1e-12)


def test_whole_table_tau_without_order(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert T.whole_table_tau(df, "a", "b").first()["tau"] is None
    assert T.whole_table_tau(df.where("a > 1"), "a", "b").first()["tau"] is None


def test_f_tail(spark):
    got = spark.range(1).select(f_pvalue_df1_2(F.lit(2.0), F.lit(10)).alias("p")).first()["p"]
    assert got == pytest.approx((1 + 0.4) ** -5)


def test_interval_shares_are_disjoint(spark):
    df = spark.createDataFrame([(v,) for v in (14.9, 15.0, 15.1, 30.0, 60.0, 120.0, 120.1, None)], "x double")
    r = A.interval_shares(df, "x", (15, 30, 60, 120), F.lit(1.0)).first()
    assert [r[f"sum_{k}"] for k in ("0_15", "15_30", "30_60", "60_120")] == [2, 2, 1, 1]
    assert sum(r[f"share_{k}"] for k in ("0_15", "15_30", "30_60", "60_120")) == pytest.approx(6 / 7)


def test_series_repeats_are_merged(spark):
    df = series_df(spark, {1: [1, 2, 3]}).union(series_df(spark, {1: [3, 2, 1]}))
    assert T.one_per_step(df, ["site"], "step", "value").count() == 3
