"""Sources and sinks, model steps and the streaming twin."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.grid import CELL
from firegrid.operators import model as L
from firegrid.operators.ordered import number_rows
from firegrid.operators.aggregate import annual_any, annual_burned_fraction
from firegrid.sources import products as S
from firegrid.sources import sinks as K
from firegrid.streaming.burn import burn_flag_stream, run_to_table


def test_lookup_with_mark_and_quotes(spark, tmp_path):
    f = tmp_path / "legend.csv"
    f.write_bytes('﻿VALUE,CLASSNAMES,GROUP\n1,"Forest, needleleaf",2\n20,Water ,0\n'.encode())
    rows = S.read_lookup(spark, str(f), "VALUE int, CLASSNAMES string, GROUP int").orderBy("VALUE").collect()
    assert [tuple(r) for r in rows] == [(1, "Forest, needleleaf", 2), (20, "Water", 0)]


def test_write_only_if_absent(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([(1, 1.0, "p")], "lat_idx int, v double, product string")
    K.write_result(a, path, ["product"])
    K.write_result(a.withColumn("v", F.lit(9.0)), path, ["product"])
    assert spark.read.parquet(path).first()["v"] == 1.0
    K.write_result(a.withColumn("v", F.lit(9.0)), path, ["product"], force=True)
    assert spark.read.parquet(path).first()["v"] == 9.0


def test_forced_write_leaves_other_parts(spark, tmp_path):
    path = str(tmp_path / "out")
    a = spark.createDataFrame([(1, "p"), (2, "q")], "v int, product string")
    K.write_result(a, path, ["product"])
    K.write_result(a.where("product = 'q'").withColumn("v", F.lit(7)), path, ["product"], force=True)
    assert {tuple(r) for r in spark.read.parquet(path).select("v", "product").collect()} == {(1, "p"), (7, "q")}


def test_resume_adds_only_missing_bands(spark, tmp_path):
    path = str(tmp_path / "bands")
    a = spark.range(40).select((F.col("id") % 4).cast("int").alias("lat_band"), "id")
    K.write_pending(a.where("lat_band = 1").withColumn("id", F.lit(-1).cast("long")), path)
    K.write_pending(a, path)
    got = spark.read.parquet(path)
    assert got.count() == 40 and got.where("lat_band = 1 AND id = -1").count() == 10


def test_shape_check(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)], "lat_idx int, lon_idx int, t int")
    df.write.parquet(a)
    df.where("lat_idx = 0").withColumn("t", F.lit(2)).write.parquet(b)
    with pytest.raises(ValueError):
        S.read_multi(spark, [a, b])
    assert S.read_multi(spark, [a, a]).count() == 8


def test_validity_of_empty(spark):
    assert not K.check_valid(spark.createDataFrame([(None,)], "v double"), "v")
    assert K.check_valid(spark.createDataFrame([(0.5,)], "v double"), "v")
    assert not K.check_valid(spark.createDataFrame([(1.5,)], "v double"), "v")


def cells(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.random(n), rng.random(n)
    rows = [(i // 20, i % 20, float(a), float(b), float(3 * a - b + 1)) for i, (a, b) in enumerate(zip(x, z))]
    return spark.createDataFrame(rows, "lat_idx int, lon_idx int, a double, b double, y double")


def test_linear_model_and_importance(spark):
    df = L.hash_split(cells(spark))
    share = df.where("is_train").count() / 400
    assert 0.7 < share < 0.9
    assert df.repartition(3).where("is_train").count() == df.where("is_train").count()
    m = L.fit_models(df.where("is_train"), ["a", "b"], "y", ["linear"])
    fit = m["linear"].stages[-1]
    np.testing.assert_allclose(fit.coefficients, [3, -1], atol=1e-6)
    test = df.where("NOT is_train")
    assert L.r2(m["linear"].transform(test), "y", "pred_linear").first()["r2"] == pytest.approx(1.0)
    imp = {r.feature: r.importance for r in L.permutation_importance(m["linear"], test, ["a", "b"], "y", "pred_linear", 3).collect()}
    assert imp["a"] > imp["b"] > 0


def test_boosted_trees_fit(spark):
    df = cells(spark)
    m = L.fit_models(df, ["a", "b"], "y", ["gbt"], trees=10, depth=4)
    assert L.r2(m["gbt"].transform(df), "y", "pred_gbt").first()["r2"] > 0.7


def test_boosted_forests_stop_and_beat_the_line(spark):
    rng = np.random.default_rng(5)
    rows = [(i, j, float(a), float(b), float(a * b)) for i in range(20) for j in range(30) for a, b in [rng.uniform(-1, 1, 2)]]
    df = spark.createDataFrame([*rows, (0, 99, None, 1.0, 1.0), (0, 98, 1.0, 1.0, None)], "lat_idx int, lon_idx int, a double, b double, y double").coalesce(2).cache()
    args = dict(trees=3, depth=5, rate=0.5, column_share=1.0)
    m = L.fit_boosted_forests(df, ["a", "b"], "y", rounds=6, **args)
    line = L.fit_models(df.where("y IS NOT NULL"), ["a", "b"], "y", ["linear"])["linear"]
    assert L.r2(m.transform(df), "y", "pred_forests").first()["r2"] > 0.8 > 0.2 > L.r2(line.transform(df), "y", "pred_linear").first()["r2"]
    assert m.errors[len(m.forests) - 1] == min(m.errors)
    again = L.fit_boosted_forests(df, ["a", "b"], "y", rounds=2, **args)
    assert again.errors == pytest.approx(m.errors[:2], rel=1e-9)
    # noise: the first rounds are the best, and the search ends two rounds after
    noise = df.withColumn("y", F.pmod(F.xxhash64("a", "b"), F.lit(1000)) / 1000.0)
    stopped = L.fit_boosted_forests(noise, ["a", "b"], "y", rounds=30, patience=2, **args)
    assert len(stopped.errors) == len(stopped.forests) + 2 < 30
    with pytest.raises(ValueError):
        L.fit_boosted_forests(df.limit(0), ["a", "b"], "y", rounds=1)


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_every_run_is_a_permutation(spark, n):
    rows = spark.range(n).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("run"))
    got = rows.select("r", "run", L.moved_place(F.col("r"), F.lit(n).cast("long"), F.col("run").cast("long")).alias("p")).toPandas()
    assert all(sorted(g.p) == list(range(n)) for _, g in got.groupby("run"))
    if n == 7:  # every row reaches every place
        assert len(set(zip(got.r, got.p, strict=True))) >= 45
    if n == 300:
        # distances moved and correlations of runs are those of random orders
        assert got.groupby("run").apply(lambda g: (g.r - g.p).abs().mean(), include_groups=False).mean() == pytest.approx(100, abs=5)
        wide = got.pivot(index="r", columns="run", values="p").corr().to_numpy()
        assert abs(wide[~np.eye(20, dtype=bool)]).max() < 0.25


def test_permuted_rows_move_one_feature(spark):
    df = cells(spark)
    s = L.permuted_rows(df, ["a", "b"], 2)
    old = sorted(r.a for r in df.collect())
    for rep in (0, 1):
        part = s.where((F.col("feature") == "a") & (F.col("rep") == rep))
        assert sorted(r.a for r in part.collect()) == old
        moved = part.join(df.select(*CELL, F.col("a").alias("a0"), F.col("b").alias("b0")), list(CELL))
        assert moved.where("a <> a0").count() > 200 and moved.where("b <> b0").isEmpty()
    assert L.permuted_rows(df.limit(0), ["a"], 2).isEmpty()


def test_quantiles_of_all_columns_at_once(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(4000, 3)), 2)
    df = spark.createDataFrame([(float(a), float(b), float(c), None) for a, b, c in x], "a double, b double, c double, none double")
    t = L.QuantileUniform.fit(df, ["a", "b", "c", "none"], 1000)
    got = t.transform(df.withColumns({"x": F.col("a"), "y": F.col("b")})).toPandas()
    for col, own, i in (("a", "x", 0), ("b", "y", 1)):
        knots = np.percentile(x[:, i], np.linspace(0, 100, 1000))
        ranks = np.linspace(0, 1, 1000)
        want = (np.interp(got[own], knots, ranks) - np.interp(-got[own], -knots[::-1], -ranks[::-1])) / 2
        assert np.allclose(got[col], want, atol=1e-3)
    assert got["none"].isna().all()


def test_rows_are_numbered_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = number_rows(df, ["k"]).toPandas().sort_values("k")
    assert list(got["row"]) == list(range(5000)) and set(got["n_rows"]) == {5000}


def test_quantile_transform(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 0, 0, 1, 2, 3, 4, 5, 10]], "x double")
    t = L.QuantileUniform.fit(df, ["x"], 11)
    got = {r.x0: r.x for r in t.transform(df.withColumn("x0", F.col("x"))).collect()}
    assert got[0.0] == 0.0 and got[10.0] == 1.0 and all(0 <= v <= 1 for v in got.values())
    assert sorted(got.values()) == [got[k] for k in sorted(got)]
    out = t.transform(spark.createDataFrame([(-5.0,), (99.0,), (None,)], "x double")).collect()
    assert [r.x for r in out] == [0.0, 1.0, None]


def test_predict_floors_and_keeps_gaps(spark):
    df = cells(spark)
    m = L.fit_models(df, ["a", "b"], "y", ["linear"])
    new = spark.createDataFrame([(0, 0, -5.0, 0.0), (0, 1, None, 0.0)], "lat_idx int, lon_idx int, a double, b double")
    got = {r.lon_idx: r.pred_linear for r in L.predict(m, new, 0.01).collect()}
    assert got == {0: 0.01, 1: None}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i % 2, f"20{10 + i % 4}-07-0{1 + i % 9}", i % 7 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, d string, burnt boolean").select(
        *CELL, F.col("d").cast("timestamp").alias("t"), "burnt"
    )
    src = str(tmp_path / "in")
    df.repartition(5).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_to_table(burn_flag_stream(stream, "4000 days"), str(tmp_path / "out"))
    want = annual_any(df.withColumn("year", F.year("t")), "burnt")
    a = {(r.lat_idx, r.lon_idx, r.year): r.burnt for r in got.collect()}
    b = {(r.lat_idx, r.lon_idx, r.year): int(r.burnt) for r in want.collect()}
    assert a == b


def test_shared_folder_comes_from_the_session(spark):
    from types import SimpleNamespace as NS

    from firegrid import session

    named = NS(conf=NS(get=lambda key, default=None: "/shared/ckpt/"), sparkContext=NS(master="yarn"))
    assert session.shared_folder(named) == "/shared/ckpt"
    assert session.scratch(named, "x").startswith("/shared/ckpt/x-")
    with pytest.raises(RuntimeError):
        session.shared_folder(NS(conf=NS(get=lambda key, default=None: None), sparkContext=NS(master="yarn")))
    assert session.shuffle_partitions(100 * 1024**4) == 409_600


@pytest.mark.parametrize("n_years", [10, 70])
def test_burned_fraction_counts_years_once(spark, n_years):
    rows = [(0, 0, 1995, True), (0, 0, 1995, True), (0, 0, 2003, True), (0, 0, 2001, False), (0, 1, 2000, True), (1, 0, 2000, None)]
    df = spark.createDataFrame(rows, "lat_idx int, lon_idx int, year int, burnt boolean")
    got = {(r.lat_idx, r.lon_idx): r.AnBF for r in annual_burned_fraction(df, n_years).collect()}
    assert got == {(0, 0): pytest.approx(2 / n_years), (0, 1): pytest.approx(1 / n_years)}
