"""Rows that must not get lost or doubled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.grid import CELL, EARTH_RADIUS_KM, GridSpec
from firegrid.operators import aggregate as A
from firegrid.operators import joins as J
from firegrid.operators import model as L
from firegrid.operators import ordered as O
from firegrid.operators import points as P
from firegrid.operators import scenes as Sc
from firegrid.operators import sites as St
from firegrid.sources import products, sinks


def test_second_product_is_added_and_the_first_stays(spark, tmp_path):
    path = str(tmp_path / "maps")
    rows = lambda p, n, v: spark.createDataFrame([(i, v, p) for i in range(n)], "id long, v double, product string")
    sinks.write_result(rows("a", 3, 1.0), path, ["product"])
    sinks.write_result(rows("b", 2, 2.0).unionByName(rows("a", 9, 9.0)), path, ["product"])
    got = {r["product"]: (r["count"], r["v"]) for r in spark.read.parquet(path).groupBy("product").agg(F.count("*").alias("count"), F.max("v").alias("v")).collect()}
    assert got == {"a": (3, 1.0), "b": (2, 2.0)}
    sinks.write_result(rows("b", 1, 5.0), path, ["product"], force=True)
    assert spark.read.parquet(path).count() == 4


def test_rank_of_large_longs(spark):
    big = 2**53
    rows = [(i, big + i % 4) for i in range(3000)] + [(3000, None), (3001, 5), (3002, -5)]
    got = {r.i: r.rank_avg for r in O.whole_table_rank(spark.createDataFrame(rows, "i long, v long"), "v").collect()}
    assert len(got) == len(rows) and got[3000] is None and got[3002] == 1.0
    assert got[0] == 2 + 375.5 and got[1] == 2 + 750 + 375.5


def test_sites_without_years_are_correct_non_detections(spark):
    y = lambda rows: spark.createDataFrame(rows, "site long, year int")
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site long")
    got = {r.site: r.asDict() for r in St.score_events(y([(1, 2003), (3, 1900)]), y([(1, 2003)]), y([(1, 2003)]), 2000, 2010, sites=sites).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["CorrectDetection"] == 1 and got[2]["CorrectNonDetection"] == 1 and got[3]["CorrectNonDetection"] == 1
    assert all(g["TotalEvents"] == 1 for g in got.values())


def test_empty_forms_count(spark):
    schema = "site long, observer int, Frame01 int, Date01 date, IsFire01 int, SiteImpacted01 int, StandRep01 int"
    forms = spark.createDataFrame([(1, 0, 10, None, 1, 1, 1), (1, 1, None, None, None, None, None), (2, 0, None, None, None, None, None)], schema)
    got = {r.site: r for r in St.disturbance_series(forms, n_events=1).collect()}
    assert got[1].agree == 0.5 and got[1].site_loss == 1
    assert got[2].frame is None and got[2].post_loss == 0


def test_edge_cells_serve_targets_beyond_them(spark):
    g, out = GridSpec(40.0, 0.0, 1.0, 1.0, 2, 2), GridSpec(38.0, -1.0, 1.0, 1.0, 6, 4)
    df = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(2) for j in range(2)], "lat_idx int, lon_idx int, v double")
    got = {(r.lat_idx, r.lon_idx): r.v for r in J.reindex_nearest(df, g, out).collect()}
    assert len(got) == 24 and got[0, 0] == 0.0 and got[5, 3] == 11.0 and got[0, 3] == 1.0
    near = J.reindex_nearest(df, g, out, tolerance=0.5)
    assert near.count() == 4
    points = spark.createDataFrame([(1, 90.0, 0.2), (2, None, 0.0)], "p int, lat double, lon double")
    assert [(r.p, r.v) for r in J.lookup_points(df, points, g).collect()] == [(1, 10.0)]


def test_cells_across_the_date_line(spark):
    g = GridSpec(-89.5, -179.5, 1.0, 1.0, 180, 360)
    points = [(0.5, 179.9), (60.0, -179.99), (89.9, 10.0), (-10.0, 0.0)]
    got = {(r.lat_idx, r.lon_idx) for r in J.cells_near_points(spark.createDataFrame(points, "lat double, lon double"), g, 100.0).collect()}
    lat, lon = np.radians(-89.5 + np.arange(180))[:, None], np.radians(-179.5 + np.arange(360))[None, :]
    want = set()
    for a, b in np.radians(points):
        h = np.sin((lat - a) / 2) ** 2 + np.cos(lat) * np.cos(a) * np.sin((lon - b) / 2) ** 2
        want |= {(int(i), int(j)) for i, j in np.argwhere(2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(h)) <= 100.0)}
    assert got == want


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (None, 3.0, 1.0), ("a", 5.0, 2.0)], "run string, x double, w double")
    got = {r.run: (r["mean"], r["std"]) for r in A.weighted_mean_std(df, "x", "w", ["run"]).collect()}
    assert got == {None: (2.0, 1.0), "a": (5.0, 0.0)}
    assert {r.run for r in L.prediction_stats(df, ["run"], "x", F.col("w"), (2.0, 4.0)).collect()} == {None, "a"}


def test_burned_years_far_apart(spark):
    df = spark.createDataFrame([(0, 0, 1950, True), (0, 0, 2014, True), (0, 0, 2014, True)], "lat_idx int, lon_idx int, year int, burnt boolean")
    assert A.annual_burned_fraction(df, 64).first()["AnBF"] == 2 / 64


@pytest.mark.parametrize("keys", [range(-2000, 2000), [i * 1_000_003 for i in range(4000)], [i * 2_147_483_629 for i in range(4000)], [-(2**62) + i for i in range(4000)]])
def test_key_hash_is_even(spark, keys):
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    n = {r["b"]: r["count"] for r in df.select(L.hash_bucket(["k"]).alias("b")).groupBy("b").count().collect()}
    assert set(n) <= set(range(100)) and len(n) > 95 and max(n.values()) < 100


def test_missing_winter_pixel_is_zero(spark):
    df = spark.createDataFrame([("2015-01-10", None), ("2015-01-10", -0.1), ("2015-07-10", None), ("2015-01-10", -0.5)], "d string, value double").select(F.to_date("d").alias("ts"), "value", F.lit("LANDSAT_7").alias("satellite"))
    assert [r.value for r in Sc.winter_floor(df).collect()] == [0.0, 0.0, None, None]
    assert CELL == ("lat_idx", "lon_idx")


def test_nearest_site_without_coordinates(spark):
    nan = float("nan")
    left = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, nan, 1.0)], "id int, lat double, lon double")
    right = spark.createDataFrame([(7, None, 1.0), (8, nan, 1.0), (9, 89.0, 359.0)], "rid int, lat double, lon double")
    assert {r.id: r.near_rid for r in P.nearest_site(left, right, "rid").collect()} == {1: 9, 2: None, 3: None}
    assert {r.near_rid for r in P.nearest_site(left, right.where("rid < 9"), "rid").collect()} == {None}


def test_percentiles_with_nan_and_infinity(spark):
    v = [float(i) for i in range(1, 10)]
    df = lambda more: spark.createDataFrame([(x,) for x in v + more], "v double")
    r = O.exact_percentiles(df([float("nan"), None]), "v", [0.0, 0.5, 1.0]).first()
    assert (r.n, r.q0, r.q1, r.q2) == (9, 1.0, 5.0, 9.0)
    r = O.exact_percentiles(df([float("inf"), float("-inf")]), "v", [0.0, 0.5, 1.0]).first()
    assert (r.n, r.q0, r.q1, r.q2) == (11, float("-inf"), 5.0, float("inf"))


def test_nan_is_null_at_ingest(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double").write.parquet(path)
    assert {r.id: r.x for r in products.read_product(spark, path).collect()} == {1: None, 2: 0.5}


@pytest.mark.parametrize("offset,width", [(1.7e12, 1e5), (0.9975, 0.0025), (288.0, 0.5), (-1e9, 3.0)])
def test_values_far_from_zero_spread_over_ranges(spark, monkeypatch, offset, width):
    monkeypatch.setattr(O, "_CROWD", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else Spark merges ranges this small
    n = 20_000
    v = offset + width * np.random.default_rng(1).permutation(n) / n
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    ranges = O.cumulate(df, "v").groupBy("b").count()
    top = ranges.agg(F.count("*"), F.max("count")).first()
    assert top[0] >= 4 and top[1] < n / 2, "no task sorts most of the values"
    r = O.exact_percentiles(df, "v", [0.0, 0.1, 0.5, 0.999]).first()
    np.testing.assert_array_equal([r.q0, r.q1, r.q2, r.q3], np.percentile(v, [0, 10, 50, 99.9]))
    hit = O._select_buckets(df, "v", [], None, (F.col("start") <= n // 2) & (n // 2 < F.col("start") + F.col("bw")))
    assert hit.count() <= 2000
    ranks = O.whole_table_rank(df, "v").orderBy("v").collect()
    assert [x.rank_avg for x in ranks] == [float(i + 1) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
