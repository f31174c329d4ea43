"""Moving windows, coarsening, regridding and masks against hand-made or brute-force answers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec, scale_factor
from firegrid.operators import aggregate as A
from firegrid.operators import joins as J
from firegrid.operators import masks as M
from firegrid.operators import regrid as R
from firegrid.operators import windows as W


def raster(spark, a, name="v"):
    rows = [(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, f"lat_idx int, lon_idx int, {name} double")


def dense(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select(*CELL, col).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def two_pass(a, sf, need=1):
    lo, hi = -(sf // 2), (sf - 1) // 2
    for axis in (1, 0):
        b = np.full(a.shape, np.nan)
        for i in range(a.shape[0]):
            for j in range(a.shape[1]):
                at = j if axis else i
                cut = slice(max(0, at + lo), at + hi + 1)
                w = a[i, cut] if axis else a[cut, j]
                if (~np.isnan(w)).sum() >= need:
                    b[i, j] = np.nanmean(w)
        a = b
    return a


@pytest.fixture(scope="module")
def gap():
    a = np.arange(25, dtype=float).reshape(5, 5) ** 1.5
    a[2, 1] = np.nan
    return a


@pytest.mark.parametrize("sf", [1, 2, 3, 4])
def test_moving_mean(spark, gap, sf):
    got = dense(W.moving_mean(raster(spark, gap), "v", sf), "v_mean", gap.shape)
    np.testing.assert_allclose(got, two_pass(gap, sf), atol=1e-9)


def test_moving_mean_min_count(spark, gap):
    got = dense(W.moving_mean(raster(spark, gap), "v", 3, min_periods=3), "v_mean", gap.shape)
    np.testing.assert_allclose(got, two_pass(gap, 3, 3), atol=1e-9)


def test_flat_mean_differs_from_mean_of_means(spark, gap):
    flat = dense(W.moving_mean_2d(raster(spark, gap), "v", 3), "v_mean2d", gap.shape)
    assert flat[1, 1] == pytest.approx(np.nanmean(gap[0:3, 0:3]))
    assert abs(flat[1, 1] - two_pass(gap, 3)[1, 1]) > 1e-6


def test_constant_field_stays(spark):
    a = np.full((6, 7), 0.25)
    assert np.all(dense(W.moving_mean(raster(spark, a), "v", 5), "v_mean", a.shape) == 0.25)


def test_zero_stays_exact(spark):
    a = np.zeros((3, 80))
    a[:, :10] = 0.1
    got = dense(W.moving_mean(raster(spark, a), "v", 5), "v_mean", a.shape)
    assert np.all(got[:, 20:] == 0.0)


@pytest.mark.parametrize("sf", [47, 49, 201])
def test_far_large_values_leave_small_ones_alone(spark, sf):
    a = np.full((1, 400), 1e-6)
    a[0, 0], a[0, 1] = 1e12, np.nan
    lo, hi = -(sf // 2), (sf - 1) // 2
    got_mean = dense(W.moving_mean(raster(spark, a), "v", sf), "v_mean", a.shape)
    got_sum = dense(W.moving_sum(raster(spark, a), "v", sf, skipna=True), "v_sum", a.shape)
    for i in (0, 30, 150, 250, 399):
        w = a[0, max(0, i + lo) : i + hi + 1]
        assert got_mean[0, i] == pytest.approx(np.nanmean(w), rel=1e-9)
        assert got_sum[0, i] == pytest.approx(np.nansum(w), rel=1e-9)


def test_sum_poisoning(spark, gap):
    got = dense(W.moving_sum(raster(spark, gap), "v", 3), "v_sum", gap.shape)
    assert np.isnan(got[2, 1]) and np.isnan(got[1, 0]) and not np.isnan(got[4, 4])
    assert got[4, 4] == pytest.approx(gap[3:, 3:].sum())


def test_coarsen_pad_and_trim(spark):
    a = np.arange(25, dtype=float).reshape(5, 5)
    g = GridSpec(0, 0, 1, 1, 5, 5)
    df = raster(spark, a)
    assert A.coarsen(df, "v", 2, 2, boundary="pad").count() == 9
    trim = A.coarsen(df, "v", 2, 2, boundary="trim", g=g)
    assert trim.count() == 4
    assert dense(trim, "v", (2, 2))[1, 1] == pytest.approx(a[2:4, 2:4].mean())
    s = A.coarsen(df, "v", 2, 2, "mean").join(A.coarsen(df, "v", 2, 2, "count", out="n"), list(CELL))
    assert s.agg(F.sum(F.col("v") * F.col("n"))).first()[0] == pytest.approx(a.sum())


def test_scale_factor():
    assert scale_factor(GridSpec(0, 0, 0.25, 0.25, 4, 4), GridSpec(0, 0, -1, 1, 1, 1)) == (4, 4)
    with pytest.raises(ValueError):
        scale_factor(GridSpec(0, 0, 0.25, 0.25, 4, 4), GridSpec(0, 0, 1, 2, 1, 1))


def test_conservative_keeps_constant_and_mass(spark):
    rng = np.random.default_rng(1)
    a = rng.random((8, 8))
    fine, coarse = GridSpec(0.5, 0.5, 1, 1, 8, 8), GridSpec(1.0, 1.0, 2, 2, 4, 4)
    out = dense(R.conservative(raster(spark, a), "v", fine, coarse), "v", (4, 4))
    area = np.sin(np.radians(np.arange(1, 9))) - np.sin(np.radians(np.arange(0, 8)))
    want = (a[:2, :2] * area[:2, None]).sum() / (area[:2].sum() * 2)
    assert out[0, 0] == pytest.approx(want)


def test_bilinear_plane_is_exact(spark):
    y, x = np.mgrid[0:5, 0:6]
    g, t = GridSpec(0, 0, 1, 1, 5, 6), GridSpec(0.25, 0.5, 0.7, 0.9, 6, 6)
    out = R.bilinear(raster(spark, 2.0 * y + 3.0 * x), "v", g, t).collect()
    assert out
    for r in out:
        assert r["v"] == pytest.approx(2 * (0.25 + 0.7 * r["lat_idx"]) + 3 * (0.5 + 0.9 * r["lon_idx"]))


def test_nearest_identity(spark, gap):
    g = GridSpec(10, 20, -1, 1, 5, 5)
    np.testing.assert_array_equal(dense(J.reindex_nearest(raster(spark, gap), g, g), "v", gap.shape), gap)


def test_polygon_with_hole(spark):
    g = GridSpec(0.5, 0.5, 1, 1, 10, 10)
    ring = lambda r, pts: [(1, r, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    rows = ring(0, [(1, 1), (9, 1), (9, 9), (1, 9)]) + ring(1, [(3, 3), (6, 3), (6, 6), (3, 6)])
    v = spark.createDataFrame(rows, "poly_id int, ring int, seq int, lon double, lat double")
    cells = {(r.lat_idx, r.lon_idx) for r in M.polygon_cells(v, g).collect()}
    want = {(i, j) for i in range(1, 9) for j in range(1, 9)} - {(i, j) for i in range(3, 6) for j in range(3, 6)}
    assert cells == want


def test_cells_near_points_brute(spark):
    rng = np.random.default_rng(3)
    g = GridSpec(55.0, 10.0, 0.02, 0.03, 60, 60)
    pts = [(float(55 + rng.random() * 1.2), float(10 + rng.random() * 1.8)) for _ in range(25)] * 40
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = {(r.lat_idx, r.lon_idx) for r in J.cells_near_points(df, g, 4.0).collect()}
    lat, lon = np.radians(55 + 0.02 * np.arange(60)), np.radians(10 + 0.03 * np.arange(60))
    want = set()
    for a, o in set(pts):
        a, o = np.radians(a), np.radians(o)
        h = np.sin((lat[:, None] - a) / 2) ** 2 + np.cos(a) * np.cos(lat[:, None]) * np.sin((lon[None] - o) / 2) ** 2
        want |= set(zip(*np.where(2 * 6371.0088 * np.arcsin(np.sqrt(h)) <= 4.0)))
    assert got == {(int(i), int(j)) for i, j in want}
    assert J.cells_near_points(df, g, 4.0).count() == len(want)


def test_focal_fill(spark):
    a = np.full((5, 5), 2.0)
    a[2, 2] = np.nan
    out = W.focal_fill(raster(spark, a), "v", 1, 1)
    assert out.where("filled IS NULL").count() == 0
    assert out.where("lat_idx = 2 AND lon_idx = 2").first()["filled"] == pytest.approx(2.0)


@pytest.mark.parametrize("sf", [1, 2, 3, 4, 49, 201])
def test_wide_windows_leave_no_residue(spark, sf):
    """Values of 1e12 next to 1e-6, gaps of any length, several layers: equal to adding up each window."""
    rng = np.random.default_rng(sf)
    a = np.where(rng.random((2, 3, 700)) < 0.02, 1e12, 1e-6) * rng.random((2, 3, 700))
    a[rng.random(a.shape) < 0.2] = np.nan
    here = rng.random(a.shape) < 0.7
    here[0, 1, 100:650] = False
    rows = [(k, i - 1, j - 300, None if np.isnan(a[k, i, j]) else float(a[k, i, j]), "x") for k, i, j in np.argwhere(here).tolist()]
    df = spark.createDataFrame(rows, "layer int, lat_idx int, lon_idx int, v double, name string")
    got = W._slide(df, ["v"], sf, "lon_idx", ["layer"])
    assert got.columns == [*df.columns, "_rows", "_s_v", "_n_v"]
    got = {(r.layer, r.lat_idx, r.lon_idx): (r._s_v, r._n_v, r._rows, r.v, r.name) for r in got.collect()}
    assert len(got) == len(rows)
    lo, hi = W.frame_ends(sf)
    for k, i, j, v, name in rows:
        cut = slice(max(0, j + 300 + lo), j + 300 + hi + 1)
        w = a[k, i + 1, cut][here[k, i + 1, cut]]
        known = w[~np.isnan(w)]
        s, *rest = got[k, i, j]
        assert rest == [len(known), len(w), v, name]
        assert s == pytest.approx(known.sum(), rel=1e-12) if len(known) else s is None


def test_window_work_does_not_follow_the_width(spark):
    df = spark.range(200_000).selectExpr("0 AS lat_idx", "CAST(id AS INT) AS lon_idx", "CAST(id AS DOUBLE) AS v")
    took = {}
    for sf in (3, 3, 4001):
        out = W._slide(df, ["v"], sf, "lon_idx", [])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        t = time.perf_counter()
        assert out.agg(F.max("_rows")).first()[0] == sf
        took[sf] = time.perf_counter() - t
    assert took[4001] < 5 * took[3] + 1  # adding up every window would take 4001 / 3 times as long


def _area_means(g, f):
    """Exact area means of a + b * lat + c * lon on the cells of a grid."""
    a, b, c = f
    south = np.radians(g.lat0 + np.arange(g.nlat) * g.dlat - abs(g.dlat) / 2)
    north = south + np.radians(abs(g.dlat))
    middle = np.degrees((north * np.sin(north) + np.cos(north) - south * np.sin(south) - np.cos(south)) / (np.sin(north) - np.sin(south)))
    return a + b * middle[:, None] + c * (g.lon0 + np.arange(g.nlon) * g.dlon)[None, :]


@pytest.mark.parametrize("g_in,g_out", [
    (GridSpec(40.25, 10.25, 0.5, 0.5, 24, 30), GridSpec(40.85, 10.65, 0.7, 0.9, 15, 15)),
    (GridSpec(60.0, 20.0, -1.5, 2.0, 12, 9), GridSpec(46.0, 21.1, 0.4, 0.3, 30, 40)),
])
def test_second_order_remap_keeps_linear_fields(spark, g_in, g_out):
    f = (3.0, -0.7, 0.31)
    got = dense(R.conservative(raster(spark, _area_means(g_in, f)), "v", g_in, g_out, order=2), "v", (g_out.nlat, g_out.nlon))
    want = _area_means(g_out, f)
    ys, xs = (g_in.lat0 + np.array([-0.5, g_in.nlat - 0.5]) * g_in.dlat, g_in.lon0 + np.array([-0.5, g_in.nlon - 0.5]) * g_in.dlon)
    lat, lon = g_out.lat0 + np.arange(g_out.nlat) * g_out.dlat, g_out.lon0 + np.arange(g_out.nlon) * g_out.dlon
    inside = np.ix_((lat - abs(g_out.dlat) / 2 >= ys.min()) & (lat + abs(g_out.dlat) / 2 <= ys.max()), (lon - g_out.dlon / 2 >= xs.min()) & (lon + g_out.dlon / 2 <= xs.max()))
    assert got[inside].size > 50
    np.testing.assert_allclose(got[inside], want[inside], rtol=1e-11)
    flat = dense(R.conservative(raster(spark, _area_means(g_in, f)), "v", g_in, g_out), "v", (g_out.nlat, g_out.nlon))
    assert np.abs(flat[inside] - want[inside]).max() > 1e-3


@pytest.mark.parametrize("order", [1, 2])
def test_remap_keeps_the_integral_over_the_globe(spark, order):
    """Grids that start at different meridians; the target covers the source, so no area is lost."""
    g_in, g_out = GridSpec(-87.5, -177.5, 5.0, 5.0, 36, 72), GridSpec(86.0, 4.0, -8.0, 8.0, 22, 45)
    g_out = GridSpec(84.0, 4.0, -12.0, 8.0, 15, 45)
    a = np.random.default_rng(1).random((36, 72)) ** 3
    got = dense(R.conservative(raster(spark, a), "v", g_in, g_out, order=order), "v", (15, 45))
    assert not np.isnan(got).any()

    def integral(v, g):
        lat = g.lat0 + np.arange(g.nlat) * g.dlat
        strip = np.sin(np.radians(lat + abs(g.dlat) / 2)) - np.sin(np.radians(lat - abs(g.dlat) / 2))
        return (v * strip[:, None]).sum() * np.radians(abs(g.dlon))

    assert integral(got, g_out) == pytest.approx(integral(a, g_in), rel=1e-12)


def test_gradient_next_to_gaps(spark):
    a = np.array([[1.0, np.nan, 5.0, 9.0], [np.nan, np.nan, 6.0, 10.0]])
    g = GridSpec(0.0, 10.0, 2.0, 2.0, 2, 4)
    got = {(r.lat_idx, r.lon_idx): (r.gy, r.gx) for r in R.gradients(raster(spark, a), "v", g).collect()}
    assert got[0, 0] == (0.0, 0.0) and got[0, 2][1] == got[0, 3][1] == 2.0  # one neighbour each
    assert got[0, 2][0] == pytest.approx(0.5, rel=1e-3) and set(got) == {(0, 0), (0, 2), (0, 3), (1, 2), (1, 3)}
    assert R.conservative(raster(spark, a).where("v IS NULL"), "v", g, g, order=2).count() == 0


def test_bilinear_covers_the_globe(spark):
    g_in, g_out = GridSpec(88.0, 2.0, -4.0, 4.0, 45, 90), GridSpec(-89.5, -179.5, 1.0, 1.0, 180, 360)
    lat, lon = np.radians(g_in.lat0 + np.arange(45) * g_in.dlat), np.radians(g_in.lon0 + np.arange(90) * g_in.dlon)
    field = lambda la, lo: np.cos(la)[:, None] * np.cos(lo)[None, :] + np.sin(la)[:, None]
    got = dense(R.bilinear(raster(spark, field(lat, lon)), "v", g_in, g_out), "v", (180, 360))
    assert not np.isnan(got).any()
    want = field(np.radians(-89.5 + np.arange(180)), np.radians(-179.5 + np.arange(360)))
    assert np.abs(got - want).max() < 2e-3


def _inside(x, y, ring):
    """Even-odd rule in the plane."""
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 <= y < y2 or y2 <= y < y1) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


@pytest.mark.parametrize("ring", [
    [(170, 10.3), (-170, 10.3), (-170, 30.2), (170, 30.2)],
    [(-175.3, -20), (160, -5), (175, 33.3), (-160.7, 12), (178, 2)],
    [(359, 1.1), (3, 1.1), (2, 9.7)],
])
def test_polygon_over_the_date_line(spark, ring):
    plain = [(x % 360 if ring[0][0] < 300 else (x + 180) % 360, y) for x, y in ring]  # no edge crosses the edge of these numbers
    v = spark.createDataFrame([(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate(ring)], "poly_id int, ring int, seq int, lon double, lat double")
    for g in (GridSpec(-88.0, -178.0, 4.0, 4.0, 45, 90), GridSpec(88.0, 2.0, -4.0, 4.0, 45, 90)):
        got = [(r.lat_idx, r.lon_idx) for r in M.polygon_cells(v, g).collect()]
        move = 0 if ring[0][0] < 300 else 180
        want = {(i, j) for i in range(45) for j in range(90) if _inside((g.lon0 + j * g.dlon + move) % 360, g.lat0 + i * g.dlat, plain)}
        assert len(got) == len(set(got)) and set(got) == want and want or ring[0][0] > 300


def test_polygon_round_the_pole(spark):
    ring = [(0, 61.05), (90, 65.1), (180, 61.05), (-90, 70.07)]
    v = spark.createDataFrame([(1, 0, k, float(x), y) for k, (x, y) in enumerate(ring)], "poly_id int, ring int, seq int, lon double, lat double")
    g = GridSpec(-88.0, -178.0, 4.0, 4.0, 45, 90)
    got = [(r.lat_idx, r.lon_idx) for r in M.polygon_cells(v, g).collect()]
    unrolled = [(-180, 61.05), (-90, 70.07), (0, 61.05), (90, 65.1), (180, 61.05)]
    edge = lambda lon: np.interp(lon, [x for x, _ in unrolled], [y for _, y in unrolled])
    want = {(i, j) for i in range(45) for j in range(90) if -88 + 4 * i > edge(-178 + 4 * j)}
    assert len(got) == len(set(got)) and set(got) == want


def test_box_bounds(spark):
    g = GridSpec(0.1, 0.1, 0.1, 0.1, 30, 30)  # 0.1 * 3 is not 0.3
    df = g.lattice(spark)
    got = M.bbox(df, 0.3, 0.7, 0.6, 1.2, g)
    assert {tuple(r) for r in got.agg(F.min("lat_idx"), F.max("lat_idx"), F.min("lon_idx"), F.max("lon_idx")).collect()} == {(5, 11, 2, 6)}
    assert M.bbox(df, 5.0, 6.0, 0.0, 1.0, g).count() == 0 and M.bbox(df, 1.0, 0.5, 0.0, 1.0, g).count() == 0
    down = GridSpec(3.0, 0.1, -0.1, 0.1, 30, 30)
    assert {r[0] for r in M.bbox(df, 0.1, 0.1, 2.8, 3.0, down).select("lat_idx").collect()} == {0, 1, 2}
