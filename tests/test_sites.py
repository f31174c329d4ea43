"""Sequential site rules, thinning, nearest neighbours and scenes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.operators import field as Fd
from firegrid.operators import points as P
from firegrid.operators import scenes as Sc
from firegrid.operators import sites as St


def test_event_groups_overlap(spark):
    rows = [("a", o, f, 1) for o, f in ((0, 10), (1, 13), (0, 17), (1, 40))]
    df = spark.createDataFrame(rows, "site string, observer int, frame int, is_fire int")
    got = {r.frame: (r.seed, r.overlap) for r in St.group_events(df).collect()}
    assert got == {10: (10, False), 13: (17, True), 17: (17, False), 40: (40, False)}


def years(spark, ys, site="s"):
    return spark.createDataFrame([(site, y) for y in ys], "site string, year int")


def test_score_events_fixture(spark):
    truth, prod = years(spark, [2003, 2010]), years(spark, [2004, 2015])
    r = St.score_events(truth, prod, years(spark, [2003, 2004]), 1990, 2018).first()
    assert (r.SpatialUnder, r.FalsePositive, r.FalseNegative, r.CorrectDetection, r.TotalEvents) == (1, 2, 1, 0, 4)
    r = St.score_events(truth, prod, years(spark, [2004]), 1990, 2018).first()
    assert (r.CorrectDetection, r.FalseNegative, r.FalsePositive, r.SpatialUnder) == (1, 1, 1, 0)


def plain_score(bn, ab, da, ba):
    """The rule as a loop over years with a list of unused ones."""
    out = dict.fromkeys(St.EVENT_CLASSES, 0)
    if not bn and not da:
        out["CorrectNonDetection"] = 1
    elif not ab and da:
        out["FalsePositive"] = len(da)
    elif bn and not ba:
        out["FalseNegative"] = len(bn)
    else:
        open_years = bn | da
        for y in sorted(bn | da):
            if y not in open_years:
                continue
            if y in bn and y in da:
                kind = "CorrectDetection"
            elif y in bn:
                pair = [z for z in (y + 1, y - 1) if z in da and z in open_years]
                kind = "SpatialUnder" if y in ba else "CorrectDetection" if pair else "FalseNegative"
            else:
                pair = [z for z in (y + 1, y - 1) if z in bn and z in open_years]
                kind = "SpatialOver" if y in ab else "CorrectDetection" if pair else "FalsePositive"
            if kind == "CorrectDetection" and not (y in bn and y in da):
                open_years -= {y - 1, y + 1}
            open_years.discard(y)
            out[kind] += 1
    return out


def test_score_events_random(spark):
    rng = np.random.default_rng(11)
    sets, rows = {}, {k: [] for k in "bn ab da ba".split()}
    for s in range(120):
        pick = lambda p: {int(y) for y in range(2000, 2012) if rng.random() < p}
        bn, da = pick(rng.choice([0, 0.3, 0.6])), pick(rng.choice([0, 0.3, 0.6]))
        ab, ba = bn | pick(0.2), da | pick(0.2)
        if not bn and rng.random() < 0.5:
            ab = set()
        if not (bn | ab | da | ba):
            continue
        sets[str(s)] = (bn, ab, da, ba)
        for k, v in zip(rows, (bn, ab, da, ba)):
            rows[k] += [(str(s), y) for y in v]
    t = {k: spark.createDataFrame(v, "site string, year int") for k, v in rows.items()}
    got = St.score_events(t["bn"], t["da"], t["ba"], 1990, 2020, adjacent=t["ab"]).collect()
    assert len(got) == len(sets)
    for r in got:
        assert {k: r[k] for k in St.EVENT_CLASSES} == plain_score(*sets[r.site]), r.site


def test_scene_dedup(spark):
    rows = [("a", i, f"2015-06-01 10:{i:02d}:00", "L7", True) for i in range(4)]
    df = spark.createDataFrame(rows, "site string, seq int, ts string, satellite string, qc boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.seq: r.keep for r in Sc.scene_dedup(df).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_scene_dedup_random(spark, chunk):
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for s in range(5):
        t, prev = 0, None
        for i in range(80):
            t += int(rng.choice([3600, 40000, 90000, 400000]))
            sat, qc = str(rng.choice(["L7", "L8"], p=[0.8, 0.2])), bool(rng.random() < 0.8)
            keep = qc and not (i > 1 and t - prev[0] < 86400 and prev[1] == sat and prev[2])
            prev = (t, sat, keep)
            rows.append((s, i, t, sat, qc))
            want[s, i] = keep
    df = spark.createDataFrame(rows, "site int, seq int, t long, satellite string, qc boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.site, r.seq): r.keep for r in Sc.scene_dedup(df, chunk=chunk).collect()}
    assert got == want


def km(a, b):
    la, lo, lb, lp = np.radians([a[0], a[1], b[0], b[1]])
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(h))


def test_thin_points_brute(spark):
    rng = np.random.default_rng(13)
    base = [(float(60 + rng.random() * 0.08), float(179.95 + rng.random() * 0.1)) for _ in range(150)]
    pts = [(la, lo if lo <= 180 else lo - 360) for la, lo in base] + [(60.01, 179.99)] * 60
    order = rng.permutation(len(pts))
    rows = [(int(order[i]), *p) for i, p in enumerate(pts)]
    kept = []
    for s, la, lo in sorted(rows):
        if all(km((la, lo), k[1:]) >= 1.0 for k in kept):
            kept.append((s, la, lo))
    df = spark.createDataFrame(rows, "seq int, lat double, lon double")
    got = {r.seq for r in P.thin_points(df, 1.0).collect()}
    assert got == {k[0] for k in kept}


def test_nearest_site_brute(spark):
    rng = np.random.default_rng(17)
    left = [(i, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(60)]
    right = [(i, float(rng.uniform(40, 42)), float(rng.uniform(10, 12))) for i in range(200)] + [
        (500 + i, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(20)
    ]
    a = spark.createDataFrame(left, "id int, lat double, lon double")
    b = spark.createDataFrame(right, "rid int, lat double, lon double")
    got = {r.id: (r.near_rid, r.km) for r in P.nearest_site(a, b, "rid").collect()}
    for i, la, lo in left:
        d = [(km((la, lo), r[1:]), r[0]) for r in right]
        assert got[i][0] == min(d)[1] and got[i][1] == pytest.approx(min(d)[0])


def test_dirty_field_text(spark):
    words = ["abundunt", "sifficient", "sufficent (see also stand inventory)", "poor to sufficient", "singular to poor", "poor ", "no regeneration", "other"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(Fd.clean_field("w")).collect()
    assert [r[0] for r in got] == ["AR", "IR", "IR", "RF", "RF", "RF", "RF", "other"]


def test_fire_years(spark):
    texts = ["2000 and 2008 and 2017", " more than 10 years ago", None, "2003?", "1950", "(03) crown fire"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(Fd.parse_fire_years("t"), Fd.parse_fire_year("t")).collect()
    assert [r[0] for r in got] == [[2000, 2008, 2017], [], None, [2003], [], [2003]]
    assert [r[1] for r in got][:2] == [2000, None]


def test_disturbance_series_from_forms(spark):
    cols = "site string, observer string, Frame01 int, Date01 date, IsFire01 int, SiteImpacted01 int, StandRep01 int, Frame02 int, Date02 date, IsFire02 int, SiteImpacted02 int, StandRep02 int"
    import datetime as dt

    rows = [
        ("a", "x", 10, dt.date(2001, 6, 1), 1, 1, 0, 40, dt.date(2005, 6, 1), 1, 1, 1),
        ("a", "y", 12, dt.date(2001, 7, 1), 1, 1, 0, None, None, None, None, None),
        ("b", "x", 5, dt.date(2000, 1, 1), 0, 1, None, None, None, None, None, None),
    ]
    forms = spark.createDataFrame(rows, cols)
    got = {(r.site, r.frame): r for r in St.disturbance_series(forms, n_events=2).collect()}
    assert set(got) == {("a", 10), ("a", 40), ("b", 5)}
    assert got["a", 10].agree == 1.0 and got["a", 10].post_loss == 0
    assert got["a", 40].agree == 0.5 and got["a", 40].site_loss == 1 and got["a", 40].post_loss == 1
    assert got["b", 5].site_loss == 1 and got["b", 5].agree == 1.0
