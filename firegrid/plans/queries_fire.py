"""Queries: fire-regime composites (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions.geo import cos_weight
from firegrid.grid import CELL, GridSpec
from firegrid.operators.aggregate import interval_shares
from firegrid.operators.windows import moving_mean
from firegrid.plans import fire as P
from firegrid.plans import fixtures as X
from firegrid.plans.fixtures import G
from firegrid.plans.registry import i1, q6, query, r6


def two_pass(src: str, col: str, sf: int, out: str, extra: str = "", need: int = 1) -> str:
    """SQL of the separable moving mean."""
    lo, hi = sf // 2, (sf - 1) // 2
    fr = f"RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING"

    def mean(c, part, order):
        w = f"OVER (PARTITION BY {part} ORDER BY {order} {fr})"
        return f"CASE WHEN count({c}) {w} >= {need} THEN avg({c}) {w} END"

    return (
        f"{out}_lon AS (SELECT *, {mean(col, 'lat_idx', 'lon_idx')} AS m1 FROM {src}),\n"
        f" {out} AS (SELECT *, {mean('m1', 'lon_idx', 'lat_idx')} AS m2 FROM {out}_lon)"
    )


def two_pass_sum(src: str, expr: str, sf: int, out: str) -> str:
    lo, hi = sf // 2, (sf - 1) // 2
    fr = f"RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING"

    def total(c, part, order):
        w = f"OVER (PARTITION BY {part} ORDER BY {order} {fr})"
        return f"CASE WHEN count({c}) {w} = count(*) {w} THEN sum({c}) {w} END"

    return (
        f"{out}_0 AS (SELECT lat_idx, lon_idx, {expr} AS v FROM {src}),\n"
        f" {out}_1 AS (SELECT lat_idx, lon_idx, {total('v', 'lat_idx', 'lon_idx')} AS s FROM {out}_0),\n"
        f" {out} AS (SELECT lat_idx, lon_idx, {total('s', 'lon_idx', 'lat_idx')} AS s FROM {out}_1)"
    )


W = "cos(radians(40.0e0 + lat_idx * 1.5e0))"


@query(
    "fri_class_shares",
    "anbf",
    f"""SELECT {q6(f"sum(CASE WHEN f <= 15 THEN {W} ELSE 0 END) / sum({W})")} AS share_0_15,
       {q6(f"sum(CASE WHEN f > 15 AND f <= 30 THEN {W} ELSE 0 END) / sum({W})")} AS share_15_30,
       {q6(f"sum(CASE WHEN f > 30 AND f <= 60 THEN {W} ELSE 0 END) / sum({W})")} AS share_30_60,
       {q6(f"sum(CASE WHEN f > 60 AND f <= 120 THEN {W} ELSE 0 END) / sum({W})")} AS share_60_120
       FROM (SELECT lat_idx, 1 / CASE WHEN m2 > 0 THEN m2 ELSE 1e-6 END AS f FROM mm)""",
    also=two_pass("anbf", '"AnBF"', 3, "mm"),
)
def fri_class_shares(spark, d):
    smooth = moving_mean(X.anbf(spark, d), "AnBF", 3)
    fri = smooth.withColumn("FRI", P.reciprocal_floor("AnBF_mean"))
    shares = interval_shares(fri, "FRI", (15, 30, 60, 120), cos_weight(G.lat()))
    return shares.select(*[r6(c).alias(c) for c in shares.columns if c.startswith("share")])


MWB = 4.5  # degrees: three cells


def _finish_sql(src: str, frac: str, sf: int) -> str:
    """Masks and floor of an interval map in SQL."""
    return (
        two_pass_sum("grid_static", "CASE WHEN land THEN 1.0e0 ELSE 0.0e0 END", sf, "nv")
        + f""",
  fin AS (SELECT m.lat_idx, m.lon_idx, CASE WHEN s.land AND nv.s > {(sf / 2) ** 2}e0 THEN CASE WHEN {frac} > 0 THEN {frac} ELSE 1e-6 END END AS a
    FROM {src} m JOIN grid_static s ON s.lat_idx = m.lat_idx AND s.lon_idx = m.lon_idx JOIN nv ON nv.lat_idx = m.lat_idx AND nv.lon_idx = m.lon_idx)"""
    )


_FIN = f"""SELECT lat_idx, lon_idx, {q6("a", 9)} AS "AnBF", {q6("1 / a", 3)} AS "FRI" FROM fin"""


def _fin(df):
    return df.select(*CELL, r6("AnBF", 9).alias("AnBF"), r6("FRI", 3).alias("FRI"))


def _land(spark, d):
    return X.grid_static(spark, d).select(*CELL, "land")


def _flag_fraction(spark, d, low: float):
    """Burned fraction by another threshold, on every cell."""
    from firegrid.operators.aggregate import annual_burned_fraction

    o = X.grid_obs(spark, d).withColumn("hit", F.col("value") >= low)
    frac = annual_burned_fraction(o, len(X.YEARS), "hit")
    return X.cells(spark).join(frac, list(CELL), "left").na.fill(0.0, ["AnBF"])


def _flag_sql(name: str, low: float) -> str:
    return (
        f"{name} AS (SELECT c.lat_idx, c.lon_idx, coalesce(n, 0) / 7.0e0 AS f FROM cells c LEFT JOIN "
        f"(SELECT lat_idx, lon_idx, count(DISTINCT year) AS n FROM grid_obs WHERE value >= {low} GROUP BY ALL) USING (lat_idx, lon_idx))"
    )


@query("d1_fri", "anbf grid_static", _FIN, also=two_pass("anbf", '"AnBF"', 3, "mm") + ",\n " + _finish_sql("mm", "m2", 3))
def d1(spark, d):
    return _fin(P.fri(X.anbf(spark, d), _land(spark, d), G, MWB))


@query(
    "d2_fri_forest_weighted",
    "anbf grid_static",
    _FIN,
    also="""base AS (SELECT lat_idx, lon_idx, "AnBF" AS f, CASE WHEN treecover >= 20 THEN 1.0e0 WHEN treecover < 20 THEN 0.0e0 END AS w FROM anbf JOIN grid_static USING (lat_idx, lon_idx)),
  """
    + two_pass_sum("base", "f * w", 3, "sv")
    + ",\n "
    + two_pass_sum("base", "w", 3, "sw")
    + ",\n fr AS (SELECT sv.lat_idx, sv.lon_idx, sv.s / nullif(sw.s, 0) AS m2 FROM sv JOIN sw ON sv.lat_idx = sw.lat_idx AND sv.lon_idx = sw.lon_idx),\n "
    + _finish_sql("fr", "m2", 3),
)
def d2(spark, d):
    out = P.fri_forest_weighted(X.anbf(spark, d), X.grid_static(spark, d), _land(spark, d), G, MWB, 20.0)
    return _fin(out)


@query(
    "d3_fri_loss",
    "grid_obs grid_static",
    f"""SELECT lat_idx, lon_idx, {q6("m2")} AS fraction, {q6("18 / CASE WHEN m2 > 0 THEN m2 END", 3)} AS "FRI" FROM mm""",
    also="""ls AS (SELECT s.lat_idx, s.lon_idx, CASE WHEN treecover > 10 AND land THEN CASE WHEN h.lat_idx IS NULL THEN 0.0e0 ELSE 1.0e0 END END AS v
      FROM grid_static s LEFT JOIN (SELECT DISTINCT lat_idx, lon_idx FROM grid_obs WHERE burnt) h USING (lat_idx, lon_idx)),
  """
    + two_pass("ls", "v", 5, "mm", need=3),
)
def d3(spark, d):
    hits = X.grid_obs(spark, d).where("burnt").select(*CELL).distinct().withColumn("lost", F.lit(True))
    rows = X.grid_static(spark, d).join(hits, list(CELL), "left").na.fill(False, ["lost"])
    out = P.fri_loss(rows, (F.col("treecover") > 10) & F.col("land"), 5, 18, min_periods=3)
    return out.select(*CELL, r6("fraction").alias("fraction"), r6("FRI", 3).alias("FRI"))


@query(
    "d4_stand_replacing",
    "grid_obs cells",
    f"""SELECT a.lat_idx, a.lon_idx, {q6("CASE WHEN b.f > 0 THEN least(a.f / b.f, 1.0e0) END")} AS sr_frac FROM hi a JOIN lo b USING (lat_idx, lon_idx)""",
    also=_flag_sql("hi", 49) + ",\n " + _flag_sql("lo", 47),
)
def d4(spark, d):
    out = P.stand_replacing_fraction(_flag_fraction(spark, d, 49), _flag_fraction(spark, d, 47))
    return out.withColumn("sr_frac", r6("sr_frac"))


_RISK_IN = (
    "rk AS (SELECT lat_idx, lon_idx, 1 + (lat_idx * 40 + lon_idx + year) % 41 AS f, 1 + (lat_idx * 7 + lon_idx * 13 + year) % 150 AS s, "
    "CASE WHEN lon_idx % 11 <> 0 THEN 1 + (lat_idx * 17 + lon_idx * 3 + n) % 150 END AS g, year "
    "FROM (SELECT lat_idx, lon_idx, year, count(*) AS n FROM grid_obs GROUP BY ALL))"
)


def _b(c):
    return f"coalesce({c}, false)"


_HR = f"({_b('f <= 30')} AND {_b('s <= 120')})"
_MR = f"({_b('f <= 30')} OR {_b('s <= 120')})"
_HRD = f"({_HR} OR ({_b('g <= 120')} AND {_b('f <= 30')}))"
_RISK = " + ".join(
    f"CAST(({x}) AS INTEGER)"
    for x in (
        _MR,
        _HR,
        f"{_HR} AND ({_b('f <= 15')} OR {_b('s <= 60')})",
        f"{_MR} OR {_b('f <= 30')} OR {_b('g <= 120')}",
        _HRD,
        f"{_HRD} AND ({_b('f <= 15')} OR {_b('g <= 60')})",
    )
)


@query(
    "d5_risk_class",
    "grid_obs",
    f"SELECT lat_idx, lon_idx, year, {_RISK} AS risk FROM rk",
    also=_RISK_IN,
)
def d5(spark, d):
    n = X.grid_obs(spark, d).groupBy(*CELL, "year").agg(F.count("*").alias("n"))
    y, x = F.col("lat_idx"), F.col("lon_idx")
    rows = n.select(
        *CELL,
        "year",
        (1 + (y * 40 + x + F.col("year")) % 41).alias("FRI"),
        (1 + (y * 7 + x * 13 + F.col("year")) % 150).alias("SR_FRI"),
        F.when(x % 11 != 0, 1 + (y * 17 + x * 3 + F.col("n")) % 150).alias("DIST_FRI"),
    )
    return P.risk_class(rows).select(*CELL, "year", "risk")


@query(
    "d6_future_risk",
    "grid_obs cells",
    f"""SELECT lat_idx, lon_idx, CAST({_MR} AS INTEGER) + CAST({_HR} AS INTEGER) + CAST(({_HR} AND ({_b('f <= 15')} OR {_b('s <= 60')})) AS INTEGER) AS risk FROM (
        SELECT a.lat_idx, a.lon_idx, 1 / nullif(a.f / 3, 0) AS f, 1 / nullif(a.f / 3 * least(b.f * 1.5e0, 1.0e0), 0) AS s FROM hi a JOIN lo b USING (lat_idx, lon_idx))""",
    also=_flag_sql("hi", 50) + ",\n " + _flag_sql("lo", 49),
)
def d6(spark, d):
    a = _flag_fraction(spark, d, 50).select(*CELL, (F.col("AnBF") / 3).alias("AnBF"))
    b = _flag_fraction(spark, d, 49).select(*CELL, (F.col("AnBF") * 1.5).alias("sr_frac"))
    return P.future_risk(a.join(b, list(CELL))).select(*CELL, "risk")


def _hav(lat1, lon1, lat2, lon2):
    from firegrid.plans.queries_joins import hav

    return hav(lat1, lon1, lat2, lon2)


@query(
    "d7_attributed_loss",
    "grid_obs detections",
    f"""SELECT DISTINCT l.lat_idx, l.lon_idx, l.year FROM (SELECT DISTINCT lat_idx, lon_idx, year FROM grid_obs WHERE value >= 40) l JOIN detections f ON f.year IN (l.year, l.year - 1)
        AND {_hav("40.0e0 + l.lat_idx * 1.5e0", "-10.0e0 + l.lon_idx * 5.0e0", "f.lat", "f.lon")} <= 150""",
)
def d7(spark, d):
    loss = X.grid_obs(spark, d).where("value >= 40").select(*CELL, "year").distinct()
    return P.fire_attributed_loss(loss, X.detections(spark, d), G, 150.0)


@query(
    "d8_forest_mask",
    "grid_static",
    f"""SELECT CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx, {q6("m2")} AS fraction, CASE WHEN m2 / 100 >= 0.5e0 THEN 1.0e0 WHEN m2 / 100 < 0.5e0 THEN 0.0e0 END AS forest
        FROM range(60) a(i), range(380) b(j) JOIN mm ON mm.lat_idx = least(greatest(floor((i * 0.5e0 - 0.75e0) / 3.0e0 + 0.5e0), 0), 9) AND mm.lon_idx = least(greatest(floor((j * 0.5e0 - 2.5e0) / 10.0e0 + 0.5e0), 0), 19)""",
    also="""bk AS (SELECT CAST(lat_idx // 2 AS INTEGER) AS lat_idx, CAST(lon_idx // 2 AS INTEGER) AS lon_idx, avg(treecover) AS v FROM grid_static GROUP BY lat_idx // 2, lon_idx // 2),
  """
    + two_pass("bk", "v", 3, "mm"),
)
def d8(spark, d):
    fine = GridSpec(40.0, -10.0, 0.5, 0.5, 60, 380)
    out = P.forest_mask(X.grid_static(spark, d), G, fine, 2, 3, 0.5)
    return out.select(*CELL, r6("fraction").alias("fraction"), i1("forest").cast("double").alias("forest"))


@query(
    "d9_zone_stack",
    "grid_static grid_obs",
    """SELECT CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx, zone_a, zone_b FROM range(11) x(i), range(26) z(j)
       JOIN (SELECT CAST(lat_idx // 2 AS INTEGER) AS y, CAST(lon_idx // 2 AS INTEGER) AS x, floor(median(treecover / 2) + 0.5e0) AS zone_a FROM grid_static GROUP BY 1, 2) a
         ON a.y = floor((41.0e0 + i * 2.5e0 - 40.75e0) / 3.0e0 + 0.5e0) AND a.x = floor((-8.0e0 + j * 7.0e0 + 7.5e0) / 10.0e0 + 0.5e0)
       JOIN (SELECT CAST(lat_idx // 2 AS INTEGER) AS y, CAST(lon_idx // 2 AS INTEGER) AS x, floor(median(v) + 0.5e0) AS zone_b FROM (SELECT lat_idx, lon_idx, max(line) AS v FROM grid_obs GROUP BY ALL) GROUP BY 1, 2) b
         ON b.y = a.y AND b.x = a.x""",
)
def d9(spark, d):
    coarse = GridSpec(41.0, -8.0, 2.5, 7.0, 11, 26)
    a = X.grid_static(spark, d).select(*CELL, (F.col("treecover") / 2).alias("value"))
    b = X.grid_obs(spark, d).groupBy(*CELL).agg(F.max("line").alias("value"))
    out = P.zone_stack({"zone_a": a, "zone_b": b}, G, coarse, 2)
    return out.select(*CELL, *[F.col(c).cast("double").alias(c) for c in ("zone_a", "zone_b")])


@query(
    "d10_species_histogram",
    "grid_obs grid_static",
    f"""SELECT species, bin, CAST(n AS DOUBLE) AS weight, {q6("n / sum(n) OVER (PARTITION BY species)")} AS share FROM (
        SELECT landcover AS species, CAST(least(floor(fr / (1.0e0 / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM (
          SELECT a.lat_idx, a.lon_idx, CASE WHEN b.f > 0 THEN least(a.f / b.f, 1.0e0) END AS fr FROM hi a JOIN lo b USING (lat_idx, lon_idx)) JOIN grid_static USING (lat_idx, lon_idx)
        WHERE land AND treecover > 20 AND fr IS NOT NULL AND landcover IS NOT NULL GROUP BY 1, 2)""",
    also=_flag_sql("hi", 49) + ",\n " + _flag_sql("lo", 47),
)
def d10(spark, d):
    sr = P.stand_replacing_fraction(_flag_fraction(spark, d, 49), _flag_fraction(spark, d, 47))
    s = X.grid_static(spark, d)
    mask = s.select(*CELL, F.coalesce(F.col("land") & (F.col("treecover") > 20), F.lit(False)).alias("mask"))
    out = P.species_histogram(sr, s.select(*CELL, F.col("landcover").alias("species")), mask)
    return out.select("species", "bin", "weight", r6("share").alias("share"))


@query(
    "d21_burnt_of_original",
    "grid_obs grid_static",
    f"""SELECT lat_idx, lon_idx, {q6("bf")} AS burnt_fraction, {q6("bf / 18.0e0")} AS annual_fraction FROM (
        SELECT n.lat_idx, n.lon_idx, least(least(greatest(m2, 0.0e0), 1.0e0) / CASE WHEN nf < 1 THEN 1 - nf END, 1.0e0) AS bf FROM mm m JOIN nfr n ON m.lat_idx = n.sy AND m.lon_idx = n.sx)
        """,
    also="""ly AS (SELECT c.lat_idx, c.lon_idx, CASE WHEN max(o.lat_idx) IS NULL THEN 0.0e0 ELSE 1.0e0 END AS v FROM grid_static c LEFT JOIN (SELECT * FROM grid_obs WHERE value >= 50) o USING (lat_idx, lon_idx) GROUP BY ALL),
  """
    + two_pass("ly", "v", 4, "mm", need=1)
    + """,
  nfr AS (SELECT CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx, CAST(i * 2 + 1 AS INTEGER) AS sy, CAST(j * 2 + 1 AS INTEGER) AS sx,
     (SELECT avg(1 - treecover / 100) FROM grid_static s WHERE s.lat_idx // 2 = i AND s.lon_idx // 2 = j) AS nf FROM range(10) a(i), range(20) b(j))""",
)
def d21(spark, d):
    from firegrid.operators.aggregate import coarsen

    hits = X.grid_obs(spark, d).where("value >= 50").groupBy(*CELL).agg(F.lit(1).alias("lossyear"))
    loss = X.cells(spark).join(hits, list(CELL), "left").na.fill(0, ["lossyear"])
    nf = coarsen(X.grid_static(spark, d).withColumn("nonforest", 1 - F.col("treecover") / 100), "nonforest", 2, 2)
    out = P.burnt_of_original(loss, nf, G, G.coarser(2, 2), 4)
    return out.select(*CELL, r6("burnt_fraction").alias("burnt_fraction"), r6("annual_fraction").alias("annual_fraction"))
