"""Queries: site histories, scoring, field text and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec
from firegrid.operators import field as Fd
from firegrid.operators import points as P
from firegrid.operators import scenes as Sc
from firegrid.operators import sites as St
from firegrid.plans import fixtures as X
from firegrid.plans.fixtures import G, table
from firegrid.plans.queries_joins import hav
from firegrid.plans.registry import i1, q6, query, r6
from firegrid.session import scratch

# seeds by recursion over distinct frames: the next seed is the first frame at least tol away
_SEEDS = """fr AS (SELECT DISTINCT site, is_fire, frame FROM event_form),
  seeds AS (SELECT site, is_fire, min(frame) AS seed FROM fr GROUP BY ALL
    UNION ALL SELECT s.site, s.is_fire, (SELECT min(f.frame) FROM fr f WHERE f.site = s.site AND f.is_fire = s.is_fire AND f.frame >= s.seed + 5) AS seed FROM seeds s WHERE s.seed IS NOT NULL),
  grp AS (SELECT e.*, max(s.seed) AS seed, count(s.seed) > 1 AS overlap FROM event_form e JOIN seeds s ON s.site = e.site AND s.is_fire = e.is_fire AND s.seed IS NOT NULL AND abs(s.seed - e.frame) < 5 GROUP BY ALL)"""


@query(
    "w13_group_events",
    "event_form",
    "SELECT event_id, seed, CASE WHEN overlap THEN 1 ELSE 0 END AS overlap FROM grp",
    also=_SEEDS,
)
def w13(spark, d):
    out = St.group_events(X.event_form(spark, d))
    return out.select("event_id", "seed", i1("overlap").alias("overlap"))


@query(
    "a21_agreement",
    "event_form",
    f"""SELECT site, is_fire, seed, count(DISTINCT observer) AS n_observers, {q6("count(DISTINCT observer) / any_value(n_forms)")} AS agree
        FROM grp JOIN (SELECT site, count(DISTINCT observer) AS n_forms FROM event_form GROUP BY site) USING (site) GROUP BY ALL""",
    also=_SEEDS,
)
def a21(spark, d):
    ev = X.event_form(spark, d)
    out = St.agreement(St.group_events(ev), ev)
    return out.select("site", "is_fire", "seed", "n_observers", r6("agree").alias("agree"))


_SERIES = (
    _SEEDS
    + """,
  cat AS (SELECT site, frame, min(date + 3) AS cdate FROM event_form WHERE event_id % 2 = 0 GROUP BY ALL),
  ev2 AS (SELECT g.site, g.is_fire, g.seed, g.observer, g.frame, coalesce(cdate, date) AS date, g.site_impacted AS s_imp,
     CASE WHEN g.site_impacted <> 1 THEN 0 WHEN g.is_fire = 1 AND g.stand_rep = 1 THEN 1 WHEN g.is_fire = 0 THEN 1 ELSE 0 END AS site_loss FROM grp g LEFT JOIN cat USING (site, frame)),
  nf AS (SELECT site, count(DISTINCT observer) AS n_forms FROM event_form GROUP BY site),
  g2 AS (SELECT site, is_fire, min(frame) AS frame, min(date) AS date, max(s_imp) AS s_imp, max(site_loss) AS site_loss, count(DISTINCT observer) AS n_obs FROM ev2 GROUP BY site, is_fire, seed),
  ser AS (SELECT site, frame, is_fire, min(date) AS date, max(s_imp) AS s_imp, max(site_loss) AS site_loss, max(n_obs / n_forms) AS agree FROM g2 JOIN nf USING (site) WHERE n_forms > 1 GROUP BY site, frame, is_fire),
  ser2 AS (SELECT *, max(site_loss) OVER (PARTITION BY site ORDER BY frame RANGE UNBOUNDED PRECEDING) AS post_loss FROM ser)"""
)


def _series(spark, d):
    ev = X.event_form(spark, d)
    cat = ev.where("event_id % 2 = 0").select("site", "frame", F.date_add("date", 3).alias("date"))
    return St.series_from_events(ev.drop("event_id"), cat)


@query(
    "d11_disturbance_series",
    "event_form",
    f"""SELECT site, frame, is_fire, strftime(date, '%Y-%m-%d') AS date, s_imp, site_loss, {q6("agree")} AS agree, post_loss FROM ser2""",
    also=_SERIES,
)
def d11(spark, d):
    out = _series(spark, d)
    return out.select(
        "site", "frame", "is_fire", F.col("date").cast("string").alias("date"), "s_imp", "site_loss", r6("agree").alias("agree"), "post_loss"
    )


@query(
    "d12_disturbance_counts",
    "event_form",
    """SELECT site, count(*) AS n_events, CAST(CASE WHEN count(CASE WHEN post_loss = 1 AND s_imp = 1 THEN 1 END) > 0 THEN count(CASE WHEN post_loss = 1 AND s_imp = 1 THEN 1 END) - 1 END AS DOUBLE) AS "PostFLdist",
       CAST(CASE WHEN count(CASE WHEN post_loss = 1 AND s_imp = 1 THEN 1 END) > 0 THEN count(CASE WHEN post_loss = 1 AND s_imp = 1 AND is_fire = 1 THEN 1 END)
         - arg_min(CASE WHEN post_loss = 1 AND s_imp = 1 THEN is_fire END, CASE WHEN post_loss = 1 AND s_imp = 1 THEN frame * 2 + is_fire END) END AS DOUBLE) AS "PostFLfire"
       FROM ser2 GROUP BY site""",
    also=_SERIES,
)
def d12(spark, d):
    out = St.disturbance_counts(_series(spark, d))
    return out.select("site", "n_events", F.col("PostFLdist").cast("double").alias("PostFLdist"), F.col("PostFLfire").cast("double").alias("PostFLfire"))


# scoring in SQL by walking the years of each site in order
# lists of site-years made of all rows: the number of fires decides about truth, that of other events about the map
_SCORE = """sy AS (SELECT site, year, count(*) FILTER (fire) AS f, count(*) FILTER (NOT fire) AS o FROM ref_events GROUP BY ALL),
  bn AS (SELECT site, year FROM sy WHERE f % 6 = 1), ab AS (SELECT site, year FROM sy WHERE f % 6 IN (1, 2)),
  da AS (SELECT site, year FROM sy WHERE o % 6 = 1), ba AS (SELECT site, year FROM sy WHERE o % 6 IN (1, 2)),
  yy AS (SELECT site, year, row_number() OVER (PARTITION BY site ORDER BY year) AS k FROM (SELECT * FROM bn UNION SELECT * FROM ab UNION SELECT * FROM da UNION SELECT * FROM ba)),
  yf AS (SELECT y.site, y.year, y.k, bn.year IS NOT NULL AS b, ab.year IS NOT NULL AS a, da.year IS NOT NULL AS m, ba.year IS NOT NULL AS x,
     EXISTS (SELECT 1 FROM da q WHERE q.site = y.site AND q.year = y.year + 1) AS m1, EXISTS (SELECT 1 FROM bn q WHERE q.site = y.site AND q.year = y.year + 1) AS b1
     FROM yy y LEFT JOIN bn USING (site, year) LEFT JOIN ab USING (site, year) LEFT JOIN da USING (site, year) LEFT JOIN ba USING (site, year)),
  walk AS (SELECT site, 0 AS k, CAST(-1 AS INTEGER) AS used, '' AS label FROM (SELECT DISTINCT site FROM yy)
    UNION ALL SELECT f.site, CAST(f.k AS INTEGER),
      CASE WHEN f.year = w.used THEN -1 WHEN f.b AND NOT f.m AND NOT f.x AND f.m1 THEN f.year + 1 WHEN f.m AND NOT f.b AND NOT f.a AND f.b1 THEN f.year + 1 ELSE -1 END,
      CASE WHEN f.year = w.used THEN '' WHEN f.b AND f.m THEN 'CD' WHEN f.b AND f.x THEN 'SU' WHEN f.b AND f.m1 THEN 'CD' WHEN f.b THEN 'FN' WHEN f.m AND f.a THEN 'SO' WHEN f.m AND f.b1 THEN 'CD' WHEN f.m THEN 'FP' ELSE '' END
      FROM walk w JOIN yf f ON f.site = w.site AND f.k = w.k + 1),
  tot AS (SELECT site, count(CASE WHEN b THEN 1 END) AS nb, count(CASE WHEN a THEN 1 END) AS na, count(CASE WHEN m THEN 1 END) AS nm, count(CASE WHEN x THEN 1 END) AS nx FROM yf GROUP BY site),
  lab AS (SELECT site, count(CASE WHEN label = 'CD' THEN 1 END) AS cd, count(CASE WHEN label = 'SU' THEN 1 END) AS su, count(CASE WHEN label = 'SO' THEN 1 END) AS so, count(CASE WHEN label = 'FN' THEN 1 END) AS fn, count(CASE WHEN label = 'FP' THEN 1 END) AS fp FROM walk GROUP BY site),
  kk AS (SELECT *, CASE WHEN nb = 0 AND nm = 0 THEN 1 WHEN na = 0 AND nm > 0 THEN 2 WHEN nb > 0 AND nx = 0 THEN 3 ELSE 4 END AS kind FROM tot JOIN lab USING (site)),
  rs AS (SELECT site, CASE WHEN kind = 4 THEN cd ELSE 0 END AS "CorrectDetection", CASE WHEN kind = 4 THEN su ELSE 0 END AS "SpatialUnder", CASE WHEN kind = 4 THEN so ELSE 0 END AS "SpatialOver",
     CASE kind WHEN 4 THEN fn WHEN 3 THEN nb ELSE 0 END AS "FalseNegative", CASE kind WHEN 4 THEN fp WHEN 2 THEN nm ELSE 0 END AS "FalsePositive", CAST(CASE WHEN kind = 1 THEN 1 ELSE 0 END AS BIGINT) AS "CorrectNonDetection" FROM kk),
  res AS (SELECT site, coalesce("CorrectDetection", 0) AS "CorrectDetection", coalesce("SpatialUnder", 0) AS "SpatialUnder", coalesce("SpatialOver", 0) AS "SpatialOver",
     coalesce("FalseNegative", 0) AS "FalseNegative", coalesce("FalsePositive", 0) AS "FalsePositive", coalesce("CorrectNonDetection", 1) AS "CorrectNonDetection"
     FROM (SELECT DISTINCT site FROM ref_events) LEFT JOIN rs USING (site))"""


def _scores(spark, d):
    n = X.ref_events(spark, d).groupBy("site", "year").agg(F.count_if("fire").alias("f"), F.count_if(~F.col("fire")).alias("o"))
    return St.score_events(n.where("f % 6 = 1"), n.where("o % 6 = 1"), n.where("o % 6 IN (1, 2)"), 1990, 2010, adjacent=n.where("f % 6 IN (1, 2)"), sites=n)


@query(
    "d13_score_events",
    "ref_events",
    """SELECT *, "CorrectDetection" + "SpatialUnder" + "SpatialOver" + "FalseNegative" + "FalsePositive" + "CorrectNonDetection" AS "TotalEvents" FROM res""",
    also=_SCORE,
)
def d13(spark, d):
    return _scores(spark, d)


# the whole chain: forms -> series -> truth lists -> scores; days of the month play the years
_WALK = "  yy AS" + _SCORE.split("  yy AS", 1)[1].replace("FROM ref_events", "FROM ev_years")
_CHAIN = (
    """ev_years AS (SELECT * REPLACE (make_date(1990 + CAST(day(date) AS INTEGER), 1, 1) AS date) FROM event_form),
  """
    + _SERIES.replace("event_form", "ev_years").replace("coalesce(cdate, date) AS date", "date")
    + """,
  pm AS (SELECT site, 1990 + CAST(day(o_orderdate) AS INTEGER) AS year, count(*) AS o FROM (SELECT o_custkey % 150 AS site, o_orderdate FROM orders) GROUP BY ALL)"""
)


def _chain_sql(rule: str) -> str:
    at, near = St.TRUTH_RULES[rule]
    lists = f"""bn AS (SELECT DISTINCT site, CAST(year(date) AS INTEGER) AS year FROM ser2 WHERE {at}), ab AS (SELECT DISTINCT site, CAST(year(date) AS INTEGER) AS year FROM ser2 WHERE {near}),
  da AS (SELECT site, year FROM pm WHERE o % 4 = 1), ba AS (SELECT site, year FROM pm WHERE o % 4 IN (1, 2)),
"""
    return f"""SELECT '{rule}' AS rule, * FROM (WITH RECURSIVE {_CHAIN},
  {lists}{_WALK} SELECT *, "CorrectDetection" + "SpatialUnder" + "SpatialOver" + "FalseNegative" + "FalsePositive" + "CorrectNonDetection" AS "TotalEvents" FROM res)"""


@query("d13_score_forms", "event_form", " UNION ALL ".join(_chain_sql(r) for r in St.TRUTH_RULES))
def d13_forms(spark, d):
    ev = X.event_form(spark, d).withColumn("date", F.make_date(F.lit(1990) + F.dayofmonth("date"), F.lit(1), F.lit(1)))
    series = St.series_from_events(ev.drop("event_id"))
    seen = table(spark, d, "orders").groupBy((F.col("o_custkey") % 150).alias("site"), (F.lit(1990) + F.dayofmonth("o_orderdate")).alias("year")).agg(F.count("*").alias("o"))
    out = None
    for rule in St.TRUTH_RULES:
        truth, adjacent = St.truth_lists(series, rule)
        scores = St.score_events(truth, seen.where("o % 4 = 1"), seen.where("o % 4 IN (1, 2)"), 1990, 2030, adjacent=adjacent, sites=ev)
        part = scores.select(F.lit(rule).alias("rule"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_EVS = '("CorrectDetection" + "SpatialUnder" + "SpatialOver" + "FalseNegative" + "FalsePositive")'


@query(
    "d13_accuracy",
    "ref_events",
    f"""SELECT CAST(sum({_EVS}) AS BIGINT) AS n_events, {", ".join(f'{q6(f"""avg("{k}" / nullif({_EVS}, 0) * 100)""")} AS "pct_{k}"' for k in St.EVENT_CLASSES[:-1])}, {q6(f"avg((21 - {_EVS}) / 21.0e0 * 100)")} AS "annual_CorrectNonDetection" FROM res""",
    also=_SCORE,
)
def d13_accuracy(spark, d):
    out = St.accuracy_table(_scores(spark, d), 21)
    keep = [c for c in out.columns if c.startswith("pct_")] + ["annual_CorrectNonDetection"]
    return out.select("n_events", *[r6(c).alias(c) for c in keep])


# dirty survey text made from the orders' priorities and clerk numbers
_WORDS = ("poor ", "no regeneration", "singular to poor", "sufficent (see also stand inventory)", "abundunt", "unknown", "sifficient", "poor to sufficient")
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"


def _rules_sql(c, rules):
    return "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN '{k}'" for w, k in rules) + f" ELSE {c} END"


@query(
    "d14_clean_field",
    "",
    f"SELECT cls, area, count(*) AS n FROM (SELECT {_rules_sql('w', Fd.RECRUITMENT_RULES)} AS cls, {_rules_sql('w', Fd.RECRUITMENT_RULES_AREA)} AS area FROM fw) GROUP BY ALL",
    also=f"fw AS (SELECT {_WORDS_SQL}[1 + o_orderkey % 8] AS w FROM orders)",
)
def d14(spark, d):
    w = F.element_at(F.array(*[F.lit(x) for x in _WORDS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, d, "orders").select(w.alias("w"))
    return o.groupBy(Fd.clean_field("w").alias("cls"), Fd.clean_field("w", Fd.RECRUITMENT_RULES_AREA).alias("area")).agg(F.count("*").alias("n"))


@query(
    "d14_fire_years",
    sql="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN year(o_orderdate) || ',' || (year(o_orderdate) + 3) WHEN 2 THEN '' ELSE '2003' END AS years FROM orders""",
)
def d14_years(spark, d):
    y = F.year("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), y.cast("string"), F.lit(" crown fire?")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(y.cast("string"), F.lit(" and "), (y + 3).cast("string")))
        .when(F.col("o_orderkey") % 4 == 2, F.lit(" more than 10 years ago"))
        .otherwise(F.lit("(03) crown fire"))
    )
    years = Fd.parse_fire_years(text)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(years, lambda v: v.cast("string")), ",").alias("years"))


@query(
    "d15_fire_year",
    sql="""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 OR year(o_orderdate) < 1997 THEN NULL ELSE year(o_orderdate) END AS DOUBLE) AS year FROM orders""",
)
def d15(spark, d):
    y = F.year("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, y).when(F.col("o_orderkey") % 3 == 1, F.concat(y, F.lit(" and 2017"))).otherwise(F.lit("NA"))
    return table(spark, d, "orders").select("o_orderkey", Fd.parse_fire_year(text, 1997).cast("double").alias("year"))


_SITES3 = f"""l1 AS (SELECT name, lat, lon, 2019 AS year, 0 AS l, site * 618034 % 1000003 AS seq FROM site WHERE nation < 9),
  l2 AS (SELECT name, lat + 0.01e0 AS lat, lon, 2018 AS year, 1 AS l, site * 618034 % 1000003 AS seq FROM site WHERE nation > 4 AND name NOT IN (SELECT name FROM l1)),
  l3 AS (SELECT 'F' || fire_id AS name, lat, lon, 2017 AS year, 2 AS l, fire_id * 618034 % 1000003 AS seq FROM detections),
  pts AS (SELECT *, row_number() OVER (ORDER BY l, seq, name) AS k FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)),
  walk AS (SELECT 0 AS k, CAST([] AS STRUCT(lat DOUBLE, lon DOUBLE, id BIGINT)[]) AS kept
    UNION ALL SELECT p.k, CASE WHEN len(list_filter(w.kept, lambda q: (q.lat = p.lat AND q.lon = p.lon) OR {hav("q.lat", "q.lon", "p.lat", "p.lon")} < 60.0e0)) > 0 THEN w.kept
       ELSE list_append(w.kept, struct_pack(lat := p.lat, lon := p.lon, id := p.k)) END
    FROM walk w JOIN pts p ON p.k = w.k + 1)"""


@query(
    "d16_build_sites",
    "site detections",
    "SELECT name, year FROM pts WHERE k IN (SELECT unnest(kept).id FROM walk WHERE k = (SELECT max(k) FROM pts))",
    also=_SITES3,
)
def d16(spark, d):
    seq = (F.col("site") * 618034 % 1000003).alias("seq")
    s = X.site(spark, d)
    a = s.where("nation < 9").select("name", "lat", "lon", seq)
    b = s.where("nation > 4").select("name", (F.col("lat") + 0.01).alias("lat"), "lon", seq)
    c = X.detections(spark, d).select(
        F.concat(F.lit("F"), F.col("fire_id").cast("string")).alias("name"), "lat", "lon", (F.col("fire_id") * 618034 % 1000003).alias("seq")
    )
    return P.build_sites([(a, 2019), (b, 2018), (c, 2017)], 60.0).select("name", "year")


def _snap(c, base, step, pad):
    return q6(f"{base} + floor(({c} - {base}) / {step} + 0.5e0) * {step} + {pad}")


@query(
    "d17_site_boxes",
    "site",
    f"""SELECT site, {_snap("lat", "40.0e0", "1.5e0", "-2.25e0")} AS lat_min_a, {_snap("lat", "40.0e0", "1.5e0", "2.25e0")} AS lat_max_a, {_snap("lon", "-10.0e0", "5.0e0", "-7.5e0")} AS lon_min_a, {_snap("lon", "-10.0e0", "5.0e0", "7.5e0")} AS lon_max_a,
        {_snap("lat", "40.0e0", "0.5e0", "-1.25e0")} AS lat_min_b, {_snap("lat", "40.0e0", "0.5e0", "1.25e0")} AS lat_max_b, {_snap("lon", "-10.0e0", "0.5e0", "-1.25e0")} AS lon_min_b, {_snap("lon", "-10.0e0", "0.5e0", "1.25e0")} AS lon_max_b FROM site""",
)
def d17(spark, d):
    fine = GridSpec(40.0, -10.0, 0.5, 0.5, 60, 380)
    out = P.site_boxes(X.site(spark, d).select("site", "lat", "lon"), {"a": (G, 1), "b": (fine, 2)})
    return out.select("site", *[r6(c).alias(c) for c in out.columns if c[-2:] in ("_a", "_b")])


_AT = "ON o.lat_idx = floor((lat - 40.0e0) / 1.5e0 + 0.5e0) AND o.lon_idx = floor((lon + 10.0e0) / 5.0e0 + 0.5e0)"


@query(
    "d18_extract_series",
    "site grid_obs",
    f"""SELECT 'annual' AS kind, site, year || '-01-01' AS at, max(value) AS value, count(*) AS n FROM site JOIN grid_obs o {_AT} GROUP BY ALL
        UNION ALL SELECT 'monthly', site, strftime(date_trunc('month', t), '%Y-%m-%d'), max(value), count(*) FROM site JOIN grid_obs o {_AT} GROUP BY ALL""",
)
def d18(spark, d):
    out = St.extract_series(X.grid_obs(spark, d), X.site(spark, d), G)
    a = out["annual"].select(F.lit("annual").alias("kind"), "site", F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("at"), "value", F.col("n_rows").alias("n"))
    m = out["monthly"].select(F.lit("monthly").alias("kind"), "site", F.col("month_start").cast("string").alias("at"), "value", F.col("n_rows").alias("n"))
    return a.unionByName(m)


@query(
    "d19_check_mosaic",
    "site grid_static",
    f"""SELECT site, o.treecover AS tile_value, CASE WHEN o.size % 5 = 0 THEN NULL ELSE o.treecover END AS mosaic_value,
        CASE WHEN o.treecover IS NOT DISTINCT FROM (CASE WHEN o.size % 5 = 0 THEN NULL ELSE o.treecover END) THEN 1 ELSE 0 END AS same FROM site LEFT JOIN grid_static o {_AT}""",
)
def d19(spark, d):
    s = X.grid_static(spark, d)
    tile = s.select(*CELL, F.col("treecover").alias("value"))
    mosaic = s.select(*CELL, F.when(F.col("size") % 5 != 0, F.col("treecover")).alias("value"))
    out = St.check_mosaic(tile, mosaic, X.site(spark, d).select("site", "lat", "lon"), G)
    return out.select("site", "tile_value", "mosaic_value", i1("same").alias("same"))


@query(
    "d20_contrast_stretch",
    "scene_pixels",
    f"""SELECT scene, band, {q6("CASE WHEN hi > lo THEN (greatest(least(value, hi), lo) - lo) / (hi - lo) END")} AS stretched FROM scene_pixels
        JOIN (SELECT scene, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM scene_pixels GROUP BY scene) USING (scene)""",
)
def d20(spark, d):
    out = Sc.contrast_stretch(X.scene_pixels(spark, d), ["scene"])
    return out.select("scene", "band", r6("stretched").alias("stretched"))


@query(
    "x1_burn_flag_stream",
    sql="""SELECT CAST(l_orderkey % 20 AS INTEGER) AS lat_idx, CAST(l_partkey % 40 AS INTEGER) AS lon_idx, CAST(year(l_shipdate) AS INTEGER) AS year,
        max(CASE WHEN l_quantity = 50 AND round(l_tax, 2) >= 0.08e0 THEN 1 ELSE 0 END) AS burnt FROM lineitem GROUP BY ALL""",
)
def x1(spark, d):
    """Streaming flag run to the end of the table."""
    from firegrid.streaming.burn import burn_flag_stream, run_to_table

    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    obs = src.select(
        (F.col("l_orderkey") % 20).cast("int").alias("lat_idx"),
        (F.col("l_partkey") % 40).cast("int").alias("lon_idx"),
        F.col("l_shipdate").cast("timestamp").alias("t"),
        ((F.col("l_quantity") == 50) & (F.round("l_tax", 2) >= 0.08)).alias("burnt"),
    )
    return run_to_table(burn_flag_stream(obs), scratch(spark, "stream")).select(*CELL, "year", "burnt")


