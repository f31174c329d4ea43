"""Queries: sources, sinks, decoding (S, P) and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions import decode as D
from firegrid.grid import CELL, GridSpec, scale_factor
from firegrid.operators import masks as M
from firegrid.plans import fixtures as X
from firegrid.plans.fixtures import G, table
from firegrid.plans.registry import i1, q6, query, r6
from firegrid.session import scratch
from firegrid.sources import products as S
from firegrid.sources import sinks as K


@query("s1_read_product", sql="SELECT l_orderkey AS cell, l_quantity AS value, l_linenumber AS line FROM lineitem")
def s1(spark, d):
    return S.read_product(
        spark,
        f"{d}/lineitem.parquet",
        ["l_orderkey", "l_quantity", "l_linenumber"],
        {"l_orderkey": "cell", "l_quantity": "value", "l_linenumber": "line"},
    )


@query(
    "s2_step_shapes",
    "grid_obs",
    """SELECT year, count(DISTINCT lat_idx) AS n_lat, CAST(max(lon_idx) - min(lon_idx) + 1 AS BIGINT) AS n_lon FROM grid_obs GROUP BY year""",
)
def s2(spark, d):
    return S.step_shapes(X.grid_obs(spark, d), "year").select(
        "year", F.col("n_lat").cast("long").alias("n_lat"), F.col("n_lon").cast("long").alias("n_lon")
    )


@query("s2_read_multi", "grid_obs", "SELECT year, count(*) AS n, sum(line)::BIGINT AS lines FROM grid_obs GROUP BY year")
def s2_multi(spark, d):
    """The observations written as two files of years, and read as one table."""
    obs = X.grid_obs(spark, d).select(*CELL, "year", "value", "line")
    paths = [scratch(spark, "years") for _ in range(2)]
    for path, part in zip(paths, ("year < 1998", "year >= 1998"), strict=True):
        obs.where(part).write.parquet(path)
    return S.read_multi(spark, paths, check_shape=False).groupBy("year").agg(F.count("*").alias("n"), F.sum("line").cast("long").alias("lines"))


@query(
    "s3_mosaic",
    "grid_static",
    """SELECT lat_idx, lon_idx, treecover FROM grid_static
       UNION ALL SELECT lat_idx, lon_idx + 40, treecover FROM grid_static
       UNION ALL SELECT lat_idx + 20, lon_idx, treecover FROM grid_static""",
)
def s3(spark, d):
    tile = X.grid_static(spark, d).select(*CELL, "treecover")
    return S.mosaic([tile, tile, tile], [(0, 0), (0, 40), (20, 0)])


@query("s4_read_lookup", sql="SELECT n_nationkey AS code, n_name AS name, n_regionkey AS grp FROM nation")
def s4(spark, d):
    path = scratch(spark, "lookup")
    named = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("﻿code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp")
    )
    K.write_table(named, path)
    return S.read_lookup(spark, path, "code int, name string, grp int")


@query(
    "s5_write_result",
    "anbf",
    f"""SELECT lat_idx, lon_idx, {q6('"AnBF"')} AS "AnBF" FROM anbf""",
)
def s5(spark, d):
    path = scratch(spark, "anbf")
    out = X.anbf(spark, d).withColumn("product", F.lit("obs"))
    K.write_result(out, path, ["product"])
    K.write_result(out.limit(0), path, ["product"])  # present, so left alone
    return spark.read.parquet(path).select(*CELL, r6("AnBF").alias("AnBF"))


@query(
    "s6_write_table",
    "grid_obs",
    "SELECT year, count(*) AS n, sum(value) AS total FROM grid_obs GROUP BY year",
)
def s6(spark, d):
    path = scratch(spark, "table")
    K.write_table(X.grid_obs(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.sum("value").alias("total")), path)
    return spark.read.csv(path, header=True, schema="year int, n long, total double")


@query(
    "s7_provenance",
    sql="SELECT 'obs' AS title, 'yearly burned fraction' AS summary, 'lineitem' AS source, count(*) AS n_rows FROM lineitem",
)
def s7(spark, d):
    row = K.provenance(spark, "obs", "yearly burned fraction", {"source": "lineitem"})
    path = scratch(spark, "provenance")
    K.append_provenance(row, path)
    kept = spark.read.parquet(path).select("title", "summary", F.col("inputs")["source"].alias("source"))
    return kept.join(table(spark, d, "lineitem").agg(F.count("*").alias("n_rows")))


@query("s8_split_vars", "grid_static", "SELECT lat_idx, lon_idx, value2 AS value FROM grid_static")
def s8(spark, d):
    return K.split_vars(X.grid_static(spark, d), ["treecover", "value2"])["value2"]


@query(
    "s9_resume_bands",
    "grid_obs",
    """SELECT CAST(least(lat_idx // 5, 3) AS INTEGER) AS lat_band, count(*) AS n, sum(value) AS total FROM grid_obs GROUP BY 1""",
)
def s9(spark, d):
    path = scratch(spark, "bands")
    rows = X.grid_obs(spark, d).select("value", D.lat_band("lat_idx", 20, 4).alias("lat_band"))
    K.write_pending(rows.where("lat_band < 2"), path)
    K.write_pending(rows, path)
    return spark.read.parquet(path).groupBy("lat_band").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "s10_validity",
    "anbf",
    f"""SELECT {q6('max("AnBF")')} AS max_value, count("AnBF") AS n_values, CASE WHEN max("AnBF") <= 1 THEN 1 ELSE 0 END AS valid FROM anbf""",
)
def s10(spark, d):
    return K.validity(X.anbf(spark, d), "AnBF").select(
        r6("max_value").alias("max_value"), "n_values", i1("valid").alias("valid")
    )


@query(
    "p1_scale_valid",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, {q6("CASE WHEN l_extendedprice / 10000.0e0 - 5.0e0 >= -0.3e0 THEN l_extendedprice / 10000.0e0 - 5.0e0 END")} AS ndvi FROM lineitem""",
)
def p1(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        r6(D.scale_valid(F.col("l_extendedprice") - 50000.0, 10000, lo=-0.3)).alias("ndvi"),
    )


@query(
    "p2_unpack_flag",
    sql=f"""SELECT l_orderkey, l_linenumber, CAST(floor(l_partkey / 2000.0e0) AS INTEGER) AS flag, {q6("(l_partkey - 2000 * floor(l_partkey / 2000.0e0)) / 10.0e0")} AS perc FROM lineitem""",
)
def p2(spark, d):
    flag, perc = D.unpack_flag("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), r6(perc).alias("perc"))


@query(
    "p3_frac_month",
    sql="""SELECT o_orderkey, strftime(make_date(CAST(year(o_orderdate) AS BIGINT), CAST(1 + o_custkey % 12 AS BIGINT), CAST(floor(((o_orderkey % 8) / 10.0e0) * 30 + 1) AS BIGINT)), '%Y-%m-%d') AS day FROM orders""",
)
def p3(spark, d):
    m = F.col("o_custkey") % 12 + 1 + (F.col("o_orderkey") % 8) / 10.0
    # the fraction is formed apart, so both engines see the same digits
    frac = F.round(m - F.floor(m), 9)
    date = D.frac_month_date(F.year("o_orderdate"), F.floor(m) + frac + 1e-9)
    return table(spark, d, "orders").select("o_orderkey", date.cast("string").alias("day"))


@query(
    "p4_doy_date",
    sql="""SELECT o_orderkey, strftime(make_date(year(o_orderdate), 1, 1) + CAST(o_custkey % 365 AS INTEGER), '%Y-%m-%d') AS day,
             strftime(make_date(year(o_orderdate), 1, 1) + CAST(o_custkey % 365 + 1 AS INTEGER), '%Y-%m-%d') AS day_late FROM orders""",
)
def p4(spark, d):
    doy = F.col("o_custkey") % 365 + 1
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        D.doy_date(y, doy).cast("string").alias("day"),
        D.doy_date(y, doy, offset=0).cast("string").alias("day_late"),
    )


@query(
    "p5_ms_timestamp",
    sql="""SELECT event_id, strftime(make_timestamp_ms(epoch_us(ts) // 1000), '%Y-%m-%d %H:%M:%S') AS at FROM events""",
)
def p5(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.select("event_id", F.date_format(D.ms_timestamp("ms"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "p6_date_from_name",
    sql="""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def p6(spark, d):
    name = F.concat(F.lit("/data/BA_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_v1.nc"))
    day = D.date_from_name(name, r"BA_(\d{8})_", "yyyyMMdd")
    return table(spark, d, "orders").select("o_orderkey", day.cast("string").alias("day"))


@query(
    "p7_restamp",
    "grid_obs",
    """SELECT DISTINCT lat_idx, lon_idx, year || '-06-30' AS mid, year || '-12-31' AS last FROM grid_obs""",
)
def p7(spark, d):
    years = X.grid_obs(spark, d).select(*CELL, "year").distinct()
    return years.select(
        *CELL, D.restamp("year", 6, 30).cast("string").alias("mid"), D.restamp("year", 12, 31).cast("string").alias("last")
    )


@query(
    "p8_null_sentinels",
    sql="""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity NOT IN (0, 50, 49, 2) AND l_quantity >= 5 AND l_quantity <= 45 THEN l_quantity END AS v FROM lineitem""",
)
def p8(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", D.null_sentinels("l_quantity", (0, 50, 49, 2), lo=5, hi=45).alias("v")
    )


@query(
    "p9_axis",
    "grid_static",
    f"""SELECT lat_idx, lon_idx, {q6("40.0e0 + lat_idx * 1.5e0")} AS lat, {q6("-10.0e0 + lon_idx * 5.0e0")} AS lon, treecover FROM grid_static""",
)
def p9(spark, d):
    return X.grid_static(spark, d).select(*CELL, r6(G.lat()).alias("lat"), r6(G.lon()).alias("lon"), "treecover")


@query(
    "p10_to_index",
    "detections",
    """SELECT fire_id, CAST(floor((lat - 40.0e0) / 1.5e0 + 0.5e0) AS INTEGER) AS lat_idx, CAST(floor((lon + 10.0e0) / 5.0e0 + 0.5e0) AS INTEGER) AS lon_idx FROM detections""",
)
def p10(spark, d):
    return X.detections(spark, d).select(
        "fire_id", G.lat_index("lat").alias("lat_idx"), G.lon_index("lon").alias("lon_idx")
    )


@query(
    "p11_scale_factor",
    "grid_obs",
    """SELECT CAST(lat_idx // 4 AS INTEGER) AS lat_idx, CAST(lon_idx // 4 AS INTEGER) AS lon_idx, count(*) AS n FROM grid_obs GROUP BY 1, 2""",
)
def p11(spark, d):
    ky, kx = scale_factor(G, GridSpec(42.25, -2.5, 6.0, 20.0, 5, 10))
    return (
        X.grid_obs(spark, d)
        .groupBy(F.expr(f"CAST(lat_idx DIV {ky} AS INT)").alias("lat_idx"), F.expr(f"CAST(lon_idx DIV {kx} AS INT)").alias("lon_idx"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "p12_mid_temperature",
    "climate",
    f"""SELECT lat_idx, lon_idx, month, {q6("(max(tmean) + min(tmean)) / 2")} AS tmean FROM climate GROUP BY ALL""",
)
def p12(spark, d):
    from firegrid.operators.joins import mid_temperature

    months = X.climate(spark, d).groupBy(*CELL, "month")
    tmax, tmin = months.agg(F.max("tmean").alias("tmax")), months.agg(F.min("tmean").alias("tmin"))
    return mid_temperature(tmax, tmin, [*CELL, "month"]).select(*CELL, "month", r6("tmean").alias("tmean"))


@query(
    "p13_reciprocal_floor",
    "anbf",
    f"""SELECT lat_idx, lon_idx, {q6('1 / CASE WHEN "AnBF" > 0 THEN "AnBF" ELSE 1e-6 END', 3)} AS "FRI" FROM anbf""",
)
def p13(spark, d):
    return X.anbf(spark, d).select(*CELL, r6(D.reciprocal_floor("AnBF"), 3).alias("FRI"))


@query(
    "p14_clip",
    "grid_static",
    """SELECT lat_idx, lon_idx, least(greatest(treecover / 80.0e0, 0.1e0), 1.0e0) AS frac, CASE WHEN value2 > 950 THEN 951.0e0 ELSE value2 END AS over FROM grid_static WHERE treecover IS NOT NULL""",
)
def p14(spark, d):
    return X.grid_static(spark, d).where("treecover IS NOT NULL").select(
        *CELL, D.clip(F.col("treecover") / 80.0, 0.1, 1.0).alias("frac"), D.clip("value2", hi=950, over=951).alias("over")
    )


@query(
    "p15_label_year",
    "grid_year",
    """SELECT lat_idx, lon_idx, CAST(max(CASE WHEN burnt = 1 THEN year END) AS DOUBLE) AS last_burn FROM grid_year GROUP BY ALL""",
)
def p15(spark, d):
    y = D.label_year(F.col("burnt") == 1, "year")
    return X.grid_year(spark, d).groupBy(*CELL).agg(F.max(y).cast("double").alias("last_burn"))


@query(
    "p16_post_event_anomaly",
    "site_series",
    f"""SELECT site, {q6("avg(z)")} AS anomaly, count(*) AS n FROM (
        SELECT site, step, (value - avg(value) OVER (PARTITION BY site)) / stddev_pop(value) OVER (PARTITION BY site) AS z FROM site_series)
        WHERE step > site % 20 + 1 AND step <= site % 20 + 5 GROUP BY site""",
)
def p16(spark, d):
    from firegrid.operators.aggregate import post_event_anomaly

    s = X.site_series(spark, d)
    ev = s.select("site").distinct().select("site", (F.col("site") % 20 + 1).alias("event"))
    out = post_event_anomaly(s, ev, 4, x="step")
    return out.select("site", r6("anomaly").alias("anomaly"), "n")


@query(
    "p17_union_box",
    "site",
    f"""SELECT site, {q6("least(lat - 1, lat * 0.98e0)")} AS lat_min, {q6("greatest(lat + 1, lat * 1.02e0)")} AS lat_max FROM site""",
)
def p17(spark, d):
    from firegrid.operators.points import union_box

    s = X.site(spark, d).withColumns(
        {"lo_a": F.col("lat") - 1, "lo_b": F.col("lat") * 0.98, "hi_a": F.col("lat") + 1, "hi_b": F.col("lat") * 1.02}
    )
    out = union_box(s, {"lat_min": ("lo_a", "lo_b")}, {"lat_max": ("hi_a", "hi_b")})
    return out.select("site", r6("lat_min").alias("lat_min"), r6("lat_max").alias("lat_max"))


@query(
    "f1_bbox",
    "grid_obs",
    """SELECT lat_idx, lon_idx, count(*) AS n FROM grid_obs WHERE 40.0e0 + lat_idx * 1.5e0 BETWEEN 46 AND 60 AND -10.0e0 + lon_idx * 5.0e0 BETWEEN 20 AND 120 GROUP BY ALL""",
)
def f1(spark, d):
    return M.bbox(X.grid_obs(spark, d), 20, 120, 46, 60, G).groupBy(*CELL).agg(F.count("*").alias("n"))


@query(
    "f2_between_dates",
    sql="""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'""",
)
def f2(spark, d):
    li = table(spark, d, "lineitem")
    return M.between_dates(li, "1996-03-01", "1996-05-31", "l_shipdate").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "f3_apply_mask",
    "grid_obs grid_static",
    """SELECT o.lat_idx, o.lon_idx, o.year, max(CASE WHEN s.land THEN o.value END) AS value FROM grid_obs o LEFT JOIN grid_static s USING (lat_idx, lon_idx) GROUP BY ALL""",
)
def f3(spark, d):
    # the maximum per cell-year first: a hot cell reaches the join as a handful of rows
    top = X.grid_obs(spark, d).groupBy(*CELL, "year").agg(F.max("value").alias("value"))
    return M.apply_mask(top, X.grid_static(spark, d), ["value"], "land")


@query(
    "f4_combine_masks",
    "grid_static",
    """SELECT lat_idx, lon_idx, CASE WHEN coalesce(land, false) AND coalesce(treecover > 30, false) THEN 1 ELSE 0 END AS mask FROM grid_static""",
)
def f4(spark, d):
    s = X.grid_static(spark, d)
    a, b = s.select(*CELL, F.col("land").alias("mask")), s.select(*CELL, D.threshold("treecover", ">", 30).alias("mask"))
    return M.combine_masks([a, b]).select(*CELL, i1("mask").alias("mask"))


_SUM2 = """lonp AS (SELECT lat_idx, lon_idx, sum(CASE WHEN land THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY lat_idx ORDER BY lon_idx RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM grid_static),
  latp AS (SELECT lat_idx, lon_idx, sum(s) OVER (PARTITION BY lon_idx ORDER BY lat_idx RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n_valid FROM lonp)"""


@query(
    "f5_sufficiency",
    "grid_static",
    f"""SELECT lat_idx, lon_idx, {q6("n_valid")} AS n_valid, CASE WHEN n_valid > 4 THEN 1 ELSE 0 END AS enough FROM latp""",
    also=_SUM2,
)
def f5(spark, d):
    mask = X.grid_static(spark, d).select(*CELL, F.col("land").alias("mask"))
    return M.sufficiency_mask(mask, 4).select(*CELL, r6("n_valid").alias("n_valid"), i1("enough").alias("enough"))


@query(
    "f6_land_mask",
    "grid_obs",
    """SELECT lat_idx, lon_idx, CASE WHEN max(CASE WHEN line = 2 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS by_code,
        CASE WHEN count(line) >= 5 THEN 1 ELSE 0 END AS by_coverage, CASE WHEN max(CASE WHEN line = 7 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS by_water FROM grid_obs GROUP BY ALL""",
)
def f6(spark, d):
    o = X.grid_obs(spark, d)
    out = M.land_mask(o, "code", "line").withColumnRenamed("land", "by_code")
    out = out.join(M.land_mask(o, "coverage", "line").withColumnRenamed("land", "by_coverage"), list(CELL))
    out = out.join(M.land_mask(o, "water", "line", water=7).withColumnRenamed("land", "by_water"), list(CELL))
    return out.select(*CELL, *[i1(c).alias(c) for c in ("by_code", "by_coverage", "by_water")])


@query(
    "f7_threshold",
    "grid_static",
    """SELECT landcover, count(CASE WHEN treecover > 50 THEN 1 END) AS gt, count(CASE WHEN treecover >= 50 THEN 1 END) AS ge, count(CASE WHEN treecover / 100.0e0 >= 0.3e0 THEN 1 END) AS frac FROM grid_static GROUP BY ALL""",
)
def f7(spark, d):
    return X.grid_static(spark, d).groupBy("landcover").agg(
        F.count_if(D.threshold("treecover", ">", 50)).alias("gt"),
        F.count_if(D.threshold("treecover", ">=", 50)).alias("ge"),
        F.count_if(D.threshold(F.col("treecover") / 100.0, ">=", 0.3)).alias("frac"),
    )


@query(
    "f8_burn_flag",
    "grid_obs",
    """SELECT year, count(CASE WHEN value - 25 > 0 THEN 1 END) AS by_date, count(CASE WHEN line = 1 THEN 1 END) AS by_code, count(CASE WHEN line > 0 AND line - 4 = year - 2000 AND line - 4 > 0 THEN 1 END) AS by_loss FROM grid_obs GROUP BY ALL""",
)
def f8(spark, d):
    return X.grid_obs(spark, d).groupBy("year").agg(
        F.count_if(D.burn_flag(F.col("value") - 25, "date")).alias("by_date"),
        F.count_if(D.burn_flag("line", "code")).alias("by_code"),
        F.count_if(D.burn_flag(F.col("line") - 4, "loss", "year")).alias("by_loss"),
    )


@query(
    "f9_filter_fires",
    sql="""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_custkey % 100 >= 30 GROUP BY 1""",
)
def f9(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("confidence"), F.col("o_orderdate").alias("acq_date"))
    return M.filter_fires(o).groupBy("year").agg(F.count("*").alias("n"))


@query(
    "f10_filter_months",
    "grid_obs",
    """SELECT month, count(*) AS n, sum(value) AS total FROM grid_obs WHERE month BETWEEN 6 AND 8 GROUP BY ALL""",
)
def f10(spark, d):
    return M.filter_months(X.grid_obs(spark, d)).groupBy("month").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "f11_model_domain",
    "anbf",
    f"""SELECT lat_idx, lon_idx, {q6('"AnBF"')} AS "AnBF" FROM anbf WHERE "AnBF" >= 0.1e0 AND 1 / "AnBF" <= 8.0e0""",
)
def f11(spark, d):
    dom = M.model_domain(X.anbf(spark, d), "AnBF", 0.1).withColumn("FRI", 1 / F.col("AnBF"))
    return M.model_domain(dom, "FRI", 0.125).select(*CELL, r6("AnBF").alias("AnBF"))


@query(
    "f12_drop_null_rows",
    "grid_static",
    """SELECT lat_idx, lon_idx, treecover, value2 FROM grid_static WHERE treecover IS NOT NULL AND value2 IS NOT NULL""",
)
def f12(spark, d):
    return M.drop_null_rows(X.grid_static(spark, d).select(*CELL, "treecover", "value2"), ["treecover", "value2"])
