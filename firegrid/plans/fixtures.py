"""The driver's tables read as gridded products, sites and scenes.

Every view is a projection of whole tables; the matching DuckDB text sits next to it
so both sides of a check start from the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec
from firegrid.operators.aggregate import annual_any, annual_burned_fraction
from firegrid.operators.reshape import densify

G = GridSpec(40.0, -10.0, 1.5, 5.0, 20, 40)
YEARS = tuple(range(1995, 2002))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid_obs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 20).cast("int").alias("lat_idx"),
        (F.col("l_partkey") % 40).cast("int").alias("lon_idx"),
        F.col("l_shipdate").cast("timestamp").alias("t"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("l_quantity").alias("value"),
        ((F.col("l_quantity") == 50) & (F.round("l_tax", 2) >= 0.08)).alias("burnt"),
        F.col("l_discount").alias("disc"),
        F.col("l_linenumber").alias("line"),
    )


def cells(spark) -> DataFrame:
    return G.lattice(spark)


def grid_year(spark, d) -> DataFrame:
    """Dense cell-years with burned 0/1."""
    flags = annual_any(grid_obs(spark, d), "burnt")
    dense = densify(flags, cells(spark), YEARS)
    return dense.select(*CELL, "year", F.coalesce(F.col("burnt").cast("int"), F.lit(0)).alias("burnt"))


def anbf(spark, d) -> DataFrame:
    """Burned fraction of every cell: sparse aggregate, then the lattice."""
    frac = annual_burned_fraction(grid_obs(spark, d), len(YEARS))
    return cells(spark).join(frac, list(CELL), "left").na.fill(0.0, ["AnBF"])


def grid_static(spark, d) -> DataFrame:
    """Static layers, from all parts that fall on a cell."""
    part = (
        table(spark, d, "part")
        .groupBy(F.expr("CAST(p_partkey % 800 DIV 40 AS INT)").alias("lat_idx"), F.expr("CAST(p_partkey % 40 AS INT)").alias("lon_idx"))
        .agg((F.sum("p_size") % 50 + 1).cast("int").alias("size"), F.max("p_type").alias("landcover"), F.round(F.avg("p_retailprice"), 4).alias("value2"))
        .select(*CELL, (F.col("size") * 2.0).alias("treecover"), "landcover", "value2", "size", (F.col("size") % 7 != 0).alias("land"))
    )
    return cells(spark).join(part, list(CELL), "left")


def cell_year_value(spark, d) -> DataFrame:
    """One mean value per cell and year, present years only."""
    return grid_obs(spark, d).groupBy(*CELL, "year").agg(F.avg("value").alias("value"))


def climate(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % 20).cast("int").alias("lat_idx"),
        (F.col("o_custkey") % 40).cast("int").alias("lon_idx"),
        F.col("o_orderdate").cast("timestamp").alias("t"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        (F.col("o_totalprice") / 1000.0).alias("ppt"),
        (F.col("o_custkey") % 50 - 20.0).alias("tmean"),
    )


def site(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("site"),
        F.col("s_name").alias("name"),
        (F.lit(40.0) + F.col("s_suppkey") % 30 + F.col("s_nationkey") / 100.0).alias("lat"),
        ((F.col("s_suppkey") * 1.7) % 190.0 - 10.0).alias("lon"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("acctbal"),
    )


def detections(spark, d) -> DataFrame:
    """Fire detections: customers as points with confidence and year."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("fire_id"),
        (F.lit(40.0) + (F.col("c_custkey") * 7 % 2850) / 100.0).alias("lat"),
        ((F.col("c_custkey") * 13 % 19000) / 100.0 - 10.0).alias("lon"),
        (F.col("c_custkey") % 101).cast("int").alias("confidence"),
        (F.lit(1995) + F.col("c_nationkey") % 7).cast("int").alias("year"),
    )


def site_series(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("site"), F.dayofmonth("ts").alias("step")).agg(F.max("value").alias("value"))


def event_form(spark, d) -> DataFrame:
    """Observer forms: one row per reported event."""
    e = table(spark, d, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return e.select(
        F.col("user_id").alias("site"),
        (F.col("event_id") % 4).cast("int").alias("observer"),
        k.alias("frame"),
        F.to_date("ts").alias("date"),
        (F.col("event_type") == "error").cast("int").alias("is_fire"),
        (F.col("event_id") % 3 != 0).cast("int").alias("site_impacted"),
        (F.col("event_id") % 5 == 0).cast("int").alias("stand_rep"),
        F.col("event_id"),
    )


def ref_events(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_custkey") % 150).alias("site"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderstatus") == "F").alias("fire"),
        F.col("o_orderkey"),
        F.col("o_custkey"),
    )


def scene_pixels(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("scene"), F.col("label"), F.posexplode("embedding").alias("band", "value")).select(
        "scene", "label", "band", F.col("value").cast("double").alias("value")
    )


def image_pixels(spark, d) -> DataFrame:
    """The same vectors as 8 x 8 images of one band, dark values missing."""
    return scene_pixels(spark, d).select(
        "scene",
        "label",
        F.expr("CAST(band DIV 8 AS INT)").alias("lat_idx"),
        F.expr("CAST(band % 8 AS INT)").alias("lon_idx"),
        F.when(F.col("value") >= -0.1, F.col("value")).alias("value"),
    )


CTES = {
    "grid_obs": """grid_obs AS (SELECT CAST(l_orderkey % 20 AS INTEGER) AS lat_idx, CAST(l_partkey % 40 AS INTEGER) AS lon_idx,
        l_shipdate AS t, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        l_quantity AS value, (l_quantity = 50 AND round(l_tax, 2) >= 0.08e0) AS burnt, l_discount AS disc, l_linenumber AS line FROM lineitem)""",
    "cells": """cells AS (SELECT CAST(a.i AS INTEGER) AS lat_idx, CAST(b.j AS INTEGER) AS lon_idx FROM range(20) a(i), range(40) b(j))""",
    "grid_year": """burned AS (SELECT DISTINCT lat_idx, lon_idx, year FROM grid_obs WHERE burnt),
      grid_year AS (SELECT c.lat_idx, c.lon_idx, CAST(y.y AS INTEGER) AS year, CASE WHEN b.year IS NULL THEN 0 ELSE 1 END AS burnt
        FROM cells c CROSS JOIN range(1995, 2002) y(y)
        LEFT JOIN burned b ON b.lat_idx = c.lat_idx AND b.lon_idx = c.lon_idx AND b.year = y.y)""",
    "anbf": """anbf AS (SELECT lat_idx, lon_idx, avg(burnt) AS "AnBF" FROM grid_year GROUP BY ALL)""",
    "grid_static": """parts AS (SELECT CAST(p_partkey % 800 // 40 AS INTEGER) AS lat_idx, CAST(p_partkey % 40 AS INTEGER) AS lon_idx,
        CAST(sum(p_size) % 50 + 1 AS INTEGER) AS size, max(p_type) AS landcover, round(avg(p_retailprice), 4) AS value2 FROM part GROUP BY ALL),
      grid_static AS (SELECT c.lat_idx, c.lon_idx, size * 2.0e0 AS treecover, landcover, value2, size, (size % 7 <> 0) AS land
        FROM cells c LEFT JOIN parts USING (lat_idx, lon_idx))""",
    "cell_year_value": """cell_year_value AS (SELECT lat_idx, lon_idx, year, avg(value) AS value FROM grid_obs GROUP BY ALL)""",
    "climate": """climate AS (SELECT CAST(o_orderkey % 20 AS INTEGER) AS lat_idx, CAST(o_custkey % 40 AS INTEGER) AS lon_idx, o_orderdate AS t,
        CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice / 1000.0e0 AS ppt,
        CAST(o_custkey % 50 AS DOUBLE) - 20.0e0 AS tmean FROM orders)""",
    "site": """site AS (SELECT s_suppkey AS site, s_name AS name, 40.0e0 + s_suppkey % 30 + s_nationkey / 100.0e0 AS lat,
        (s_suppkey * 1.7e0) % 190.0e0 - 10.0e0 AS lon, s_nationkey AS nation, s_acctbal AS acctbal FROM supplier)""",
    "detections": """detections AS (SELECT c_custkey AS fire_id, 40.0e0 + (c_custkey * 7 % 2850) / 100.0e0 AS lat,
        (c_custkey * 13 % 19000) / 100.0e0 - 10.0e0 AS lon, CAST(c_custkey % 101 AS INTEGER) AS confidence,
        CAST(1995 + c_nationkey % 7 AS INTEGER) AS year FROM customer)""",
    "site_series": """site_series AS (SELECT user_id AS site, CAST(day(ts) AS INTEGER) AS step, max(value) AS value FROM events GROUP BY ALL)""",
    "event_form": """event_form AS (SELECT user_id AS site, CAST(event_id % 4 AS INTEGER) AS observer,
        CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS frame, CAST(ts AS DATE) AS date,
        CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fire, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS site_impacted,
        CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS stand_rep, event_id FROM events)""",
    "ref_events": """ref_events AS (SELECT o_custkey % 150 AS site, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus = 'F' AS fire,
        o_orderkey, o_custkey FROM orders)""",
    "scene_pixels": """scene_pixels AS (SELECT vec_id AS scene, label, CAST(i AS INTEGER) AS band, CAST(embedding[i + 1] AS DOUBLE) AS value
        FROM embeddings, range(64) r(i) WHERE i < len(embedding))""",
    "image_pixels": """image_pixels AS (SELECT scene, label, CAST(band // 8 AS INTEGER) AS lat_idx, CAST(band % 8 AS INTEGER) AS lon_idx,
        CASE WHEN value >= -0.1e0 THEN value END AS value FROM scene_pixels)""",
}
_NEEDS = {
    "grid_year": ("grid_obs", "cells"),
    "anbf": ("grid_obs", "cells", "grid_year"),
    "grid_static": ("cells",),
    "cell_year_value": ("grid_obs",),
    "image_pixels": ("scene_pixels",),
}


def ctes(*names: str) -> str:
    """WITH clause holding the named views and what they build on."""
    order: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    return "WITH RECURSIVE " + ",\n ".join(CTES[n] for n in order)
