"""Registered queries against their SQL twins on small made tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from check_oracle import compare
from firegrid.grid import GridSpec
from firegrid.operators import masks as M
from firegrid.operators import sites as St
from firegrid.plans import catalog
from firegrid.sources import sinks as K


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Writes tables (rows, schema) and compares a query with its SQL on them."""

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert compare(got, con.execute(catalog.ORACLES[name]).df()) == "ok" and len(got)

    return check


SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
NATION = "n_nationkey int, n_name string, n_regionkey int"


def test_polygon_edges_of_more_than_half_the_globe(same_as_sql):
    # keys 0 and 111 lie 188 degrees apart, 5 and 111 180
    keys = [0, 111, 40, 5, 223, 17]
    same_as_sql("f13_polygon_mask", supplier=([(k, f"s{k}", k % 3, 1.0) for k in keys], SUPPLIER), nation=([(n, f"n{n}", 1) for n in range(3)], NATION))


def test_polygon_edge_next_to_a_centre(spark):
    g = GridSpec(40.0, -10.0, 1.5, 5.0, 20, 40)
    # edges a rounding error beside a column of centres
    x = 5.000000000000001
    v = spark.createDataFrame([(1, 0, k, a, b) for k, (a, b) in enumerate([(x, 40.5), (62.0, 40.5), (62.0, 50.0), (x, 50.0)])], "poly_id int, ring int, seq int, lon double, lat double")
    got = {r.lon_idx for r in M.polygon_cells(v, g, shorter=False).collect()}
    assert got == {j for j in range(40) if not (-10.0 + j * 5.0) < x and (-10.0 + j * 5.0) < 62.0}


LINEITEM = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_tax double, l_discount double, l_shipdate date"


def _lines(n, keys=lambda k: (k, k)):
    days = [dt.date(1995, 1, 2) + dt.timedelta(days=37 * k) for k in range(20)] + [None]
    return [(*keys(k), k % 7, None if k % 11 == 0 else float(1 + k % 50), 0.01 * (k % 9), 0.0, days[k % 21]) for k in range(n)]


def test_series_of_repeated_sites_and_rows_without_a_date(same_as_sql):
    suppliers = [(k, f"s{k}", k % 3, 1.0) for k in (1, 1, 2, 31, 40)]
    # rows of the cells that these sites lie in: south row 1, 28, 7; their columns
    cells = [(1, 0), (1, 1), (1, 11), (7, 14)]
    same_as_sql("d18_extract_series", supplier=(suppliers, SUPPLIER), lineitem=(_lines(900, lambda k: cells[k % 4]), LINEITEM))


def test_series_meet_sites_as_cells_of_a_step(spark):
    sites = spark.range(300).select(F.col("id").alias("site"), F.lit(40.0).alias("lat"), F.lit(-10.0).alias("lon"))
    df = spark.range(400).selectExpr("0 AS lat_idx", "0 AS lon_idx", "timestamp'2001-01-05' + make_interval(0, id % 3) AS t", "double(id) AS value")
    out = St.extract_series(df, sites, GridSpec(40.0, -10.0, 1.5, 5.0, 20, 40))
    for step, cells in (("monthly", 3), ("annual", 1)):
        got = out[step]
        assert {r.n_rows for r in got.collect()} <= {400, 134, 133} and got.count() == 300 * cells
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        join = plan[plan.index("Join"):]
        assert "Aggregate" in join, "the raster is joined row by row"


def test_bands_are_written_where_their_rows_are(spark, tmp_path):
    path = str(tmp_path / "bands")
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 4 < 3, F.col("id") % 4).cast("int").alias("lat_band"), "id")
    K.write_pending(rows.where("lat_band < 2"), path)
    K.write_pending(rows, path)
    K.write_pending(rows, path)
    got = spark.read.parquet(path).withColumn("file", F.input_file_name())
    bands = {r.lat_band: (r.n, r.ids, r.files) for r in got.groupBy("lat_band").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("file").alias("files")).collect()}
    # no task gathers a band: each of the eight writes its own rows, once, those without a band too
    assert bands == {b: (1000, 1000, 8) for b in (0, 1, 2, None)}
