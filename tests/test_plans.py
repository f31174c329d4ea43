"""Physical plans: pruning and pushdown reach the scan, exchanges stay few, nothing is paired with everything."""

import re

import pytest
from pyspark.sql import functions as F

from firegrid.grid import CELL, GridSpec
from firegrid.operators import masks as M
from firegrid.operators import model as L
from firegrid.operators import ordered as O
from firegrid.operators import trend as T
from firegrid.operators import windows as W
from firegrid.plans import catalog
from firegrid.plans import fire as P

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid") / "obs")
    g = GridSpec(40, 0, 1, 1, 20, 20)
    rows = g.lattice(spark).withColumns({"year": F.lit(2001), "v": F.rand(1), "unused": F.lit("x"), "land": F.lit(True)})
    rows.write.parquet(path)
    return g, path


def test_bbox_reaches_the_scan(spark, stored):
    g, path = stored
    p = details(M.bbox(spark.read.parquet(path), 2, 5, 45, 50, g).groupBy("lat_idx").agg(F.sum("v")))
    assert "GreaterThanOrEqual(lat_idx,5)" in p and "LessThanOrEqual(lon_idx,5)" in p
    assert "unused" not in p.split("ReadSchema")[1]


def test_interval_map_exchanges(spark, stored):
    g, path = stored
    df = spark.read.parquet(path)
    out = P.fri(df.select(*CELL, F.col("v").alias("AnBF")), df.select(*CELL, "land"), g, 3.0)
    # rows to columns and back: one exchange per axis, whatever is smoothed; the join may add two
    assert exchanges(out) <= 4
    assert exchanges(W.moving_mean(df, ["v", "year"], 5)) == 2


def test_one_exchange_for_regressions(spark, stored):
    _, path = stored
    df = spark.read.parquet(path)
    assert exchanges(T.ols(df, CELL, "year", "v")) == 1
    assert exchanges(W.trend_grid(df, "v", (5, 10, 15, 20), (1960, 1980, 1999))) == 1


def test_series_of_aggregated_input_adds_no_exchange(spark, stored):
    _, path = stored
    df = spark.read.parquet(path).groupBy(*CELL, "year").agg(F.avg("v").alias("v"))
    assert exchanges(T.theil_sen(df, CELL, "year", "v")) == 2


def test_reject_flag_does_not_shuffle_the_table(spark, stored):
    _, path = stored
    df = spark.read.parquet(path).withColumnRenamed("v", "p")
    p = plan(O.reject_p(df, "p"))
    assert "SortMergeJoin" not in p.split("BroadcastExchange")[0]


def test_importance_is_one_exchange_for_all_runs(spark, stored):
    _, path = stored
    df = spark.read.parquet(path).withColumn("y", F.col("v") * 2)
    m = L.fit_models(df, ["v"], "y", ["linear"])["linear"]
    few = exchanges(L.permutation_importance(m, df, ["v"], "y", "pred_linear", 1))
    many = exchanges(L.permutation_importance(m, df, ["v"], "y", "pred_linear", 9))
    assert few == many


@pytest.mark.parametrize(
    "name", ["fri_class_shares", "d5_risk_class", "a5_season_dec_shift", "t3_ols", "t6_fdr_bh", "f17_scene_dedup", "w13_group_events", "d13_score_events", "j5_cells_near_points"]
)
def test_no_python_and_no_products(spark, name):
    p = plan(catalog.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "Python" not in p and "Pandas" not in p
