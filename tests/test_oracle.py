"""Registered queries against their SQL twins at the smallest scale.

A spread of queries by default; set ``FIREGRID_ALL=1`` for all of them.
"""

import os

import pytest

from check_oracle import compare, connect
from firegrid.plans import catalog

DATA = os.environ.get("FIREGRID_DATA", "/root/testdata/sf0.001")
SOME = (
    "fri_class_shares d1_fri d2_fri_forest_weighted d5_risk_class d7_attributed_loss f13_polygon_mask g4_conservative_second g3_bilinear_globe f17_scene_dedup j5_cells_near_points "
    "a15_weighted_quantiles a24_percentiles g4_conservative t1_theil_sen t2_spearman t6_fdr_bh t7_chow_test d13_score_events w13_group_events l8_trend_scenario s9_resume_bands "
    "d13_score_forms d11_disturbance_series j2_reindex_nearest d8_forest_mask r10_pivot_series a26_categorical_density s2_read_multi w9_whole_table_rank a22_accuracy_table "
    "l2_hash_split j6_nearest_site j6_nearest_site_descent u1_stack_time j14_match_years a7_burned_fraction w1_moving_mean w6_moving_sum_wide w1_moving_mean_wide e2_season_trends "
    "l3_quantile_uniform l7_permuted_rows l7_cover_importance"
).split()
NAMES = sorted(catalog.ORACLES) if os.environ.get("FIREGRID_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert compare(got, con.execute(catalog.ORACLES[name]).df()) == "ok"


def test_every_query_runs_lazily_named():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(set(catalog.QUERIES) - set(catalog.ORACLES)) <= 6
