"""Every worked query beside its SQL on the smallest tables, and once more with every group treated as hot."""

import pytest

import __spark_entry__ as entry
from workbook import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, msg, _, rows = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, msg
    if name not in ORACLES:
        assert rows > 0


HOT = ["fill_group_mean", "trim_outliers", "encode_codes", "parent_to_children", "group_total", "group_flags", "concentration_curve", "rank_within",
       "add_lags", "linear_trend", "impute_simple", "reconciled_turnover", "allocation_chain", "industry_cost_control", "hot_deck", "hot_deck_k",
       "split_stratified", "regression_metrics", "feature_scaling", "rescale_to_parent"]


@pytest.mark.parametrize("name", HOT)
def test_query_with_hot_groups(spark, con, name):
    """The largest groups go through aggregation, slices and position joins instead of windows."""
    spark.conf.set("tallyloom.hotRows", "2")
    try:
        ok, msg, _, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    finally:
        spark.conf.unset("tallyloom.hotRows")
    assert ok, msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
