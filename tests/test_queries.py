"""Every query against its SQL, and the driver's entry."""

from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from lagweave.checks import oracle
from lagweave.checks import queries as catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# At this scale some panels have odd degrees of freedom (no finite sum for the tail) or other row counts than the SQL's.
SMALL = ["panel_wide_events", "panel_wide_shipments", "time_index", "time_index_grouped", "calendar_month_end", "lag_chunked", "lag_grouped",
         "slice_last_p", "structural_mean_nonlinear2", "csv_header_roundtrip", "moment_matrix", "boost_chain_shrunk", "chain_f_test",
         "test_plan", "incremental_merged", "incremental_from_state", "incremental_stored", "tree_round", "causality_graph_tree", "var_summary", "forecast_bands", "granger_pairs_grouped"]


@needs_data
@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, con, name):
    problem, rows = difference(spark, con, driver.queries()[name], driver.oracle_sql()[name], SF)
    assert problem is None, problem
    assert rows > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.all_sql())


@needs_data
def test_entry(spark):
    assert driver.entry(spark).count() == 120
