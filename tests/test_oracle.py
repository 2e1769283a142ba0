"""Queries against their SQL twins; TRIALWEAVE_ALL=1 runs every one (slow)."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUICK = [
    "template_decode", "template_decode_scaled", "context_transfer", "split_half_similarity", "bh_fdr_by_family", "describe_cells", "rising_edges", "join_interval_frames",
    "join_radius_mm", "frame_edges", "rdm_correlation", "sign_flip_exact", "scan_trial_metadata", "sink_nested_json", "tied_rank",
    "ols_ranked", "subset_reliability",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TRIALWEAVE_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert oracle.compare(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


def test_registry_is_whole():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(set(entry.queries()) - set(entry.EXTRA)) == 194
