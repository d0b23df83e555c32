"""A few registered queries against their SQL on the smallest tables; all of them: tests/oracle.py."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_within_stratum", "l15_tier2_densities", "d2_block_explode", "w1_reasoning_attribution", "w8_retry_count",
         "a6_outcome_summary", "t8_partial_spearman_strata", "b1_stratified_permutation", "g8_gate_metrics", "q2_cross_reference"]


def test_registry_needs_no_session_and_covers_oracles():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 170


def test_stages_are_released(spark, tmp_path):
    from tracelens.session import materialize, release

    release(spark)
    stage = materialize(spark.range(5))
    assert stage.count() == 5 and release(spark) == 1 and release(spark) == 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = connect(SF)
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None
