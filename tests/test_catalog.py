"""Registered queries against their SQL checks on the smallest data.

All of them with CHAINSIEVE_ALL=1; otherwise one or more of each family.
"""

import os

import pytest
from comparing import difference, duck
from conftest import TINY

from __spark_entry__ import entry, oracle_sql, queries

SOME = [
    "fifo_match", "fifo_match_compat", "fifo_match_prior_buy", "win_rate", "performance_metrics", "behavior_patterns", "rank_wallets_per_chain", "find_smart_wallets", "timing_signals",
    "next_extremum", "price_near", "fund_flow_bfs", "fund_flow_clusters", "clustering_coefficient", "temporal_correlation", "swaps_from_transfers", "token_trades_from_tx", "normalize_timestamp",
    "holder_stats", "time_window_agg", "features_as_of", "rate_excess", "sentiment", "contract_risk", "outcome_labels", "exit_rule", "hit_rates", "auc_roc", "classification_metrics",
    "walk_forward_eval", "index_splits_sliding", "ensemble_weights", "ks_distance", "drift_report", "page_hinkley", "pair_signals_with_costs", "compare_versions", "timelines", "alert_matches",
    "live_wallet_signals", "session_windows", "calibration_platt",
]


@pytest.fixture(scope="module")
def con():
    return duck(TINY)


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("CHAINSIEVE_ALL") else SOME)
def test_query_equals_check(spark, con, name):
    assert difference(spark, name, queries()[name], oracle_sql().get(name), TINY, con) is None


def test_entry_has_a_stable_schema(spark):
    assert entry(spark).schema == entry(spark).schema


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
