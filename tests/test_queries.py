"""A cross-section of registered queries against their SQL twins; all of them run
with ``python -m tests.harness``."""

import pytest

import __spark_entry__ as entry_point
from tests.harness import SF_DIR, compare, connect

KEYS = ["W01_returns", "W06_macd_histogram", "W17_regularised_bars", "J03_forward_asof_maturity", "T06_greedy_spacing", "A07_horizon_summary",
        "A19_robust_scaler", "M25_lexical_retrieval", "F20_decision_gate", "M27_ledger_replay", "P05_recent_news", "M23_decision_memory"]


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, key):
    problem, rows = compare(entry_point.queries()[key](spark, SF_DIR), connect(), entry_point.oracle_sql()[key])
    assert problem is None and rows > 0


def test_every_key_is_known_and_entry_runs(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() > 0
