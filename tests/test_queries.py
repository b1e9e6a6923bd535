"""Registered queries against their SQL. All of them with BARLOOM_ALL=1."""

import os

import pytest
from oracle import compare, connect

from barloom.plans import registry

SF = "/root/testdata/sf0.01"
QUICK = ("panel_history_lookback", "series_resolved", "panel_coverage", "panel_full_matrix", "stage0_exclusions", "adjusted_bars", "ind_moving_averages",
         "ind_adx", "ind_aroon", "ind_parabolic_sar", "ind_compressed", "outcome_lattice", "simulated_trades", "market_regime", "walked_spread",
         "false_discovery", "trailing_twelve", "vertical_spreads", "cross_source_buckets", "action_subjects", "xbrl_ingest", "event_windows", "story_groups")
ALL = registry.load_all()
NAMES = [n for n, q in ALL.items() if q.sql and (os.environ.get("BARLOOM_ALL") or n in QUICK)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    ok, msg = compare(ALL[name].run(spark, SF), con, ALL[name].sql)
    assert ok, msg


def test_streams_have_their_rows(spark):
    assert ALL["stream_session_bars"].run(spark, SF).count() > 0
