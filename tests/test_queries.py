"""Registered queries against their SQL at sf0.01.

A selection by default; ``TICKSPARK_ALL=1`` checks every query.
"""

import os

import pytest

import __spark_entry__ as entry_points
from catalog.all import REGISTRY
from tests.conftest import SF
from tests.oracle import check, connect

SELECTED = [
    "S1_read_ticks", "S2_parse_ts", "C5_drop_outliers", "C13_feed_integrity", "B1_tick_bars",
    "B2_volume_bars", "B10_multi_timeframe", "J1_asof_join", "J4_event_window", "A3_exact_percentiles",
    "F2_rolling_zscore", "F10_micro_volatility", "F18_vpin", "F36_pivot_supertrend_short_bars",
    "G3_fvg_state_features", "G6_fvg_follow", "N1_kalman", "N3_wavelet_denoise", "I2_dmi",
    "L1_triple_barrier", "L12_sequences", "P1_primary_signals", "P10_confidence_gate", "V4_cpcv",
    "V7_ranking_metrics", "V15_run_signals", "R8_risk_breaches", "R14_staged_exits", "X1_stream_bars",
    "X3_stream_features",
]
NAMES = list(REGISTRY) if os.environ.get("TICKSPARK_ALL") else SELECTED


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, rows, _ = check(spark, con, SF, name)
    assert verdict in ("ok", "no-sql"), verdict
    assert rows > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and df.columns[0] == "symbol"
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
