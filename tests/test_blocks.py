"""The size of the blocks must not change any result."""

import pytest
from pyspark.sql import functions as F

from tests.util import assert_same, keyed
from tickspark.layout import Layout, run_blocked
from tickspark.operators import asof, calendar, classic, denoise, gaps, labels, price, scan, signals, trend, vpin
from tickspark.operators.bars import tick_bars, volume_bars

WIDE = Layout()


@pytest.mark.parametrize("rows", [37, 150])
def test_rolling(gap_rows, rows):
    steps = [
        price.log_return.step(), price.rolling_zscore.step("log_return", 30), price.true_range.step(),
        price.atr.step(14), price.temperature.step(20), trend.pivots.step(2),
        denoise.wavelet_decompose.step("close", 2, "db4"),
    ]
    columns = ["log_return", "log_return_zscore", "atr", "market_temperature", "pivot", "detail_2"]
    a = keyed(run_blocked(gap_rows, steps, Layout(block_rows=rows)), columns)
    assert_same(a, keyed(run_blocked(gap_rows, steps, WIDE), columns))


@pytest.mark.parametrize("rows", [64, 700])
def test_recursive(gap_rows, rows):
    """64 rows are fewer than the memory of the averages, 700 are more: both ways of scanning."""
    narrow = Layout(block_rows=rows)
    specs = [scan.Decay("a", "close", 0.9), classic.wilder("b", "high", 14)]
    a = keyed(scan.decaying_scan(gap_rows, specs, narrow), ["a", "b"])
    assert_same(a, keyed(scan.decaying_scan(gap_rows, specs, WIDE), ["a", "b"]))


def test_kalman(gap_rows):
    a = keyed(denoise.kalman(gap_rows, layout=Layout(block_rows=300)), ["kalman", "kalman_gain"])
    assert_same(a, keyed(denoise.kalman(gap_rows), ["kalman", "kalman_gain"]))


def test_supertrend(gap_rows):
    cfg = trend.SuperTrend(factor=0.5)
    columns = ["tup", "tdown", "st_dir", "trend_duration", "center", "last_pivot_low"]
    a = keyed(trend.pivot_supertrend(gap_rows, cfg, Layout(block_rows=83)), columns)
    assert_same(a, keyed(trend.pivot_supertrend(gap_rows, cfg, WIDE), columns))


def test_classic_supertrend(gap_rows):
    a = keyed(classic.supertrend(gap_rows, 0.5, layout=Layout(block_rows=610)), ["st_dir", "st_line"])
    assert_same(a, keyed(classic.supertrend(gap_rows, 0.5), ["st_dir", "st_line"]))


def test_gaps(gap_rows):
    def run(layout):
        steps = [price.true_range.step(), price.atr.step(14), gaps.detect_fvg.step(5.0)]
        rows = run_blocked(gap_rows, steps, layout)
        return gaps.fvg_event(gaps.fvg_state_features(rows, 40, layout=layout), layout=layout)

    columns = ["active_fvg_count", "fvg_filled_pct", "fvg_event", "fvg_follow_up_3", "fvg_follow_bars"]
    assert_same(keyed(run(Layout(block_rows=71)), columns), keyed(run(WIDE), columns))


def test_sessions_and_buckets(gap_rows):
    def run(layout):
        rows = calendar.session(calendar.calendar(gap_rows))
        rows = calendar.bars_from_session_open(rows, layout)
        return vpin.volume_buckets(rows, 37.0, "volume", layout=layout)

    columns = ["bars_from_session_open", "bucket", "closes_bucket"]
    assert_same(keyed(run(Layout(block_rows=59)), columns), keyed(run(WIDE), columns))


def test_labels(gap_rows):
    def run(layout):
        rows = labels.barrier_vol(gap_rows, 20, layout=layout).withColumn("direction", F.lit(1))
        return labels.triple_barrier(rows, labels.Barriers(vertical=15), layout=layout)

    columns = ["sigma", "barrier_hit", "exit_idx", "return_pct"]
    assert_same(keyed(run(Layout(block_rows=53)), columns), keyed(run(WIDE), columns))


def test_threshold(gap_rows):
    rows = gap_rows.withColumns(
        {"score": (F.col("bar_idx") * 7919) % 1000 / 1000.0, "score_idx": F.col("bar_idx"),
         "market_phase": F.lit("LAMINAR"), "trend_alignment": F.lit("UNKNOWN")}
    )
    cfg = signals.GateConfig(buffer=60, min_required=10, full_buffer=30)
    a = signals.confidence_gate(rows, cfg, layout=Layout(idx="score_idx", block_rows=100))
    b = signals.confidence_gate(rows, cfg)
    assert_same(keyed(a, ["threshold", "gate_stage"]), keyed(b, ["threshold", "gate_stage"]))


@pytest.mark.parametrize("strict", [False, True])
def test_asof_slices_do_not_matter(gap_rows, strict):
    """Short slices leave many of them without a right row, before, between and after."""
    high = gap_rows.filter((F.col("bar_idx") > 100) & (F.col("bar_idx") < 900) & (F.col("bar_idx") % 97 == 0)).select(
        "symbol", F.col("open_time").alias("t"), F.col("bar_idx").alias("from_idx")
    )

    def run(seconds):
        return keyed(asof.asof_join(gap_rows, high, "open_time", "t", ["from_idx"], slice_seconds=seconds, strict=strict), ["from_idx"])

    out = run(3600)
    assert_same(out, run(400 * 86_400))
    last = (out["bar_idx"] - 1 if strict else out["bar_idx"]) // 97 * 97
    expected = last.clip(upper=873).where(last >= 194)
    assert_same(out[["from_idx"]].astype(float), expected.astype(float).to_frame("from_idx"))


def test_time_slices_do_not_matter(spark):
    from catalog.base import ticks
    from tests.conftest import SF

    columns = ["open", "close", "high", "buy_count", "sell_count", "tick_count", "duration_ms"]
    t = ticks(spark, SF)
    a = keyed(tick_bars(t, 7, slice_seconds=600), columns)
    assert_same(a, keyed(tick_bars(t, 7, slice_seconds=40 * 86_400), columns))


def test_volume_bars(spark):
    from catalog.base import ticks
    from tests.conftest import SF

    t = ticks(spark, SF)
    narrow = Layout(idx="row_idx", block_rows=130)
    columns = ["open", "close", "volume", "tick_count", "buy_count"]
    a = keyed(volume_bars(t, 61.0, "real", layout=narrow), columns)
    assert_same(a, keyed(volume_bars(t, 61.0, "real"), columns))
