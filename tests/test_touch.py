"""First touch over the tree of extremes, gap fills of any age, and noise levels so far."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark.operators import denoise, gaps
from tickspark.operators.touch import first_touch


def brute(levels, bars, max_age):
    out = []
    for row in levels.itertuples():
        after = bars[(bars.symbol == row.symbol) & (bars.bar_idx > row.gap_idx)].sort_values("bar_idx")
        if max_age is not None:
            after = after[after.bar_idx - row.gap_idx <= max_age]
        hit = after[after.low <= row.level] if row.side == 1 else after[after.high >= row.level]
        out.append(None if hit.empty else int(hit.bar_idx.iloc[0]))
    return out


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    parts = []
    for symbol, n in (("A", 700), ("B", 90)):
        mid = 100 + rng.normal(0, 1, n).cumsum()
        idx = np.arange(n) if symbol == "A" else np.sort(rng.choice(400, n, replace=False))
        parts.append(pd.DataFrame({"symbol": symbol, "bar_idx": idx, "low": mid - 0.5, "high": mid + 0.5}))
    bars = pd.concat(parts, ignore_index=True)
    picks = bars.sample(250, random_state=1)
    levels = pd.DataFrame({
        "id": range(len(picks)), "symbol": picks.symbol.to_numpy(), "gap_idx": picks.bar_idx.to_numpy(),
        "side": rng.choice([1, -1], len(picks)),
        "level": (picks.low + rng.choice([-30, -5, -1, 0, 1, 5, 30], len(picks))).to_numpy(),
    })
    return levels, bars


@pytest.mark.parametrize("fan,max_age", [(8, None), (8, 1), (8, 40), (4, 200), (1024, 99)])
def test_first_touch(spark, series, fan, max_age):
    levels, bars = series
    # Four levels of eight rows span 4096 bars, four of four only 256, enough for 200.
    got = first_touch(
        spark.createDataFrame(levels), spark.createDataFrame(bars), max_age=max_age, fan=fan
    ).orderBy("id").select("touch_idx").collect()
    assert [r[0] for r in got] == brute(levels, bars, max_age)


def test_first_touch_odd_rows(spark):
    bars = spark.createDataFrame(
        [("A", 0, 1.0, 2.0), ("A", 1, None, None), ("A", 2, 0.5, 9.0), ("A", 2, 0.5, 9.0)],
        "symbol string, bar_idx long, low double, high double",
    )
    levels = spark.createDataFrame(
        [(0, "A", 0, 1, 0.5), (1, "A", 0, 1, None), (2, "A", None, 1, 0.5), (3, "Z", 0, 1, 0.5),
         (4, "A", 2, -1, 1.0), (5, "A", -1, -1, 2.0), (6, None, 0, 1, 0.5), (0, "A", 0, 1, 0.5)],
        "id int, symbol string, gap_idx long, side int, level double",
    ).withColumns({"low": F.lit("own"), "_extra": F.lit(1)})
    got = sorted((r["id"], r["touch_idx"], r["low"]) for r in first_touch(levels, bars).collect())
    want = [2, 2, None, None, None, None, 0, None]
    assert got == [(i, t, "own") for i, t in zip([0, 0, 1, 2, 3, 4, 5, 6], want)]
    assert first_touch(levels, bars.limit(0)).filter("touch_idx is not null").count() == 0
    assert first_touch(levels.limit(0), bars).count() == 0


def test_fill_ages(spark, gap_rows):
    found = gaps.detect_fvg(gap_rows, 5.0)
    short, ever = gaps.fvg_fill(found, 40), gaps.fvg_fill(found, None)
    both = short.alias("a").join(ever.alias("b"), ["symbol", "gap_idx"])
    assert short.count() == ever.count() == both.count()
    late = F.col("b.fill_idx") - F.col("gap_idx") > 39
    assert both.filter(~late & ~F.col("a.fill_idx").eqNullSafe(F.col("b.fill_idx"))).count() == 0
    assert both.filter(late & F.col("a.fill_idx").isNotNull()).count() == 0
    assert both.filter(late).count() > 0
    with pytest.raises(ValueError):
        gaps.fvg_fill(found, 0)


def test_running_deviation():
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=200).tolist(), rng.integers(0, 4, 200).astype(float).tolist(), [1.0] * 9):
        state = denoise.RunningDeviation()
        for n in range(1, len(values) + 1):
            head = np.array(values[:n])
            want = np.median(np.abs(head - np.median(head))) / denoise.MAD_UNIT
            assert state.step(values[n - 1]) == pytest.approx(want, abs=1e-12)
    state = denoise.RunningDeviation()
    assert np.isnan(state.step(None)) and state.step(2.0) == 0.0 and state.step(float("nan")) == 0.0
    assert state.rows == 3


def test_later_bars_change_nothing(spark, bar_rows):
    cut = 60
    early = F.col("bar_idx") < cut
    changed = bar_rows.withColumn("close", F.when(early, F.col("close")).otherwise(F.col("close") * 3))
    seen = []
    for df in (bar_rows, changed):
        out = denoise.wavelet_denoise(df, period_seconds=10 * 86_400).filter(early)
        seen.append(out.select("symbol", "bar_idx", "denoised").toPandas().sort_values(["symbol", "bar_idx"]))
    assert len(seen[0]) > 0 and np.array_equal(seen[0].denoised, seen[1].denoised, equal_nan=True)
