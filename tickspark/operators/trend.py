"""Pivots, pivot SuperTrend and its features, for bars of any timeframe."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.layout import BARS, Layout, run_blocked, windowed
from tickspark.operators import price
from tickspark.operators.bars import with_prev_close
from tickspark.operators.scan import (
    Kernel, LastKnown, PivotCenter, Ratchet, TrendState, block_scan,
)

EPSILON = 1e-10
#: Weight kept by the pivot centre at each update: (2 * centre + pivot) / 3.
CENTER_KEEP = 2.0 / 3.0


@dataclass(frozen=True)
class SuperTrend:
    """Parameters of the pivot SuperTrend."""

    lookback: int = 2
    atr_rows: int = 10
    factor: float = 3.0
    center_update: str = "every_bar"  #: or ``on_pivot``


@windowed(lookback=lambda k=2: 2 * k)
def pivots(df: DataFrame, w, k: int = 2) -> DataFrame:
    """Strict local extremes of ``k`` rows on both sides, reported ``k`` rows later."""
    left, right = w.rowsBetween(-2 * k, -k - 1), w.rowsBetween(1 - k, 0)
    high, low = F.lag("high", k).over(w), F.lag("low", k).over(w)
    known = F.count(F.lit(1)).over(left) == k
    is_high = known & (high > F.max("high").over(left)) & (high > F.max("high").over(right))
    is_low = known & (low < F.min("low").over(left)) & (low < F.min("low").over(right))
    marked = df.withColumns(
        {"pivot_high": F.when(is_high, high), "pivot_low": F.when(is_low, low)}
    )
    return marked.withColumn("pivot", F.coalesce("pivot_low", "pivot_high"))


def _center_stage(center_update: str) -> list[Kernel]:
    return [
        PivotCenter("pivot", "last_pivot", "center", CENTER_KEEP, center_update == "every_bar"),
        LastKnown({"pivot_high": "last_pivot_high", "pivot_low": "last_pivot_low"}),
    ]


def pivot_center(df: DataFrame, center_update: str = "every_bar", layout: Layout = BARS) -> DataFrame:
    """Carry the last pivots forward and average them into the centre line."""
    return block_scan(df, _center_stage(center_update), layout=layout)


def band_stage(hold_on_equal: bool) -> list[Kernel]:
    """Ratchet ``raw_up`` and ``raw_dn`` into the trailing bands ``tup`` and ``tdown``."""
    return [
        Ratchet("raw_up", "prev_close", "tup", False, hold_on_equal),
        Ratchet("raw_dn", "prev_close", "tdown", True, hold_on_equal),
    ]


def supertrend_stages(cfg: SuperTrend, idx: str = "bar_idx") -> list:
    """Stages of the SuperTrend on rows with ``prev_close``, ``st_atr``, the pivots and prices."""
    def raw_bands(rows):
        width = (cfg.factor * rows["st_atr"]).where(rows["st_atr"] > 0)
        return {"raw_up": rows["center"] - width, "raw_dn": rows["center"] + width}

    def signal(rows):
        close, banded = rows["close"], rows["raw_up"].notna()
        choices = [close > rows["tdown_before"], close < rows["tup_before"], rows["tup_before"].isna()]
        found = np.select([c & banded for c in choices], [1.0, -1.0, 1.0], default=np.nan)
        return {"_signal": found}

    return [
        _center_stage(cfg.center_update), raw_bands, band_stage(False), signal,
        TrendState("_signal", idx, "st_dir", "trend_duration"),
    ]


def pivot_supertrend(df: DataFrame, cfg: SuperTrend = SuperTrend(), layout: Layout = BARS) -> DataFrame:
    """SuperTrend around the pivot centre.

    Adds ``st_dir`` (1, -1, 0 before the first band), ``st_line``, ``trend_duration``,
    ``st_atr``, ``st_bandwidth`` and the last pivots.
    """
    steps = [
        with_prev_close.step(), price.true_range.step(),
        price.atr.step(cfg.atr_rows, out="st_atr"), pivots.step(cfg.lookback),
    ]
    out = block_scan(run_blocked(df, steps, layout), *supertrend_stages(cfg, layout.idx), layout=layout)
    factor = cfg.factor
    line = (
        F.when(F.col("st_dir") == 1, F.col("tup")).when(F.col("st_dir") == -1, F.col("tdown"))
        .otherwise(F.coalesce("center", F.lit(0.0)))
    )
    width = 2 * factor * F.col("st_atr")
    return out.withColumns(
        {"st_line": line, "st_bandwidth": width, "st_bandwidth_pct": F.try_divide(width, F.col("close"))}
    ).drop("tup_before", "tdown_before", "pivot")


@windowed(lookback=1)
def supertrend_features(df: DataFrame, w, suffix: str = "") -> DataFrame:
    """Trend, distance, bars since flip, slope and bandwidth from :func:`pivot_supertrend`."""
    unit = F.greatest(F.col("st_atr"), F.lit(EPSILON))
    distance = F.when(F.col("st_line") > 0, (F.col("close") - F.col("st_line")) / unit)
    slope = (F.col("st_line") - F.lag("st_line").over(w)) / unit
    return df.withColumns(
        {
            f"st_trend{suffix}": F.col("st_dir"),
            f"st_distance{suffix}": F.coalesce(distance, F.lit(0.0)),
            f"st_bars_since_flip{suffix}": F.col("trend_duration"),
            f"st_slope{suffix}": F.coalesce(slope, F.lit(0.0)),
            f"st_bandwidth{suffix}": F.col("st_bandwidth"),
        }
    )


def trend_columns(df: DataFrame) -> DataFrame:
    """Deviation from the line in percent, direction and duration."""
    return df.withColumns(
        {
            "trend_deviation": F.try_divide(F.col("close") - F.col("st_line"), F.col("close")) * 100,
            "trend_direction": F.col("st_dir"),
        }
    )
