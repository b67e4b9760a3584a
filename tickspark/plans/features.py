"""The feature table of event bars, in a fixed number of passes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.layout import BARS, Layout, run_blocked
from tickspark.operators import asof, calendar, denoise, gaps, price, trend, vpin
from tickspark.operators.bars import index_time_bars, time_bars
from tickspark.operators.clean import with_is_valid
from tickspark.operators.joins import with_features
from tickspark.operators.scan import Decay, block_scan, decay_walk, decaying_scan, walk_blocks
from tickspark.schema import FEATURE_NAMES, clip_zscores, fill_defaults
from tickspark.session import materialize

# Decays of the recursive features.
INTENSITY_ALPHA = 0.1
MICRO_VOL_LAMBDA = 0.94


@dataclass(frozen=True)
class FeatureConfig:
    """Window lengths in bars and other parameters of the feature table."""

    zscore_rows: int = 100
    volatility_rows: int = 20
    ofi_rows: int = 20
    kyle_rows: int = 50
    thermo_rows: int = 50
    atr_rows: int = 14
    sigma_rows: int = 50
    bucket_volume: float = 1000.0
    n_buckets: int = 50
    higher_seconds: int = 900
    gap_min_bps: float = 0.0
    gap_max_age: int = 100
    cooldown_bars: int = 2
    wavelet: str = "db4"
    phase_limits: dict = field(default_factory=lambda: dict(price.PHASE_LIMITS))
    trend: trend.SuperTrend = trend.SuperTrend()


def recursive_features(df: DataFrame, layout: Layout = BARS, with_kalman: bool = False) -> DataFrame:
    """tick_intensity, pdi, micro_volatility_pct and the Kalman columns in one pass; needs ``log_return``."""
    dt_log = F.log(F.greatest(F.col("duration_ms"), F.lit(1.0)) + 1e-10)
    r = F.col("log_return") * 100
    inputs = df.withColumns({"_inv": 1 / F.greatest(dt_log, F.lit(0.1)), "_sq": r * r})
    specs = [
        Decay("tick_intensity", "_inv", 1 - INTENSITY_ALPHA), Decay("_var", "_sq", MICRO_VOL_LAMBDA),
    ]
    if with_kalman:
        walks = [decay_walk(specs, layout), denoise.kalman_walk("close", layout=layout)]
        out = denoise.with_residual_bps(walk_blocks(inputs, walks, layout))
    else:
        out = decaying_scan(inputs, specs, layout)
    return out.withColumns(
        {
            "pdi": F.signum("log_return") * F.col("tick_intensity"),
            "micro_volatility_pct": F.sqrt("_var"),
        }
    ).drop("_inv", "_sq", "_var")


def rolling_features(bars: DataFrame, cfg: FeatureConfig, layout: Layout = BARS) -> DataFrame:
    """Everything that is a window of bounded length, after one shuffle and one sort."""
    rows = calendar.session_edges(
        calendar.session(calendar.cyclic_hour(calendar.calendar(price.delta_t_log(price.spread_bps(bars)))))
    )
    steps = [
        price.log_return.step(), price.rolling_zscore.step("log_return", cfg.zscore_rows),
        price.ofi_count.step(cfg.ofi_rows), price.ofi_weighted.step(cfg.ofi_rows),
        price.kyle_lambda.step(cfg.kyle_rows), price.realized_vol.step(cfg.volatility_rows),
        price.temperature.step(cfg.thermo_rows), price.direction_entropy.step(cfg.thermo_rows),
        denoise.wavelet_decompose.step("close", 2, cfg.wavelet), denoise.wavelet_features.step(2),
    ]
    return price.classify_phase(run_blocked(rows, steps, layout), cfg.phase_limits)


def gap_features(bars: DataFrame, cfg: FeatureConfig, layout: Layout = BARS) -> DataFrame:
    """Gap state, events and follow-through, ATR and session age: one window pass, one walk over
    the live gaps, one block scan."""
    steps = [
        price.true_range.step(), price.atr.step(cfg.atr_rows), gaps.detect_fvg.step(cfg.gap_min_bps),
        calendar.session_starts.step(),
    ]
    rows = run_blocked(calendar.session(calendar.calendar(bars)), steps, layout)
    rows = gaps.fvg_state_features(rows, cfg.gap_max_age, layout=layout)
    rows = block_scan(
        rows, *gaps.event_stages(cfg.cooldown_bars, 3, layout.idx), calendar.session_stage(), layout=layout
    )
    return calendar.session_age(gaps.event_columns(rows), layout.idx)


def flow_features(bars: DataFrame, cfg: FeatureConfig, layout: Layout = BARS) -> DataFrame:
    """VPIN and its z-score."""
    steps = [price.log_return.step(), price.bvc_sigma.step(cfg.sigma_rows)]
    split = vpin.bvc(run_blocked(bars, steps, layout))
    rated = vpin.vpin(vpin.volume_buckets(split, cfg.bucket_volume, layout=layout), cfg.n_buckets, layout=layout)
    filled = rated.withColumn("_vpin", F.coalesce("vpin", F.lit(0.0)))
    return price.rolling_zscore(filled, "_vpin", cfg.zscore_rows, "vpin_zscore", layout=layout)


def higher_timeframe(bars: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Range and SuperTrend of the higher timeframe, far fewer rows than the bars."""
    frames = index_time_bars(time_bars(bars, cfg.higher_seconds))
    ranged = frames.withColumns(
        {
            "mid_15m_range": (F.col("high") + F.col("low")) / 2,
            "atr_15m": F.greatest(F.col("high") - F.col("low"), F.lit(1e-10)),
        }
    )
    return trend.supertrend_features(trend.pivot_supertrend(ranged, cfg.trend), "_15m")


HIGHER_COLUMNS = (
    "mid_15m_range", "atr_15m", "st_trend_15m", "st_distance_15m", "st_bars_since_flip_15m",
    "st_slope_15m", "st_bandwidth_15m",
)
GAP_COLUMNS = (
    "atr", "gap_size_bps", "gap_top", "gap_bottom", "fvg_type", "bullish_fvg", "bearish_fvg", "fvg_size_atr",
    "fvg_age_bars", "price_to_fvg_mid", "fvg_filled_pct", "active_fvg_count", "nearest_fvg_distance",
    "fvg_event", "fvg_impulse_atr", "fvg_follow_up_3", "fvg_follow_dn_3", "fvg_follow_bars",
    "fvg_follow_net", "bars_from_session_open", "ce_bull_idx", "ce_bull_edge", "ce_bull_mid",
    "ce_bear_idx", "ce_bear_edge", "ce_bear_mid",
)
TREND_COLUMNS = (
    "st_dir", "st_line", "st_atr", "st_bandwidth", "trend_deviation", "trend_direction", "trend_duration",
    "last_pivot_high", "last_pivot_low",
)
NARROW = ("symbol", "bar_idx", "open_time", "open", "high", "low", "close", "tick_count")


def feature_table(
    bars: DataFrame, cfg: FeatureConfig = FeatureConfig(), layout: Layout = BARS,
    written_bars: bool = True, causal: bool = True,
) -> DataFrame:
    """All features of :data:`tickspark.schema.FEATURES` for each bar, plus the bar columns.

    The families (rolling, gaps, trend, flow, higher timeframe) are separate branches over the
    columns they need, put side by side by (symbol, bar_idx).  With ``written_bars`` the bars are
    first written to the shared folder, so the branches read a small table instead of the ticks.
    """
    if written_bars:
        bars = materialize(bars, "bars")
    narrow = bars.select(*NARROW)
    keys = ["symbol", "bar_idx"]
    rolling = recursive_features(rolling_features(bars, cfg, layout), layout, with_kalman=True)
    trends = trend.trend_columns(trend.pivot_supertrend(narrow, cfg.trend, layout))
    higher = asof.align_features(
        bars.select(*keys, "open_time"), higher_timeframe(narrow, cfg), HIGHER_COLUMNS, causal=causal,
        default=None,
    )
    rows = with_features(
        rolling,
        [
            gap_features(narrow, cfg, layout).select(*keys, *GAP_COLUMNS),
            trends.select(*keys, *TREND_COLUMNS),
            flow_features(narrow, cfg, layout).select(*keys, "vpin", "vpin_zscore"),
            higher.select(*keys, *HIGHER_COLUMNS),
        ],
    )
    return finished(combined(rows))


def combined(rows: DataFrame) -> DataFrame:
    """Columns made of several families; row by row, so also on a stream."""
    rows = gaps.st_alignment(gaps.fvg_location(calendar.interactions(rows)))
    ratio = F.when(F.col("atr_15m").isNotNull(), F.col("atr") / F.greatest("atr_15m", F.lit(1e-10)))
    return rows.withColumns({"atr_1m": F.col("atr"), "atr_ratio_1m_15m": ratio})


def finished(rows: DataFrame) -> DataFrame:
    """Z-scores cut, warm-up NULLs replaced, rows judged."""
    return with_is_valid(fill_defaults(clip_zscores(rows)), FEATURE_NAMES)
