"""Primary signals, event gates, adaptive thresholds and the decision funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.layout import BARS, Layout, windowed
from tickspark.operators.scan import Walk, cooldown, last_known, walk_blocks


# ---------------------------------------------------------------- primary signals

@dataclass(frozen=True)
class PrimaryConfig:
    """When a trend bar becomes a signal."""

    mode: str = "immediate"  #: ``immediate`` new gap, ``ce`` retracement to a midpoint, ``trend_only``
    min_duration: int = 3
    cooldown_bars: int = 5
    buffer_bps: float = 5.0
    atr_factor: float = 3.0


def signal_candidates(df: DataFrame, cfg: PrimaryConfig = PrimaryConfig()) -> DataFrame:
    """Flag bars that qualify before the cooldown, with direction, protecting edge and entry."""
    side = F.col("st_dir")
    trending = (side != 0) & (F.col("trend_duration") >= cfg.min_duration)
    edge = entry = F.lit(None).cast("double")
    if cfg.mode == "immediate":
        found = F.col("fvg_type") == side
        edge = F.when(side == 1, F.col("gap_bottom")).otherwise(F.col("gap_top"))
        entry = (F.col("gap_top") + F.col("gap_bottom")) / 2
    elif cfg.mode == "ce":
        found = F.when(side == 1, F.col("ce_bull_idx").isNotNull()).otherwise(F.col("ce_bear_idx").isNotNull())
        edge = F.when(side == 1, F.col("ce_bull_edge")).otherwise(F.col("ce_bear_edge"))
        entry = F.when(side == 1, F.col("ce_bull_mid")).otherwise(F.col("ce_bear_mid"))
    elif cfg.mode == "trend_only":
        found = F.lit(True)
    else:
        raise ValueError(f"unknown mode {cfg.mode}")
    return df.withColumns(
        {
            "is_candidate": F.coalesce(trending & found, F.lit(False)), "direction": side,
            "protect_edge": edge, "entry_price": F.coalesce(entry, F.col("close")),
        }
    )


def structure_stop(df: DataFrame, cfg: PrimaryConfig = PrimaryConfig()) -> DataFrame:
    """Stop beyond the gap edge, last pivot and trend line; a multiple of ATR when none is known."""
    buffer = F.col("close") * cfg.buffer_bps / 1e4

    def known(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    fallback = cfg.atr_factor * F.col("st_atr")
    below = F.least(F.col("protect_edge"), known("last_pivot_low"), known("st_line")) - buffer
    above = F.greatest(F.col("protect_edge"), known("last_pivot_high"), known("st_line")) + buffer
    stop = F.when(F.col("direction") == 1, F.coalesce(below, F.col("close") - fallback)).otherwise(
        F.coalesce(above, F.col("close") + fallback)
    )
    return df.withColumn("stop_loss", stop)


def confidence_factors(df: DataFrame) -> DataFrame:
    """What the quality of a signal depends on, and the risk to the stop in bps."""
    risk = F.try_divide(F.abs(F.col("entry_price") - F.col("stop_loss")), F.col("entry_price")) * 1e4
    factors = F.struct(
        "trend_duration", F.coalesce("gap_size_bps", F.lit(0.0)).alias("fvg_size_bps"),
        F.round("st_atr", 4).alias("atr"), F.round("st_bandwidth", 4).alias("bandwidth"),
        F.round(risk, 2).alias("risk_bps"),
    )
    return df.withColumns({"risk_bps": risk, "confidence_factors": factors})


def primary_signals(df: DataFrame, cfg: PrimaryConfig = PrimaryConfig(), layout: Layout = BARS) -> DataFrame:
    """Signals of bars that carry SuperTrend and gap columns.

    A signal silences the series for ``cooldown_bars``; the next one comes at that distance at
    the earliest.
    """
    marked = signal_candidates(df, cfg)
    kept = cooldown(marked, "is_candidate", max(1, cfg.cooldown_bars), "is_signal", layout)
    signals = kept.filter("is_signal").drop("is_candidate", "is_signal")
    return confidence_factors(structure_stop(signals, cfg))


# ---------------------------------------------------------------- event gate

@windowed(lookback=1)
def _edges(df: DataFrame, w, event: str, align: str, idx: str) -> DataFrame:
    before = F.coalesce(F.lag(event).over(w), F.lit(0))
    edge = (F.col(event) != 0) & (before == 0)
    side = F.when(F.col(align) != 0, F.col(align)).otherwise(F.signum(event))
    return df.withColumns(
        {"_edge": F.when(edge, F.col(idx)), "_edge_dir": F.when(edge, side.cast("double"))}
    )


def event_gate(
    df: DataFrame, n: int = 3, decay_bars: int = 0, event: str = "fvg_event",
    align: str = "st_trend_15m", layout: Layout = BARS,
) -> DataFrame:
    """Open a window of ``n`` bars at each rising edge of the event.

    The window holds the direction it was opened with: the higher trend, or the event's own sign
    without one.  With ``decay_bars`` a young live gap also opens the gate.
    """
    idx = layout.idx
    edged = _edges(df, event, align, idx, layout=layout)
    carried = last_known(edged, {"_edge": "_last_edge", "_edge_dir": "_last_dir"}, layout)
    inside = F.col(idx) - F.col("_last_edge") < n
    present, side = F.coalesce(inside, F.lit(False)), F.col("_last_dir")
    source = F.when(F.col("_edge").isNotNull(), F.lit("rising_edge")).when(present, F.lit("window"))
    if decay_bars > 0:
        bull, bear = F.col("bullish_fvg") != 0, F.col("bearish_fvg") != 0
        young = (F.col("fvg_age_bars") > 0) & (F.col("fvg_age_bars") <= decay_bars) & (bull | bear)
        own = F.when(bull & ~bear, 1).when(bear & ~bull, -1).otherwise(0)
        faded = F.when(F.col(align) != 0, F.col(align)).otherwise(own)
        decays = ~present & F.coalesce(young, F.lit(False)) & (faded != 0)
        side = F.when(decays, faded.cast("double")).otherwise(side)
        source = F.when(decays, F.lit("decay")).otherwise(source)
        present = present | decays
    return carried.withColumns(
        {
            "event_present": present,
            "event_direction": F.when(present, side.cast("int")).otherwise(F.lit(0)),
            "event_source": source,
        }
    ).drop("_edge", "_edge_dir", "_last_edge", "_last_dir")


def fallback_stop(df: DataFrame, factor: float = 3.0, atr: str = "atr") -> DataFrame:
    """Stop a multiple of ATR away from the close."""
    side = F.when(F.col("event_direction") == 1, -1).otherwise(1)
    return df.withColumn("stop_loss", F.col("close") + side * factor * F.col(atr))


def primary_levels(df: DataFrame, primary: DataFrame, keys: Sequence[str] = ("symbol", "bar_idx")) -> DataFrame:
    """Entry and stop of the primary signal at its bar; elsewhere the close and the stop that ``df`` has.

    ``primary`` has at most one signal per bar, as :func:`primary_signals` gives them.  The direction stays that
    of the event.  A signal without a stop leaves the fallback, one without an entry the close.
    """
    found = primary.select(*keys, F.col("entry_price").alias("_entry"), F.col("stop_loss").alias("_stop"), F.lit(True).alias("_found"))
    rows = df.drop("entry_price", "from_primary").join(found, list(keys), "left")
    return rows.withColumns(
        {
            "entry_price": F.coalesce("_entry", "close"), "stop_loss": F.coalesce("_stop", "stop_loss"),
            "from_primary": F.col("_found").isNotNull(),
        }
    ).drop("_entry", "_stop", "_found")


def trend_alignment(df: DataFrame, trend: str = "st_trend_15m", direction: str = "event_direction") -> DataFrame:
    unknown = (F.coalesce(F.col(trend), F.lit(0)) == 0) | (F.coalesce(F.col(direction), F.lit(0)) == 0)
    value = (
        F.when(unknown, F.lit("UNKNOWN")).when(F.col(trend) == F.col(direction), F.lit("ALIGNED"))
        .otherwise(F.lit("COUNTER"))
    )
    return df.withColumn("trend_alignment", value)


def structure_confirm(
    df: DataFrame, n: int = 10, direction: str = "event_direction", layout: Layout = BARS
) -> DataFrame:
    """Is the last structure break on the side of the event and at most ``n`` bars old (0: any age)?"""
    idx = layout.idx
    signal = F.col("structure_signal")
    marked = df.withColumns(
        {
            "_sig": F.when(signal != 0, signal.cast("double")),
            "_sig_idx": F.when(signal != 0, F.col(idx).cast("double")),
        }
    )
    carried = last_known(marked, {"_sig": "_last_sig", "_sig_idx": "_last_idx"}, layout)
    fresh = F.lit(True) if n == 0 else F.col(idx) - F.col("_last_idx") <= n
    ok = (F.col("_last_sig") == F.col(direction)) & (F.col(direction) != 0) & fresh
    return carried.withColumn("structure_ok", F.coalesce(ok, F.lit(False))).drop(
        "_sig", "_sig_idx", "_last_sig", "_last_idx"
    )


# ---------------------------------------------------------------- adaptive threshold

# Percentile by phase.
PHASE_QUANTILES = {"FROZEN": 99, "LAMINAR": 97, "TURBULENT": 92, "TRANSITION": 95}


@dataclass(frozen=True)
class GateConfig:
    """Threshold on scores from the last ``buffer`` scores."""

    mode: str = "rolling_quantile"  #: or ``fixed``
    buffer: int = 2000
    base_quantile: float = 95
    min_required: int = 500
    full_buffer: int = 1500
    fixed_threshold: float = 0.70
    floor: float = 0.1
    ceiling: float = 0.9
    by_phase: Mapping[str, float] = field(default_factory=lambda: dict(PHASE_QUANTILES))
    aligned: float | None = None
    counter: float | None = None
    counter_boost: float = 0.0


def rolling_quantiles(df: DataFrame, col: str, n: int, qs: Sequence[float], layout: Layout) -> DataFrame:
    """Percentiles (0..100) over the last ``n`` rows as columns ``_q0``, ``_q1``, ...

    The windowed ``percentile`` of Spark sorts the frame anew for every row; the rolling
    quantile of pandas updates it, so the blocks are walked there.
    """
    names = [f"_q{k}" for k in range(len(qs))]

    def fn(pdf: pd.DataFrame) -> dict:
        window = pdf[col].rolling(n, min_periods=1)
        return {c: window.quantile(q / 100) for c, q in zip(names, qs)}

    walk = Walk(fn, [T.StructField(c, T.DoubleType()) for c in names], n - 1)
    return walk_blocks(df, [walk], layout)


def _percent(q: float) -> float:
    return q * 100 if q < 1.0 else float(q)


def confidence_gate(
    df: DataFrame, cfg: GateConfig = GateConfig(), score: str = "score",
    layout: Layout = Layout(idx="score_idx"),
) -> DataFrame:
    """Threshold and stage for every scored row (dense index ``score_idx``).

    FROZEN below ``min_required`` scores, FIXED up to ``full_buffer``, then the percentile of the
    buffer: chosen by phase, loosened with the trend and tightened against it.
    """
    counter = F.col("trend_alignment") == "COUNTER"
    if cfg.mode == "fixed":
        out = df.withColumns(
            {"gate_stage": F.lit("ROLLING"), "threshold": F.lit(cfg.fixed_threshold)}
        )
        if cfg.counter_boost > 0:
            boosted = F.least(F.col("threshold") + cfg.counter_boost, F.lit(1.0))
            out = out.withColumn("threshold", F.when(counter, boosted).otherwise(F.col("threshold")))
        return out
    phase = F.lit(float(cfg.base_quantile))
    for name, q in cfg.by_phase.items():
        phase = F.when(F.col("market_phase") == name, F.lit(float(q))).otherwise(phase)
    chosen = phase
    if cfg.aligned is not None:
        chosen = F.when(F.col("trend_alignment") == "ALIGNED", F.least(phase, F.lit(_percent(cfg.aligned)))).otherwise(chosen)
    if cfg.counter is not None:
        chosen = F.when(counter, F.greatest(phase, F.lit(_percent(cfg.counter)))).otherwise(chosen)
    tuned = [_percent(q) for q in (cfg.aligned, cfg.counter) if q is not None]
    qs = sorted({float(q) for q in [cfg.base_quantile, *cfg.by_phase.values(), *tuned]})
    rows = rolling_quantiles(df.withColumn("quantile", chosen), score, cfg.buffer, qs, layout)
    picked = F.coalesce(*[F.when(F.col("quantile") == q, F.col(f"_q{k}")) for k, q in enumerate(qs)])

    def bounded(c: Column) -> Column:
        return F.greatest(F.lit(cfg.floor), F.least(F.lit(cfg.ceiling), c))

    size = F.least(F.col(layout.idx) + 1, F.lit(cfg.buffer))
    stage = (
        F.when(size < cfg.min_required, F.lit("FROZEN")).when(size < cfg.full_buffer, F.lit("FIXED"))
        .otherwise(F.lit("ROLLING"))
    )
    limit = F.when(stage == "FIXED", F.lit(cfg.fixed_threshold)).when(stage == "ROLLING", bounded(picked))
    if cfg.counter_boost > 0:
        boosted = F.least(bounded(limit + cfg.counter_boost), F.lit(1.0))
        limit = F.when(counter & limit.isNotNull(), boosted).otherwise(limit)
    return rows.withColumns({"gate_stage": stage, "threshold": limit}).drop(*[f"_q{k}" for k in range(len(qs))])


@dataclass(frozen=True)
class DecisionConfig:
    """Switches of the decision funnel."""

    warmup_bars: int = 50
    require_structure: bool = True
    require_transition: bool = False


def decide(df: DataFrame, cfg: DecisionConfig = DecisionConfig(), gate_mode: str = "rolling_quantile") -> DataFrame:
    """First failing check of each bar in ``filtered_reason``; NULL means trade.

    The phase is checked behind a fixed gate only; a rolling gate has thresholds per phase.
    """
    blocked = (
        (F.col("trend_alignment") == "COUNTER") & ~F.col("structure_ok")
        if cfg.require_structure else F.lit(False)
    )
    in_phase = cfg.require_transition and gate_mode == "fixed"
    wrong_phase = (F.col("market_phase") != "TRANSITION") if in_phase else F.lit(False)
    reason = (
        F.when(F.col("bar_idx") + 1 < cfg.warmup_bars, F.lit("WARMUP"))
        .when(~F.col("event_present"), F.lit("NO_EVENT"))
        .when(blocked, F.lit("COUNTER_TREND_NO_STRUCTURE"))
        .when(F.coalesce(F.col("gate_stage"), F.lit("FROZEN")) == "FROZEN", F.lit("COLD_START"))
        .when(F.col("score") < F.col("threshold"), F.lit("LOW_CONFIDENCE"))
        .when(F.coalesce(wrong_phase, F.lit(True)), F.lit("WRONG_PHASE"))
        .when(F.coalesce(F.col("stop_loss"), F.lit(0.0)) <= 0, F.lit("NO_STOP_LOSS"))
    )
    return df.withColumn("filtered_reason", reason).withColumn(
        "should_trade", F.col("filtered_reason").isNull()
    )


# ---------------------------------------------------------------- price guard and filters

@dataclass(frozen=True)
class PriceGuard:
    """Limits in points; 0 switches a limit off."""

    max_spread: float = 50.0
    entry_band: float = 100.0
    max_slippage: float = 200.0
    reject_outside_band: bool = True
    point: float = 0.01


def price_guard(df: DataFrame, cfg: PriceGuard = PriceGuard()) -> DataFrame:
    """Reason a quote is refused for an entry, NULL when it passes."""
    bid, ask, entry = F.col("bid"), F.col("ask"), F.col("entry_price")
    overshoot = F.when(F.col("direction") == 1, ask - entry).when(F.col("direction") == -1, entry - bid)
    no_entry = entry.isNull() | (entry <= 0)
    reason = F.when((bid <= 0) | (ask <= 0), F.lit("invalid_bid_ask"))
    if cfg.max_spread > 0:
        reason = reason.when((ask - bid) / cfg.point > cfg.max_spread, F.lit("spread_too_wide"))
    reason = reason.when(no_entry, F.lit(None).cast("string"))
    if cfg.entry_band > 0:
        outcome = F.lit("entry_band") if cfg.reject_outside_band else F.lit(None).cast("string")
        reason = reason.when(overshoot > cfg.entry_band * cfg.point, outcome)
    if cfg.max_slippage > 0:
        reason = reason.when(overshoot > cfg.max_slippage * cfg.point, F.lit("slippage"))
    return df.withColumn("guard_reason", reason)


def regime_filter(df: DataFrame, max_entropy: float = 0.9, min_temperature: float = 0.1) -> DataFrame:
    """Reason the market state forbids entries."""
    reason = (
        F.when(F.col("market_phase") == "FROZEN", F.lit("FROZEN_MARKET"))
        .when(F.col("market_entropy") > max_entropy, F.lit("HIGH_ENTROPY"))
        .when(F.col("market_temperature") < min_temperature, F.lit("FROZEN_MARKET"))
    )
    return df.withColumn("regime_reason", reason)


# Per phase allow entry, least meta confidence, least signal confidence, order type.
PHASE_ROUTES = {
    "LAMINAR": (True, 0.55, 0.55, "limit"),
    "TURBULENT": (True, 0.50, 0.50, "limit"),
    "TRANSITION": (True, 0.52, 0.52, "market"),
    "FROZEN": (False, 0.99, 0.99, "none"),
}


def phase_route(df: DataFrame, routes: Mapping[str, tuple] = PHASE_ROUTES, score: str = "score") -> DataFrame:
    """Order type and permission by market phase (a table of four rows)."""
    table = df.sparkSession.createDataFrame(
        [(k, *v) for k, v in routes.items()],
        "market_phase string, allow_entry boolean, min_confidence double, min_signal double, order_type string",
    )
    out = df.join(F.broadcast(table), "market_phase", "left")
    allowed = F.col("allow_entry") & (F.col(score) >= F.col("min_confidence"))
    return out.withColumn("route_allowed", F.coalesce(allowed, F.lit(False)))


@dataclass(frozen=True)
class TradingHours:
    """A span of the day (``HH:MM``), optionally on some weekdays (Monday 0)."""

    name: str
    start: str = "00:00"
    end: str = "23:59"
    days: tuple[int, ...] = ()


def _within(span: TradingHours, ts: Column) -> Column:
    def minutes(text: str) -> int:
        h, m = text.split(":")
        return int(h) * 60 + int(m)

    now = F.hour(ts) * 60 + F.minute(ts)
    start, end = minutes(span.start), minutes(span.end)
    inside = (now >= start) & (now <= end) if start <= end else (now >= start) | (now <= end)
    return inside & F.weekday(ts).isin(*span.days) if span.days else inside


def session_filter(
    df: DataFrame, active: Sequence[TradingHours] = (), excluded: Sequence[TradingHours] = (), ts: str = "ts"
) -> DataFrame:
    """Keep rows inside any active span (all if none is given) and outside every excluded one."""
    col = F.col(ts)
    keep = F.lit(not active)
    for span in active:
        keep = keep | _within(span, col)
    for span in excluded:
        keep = keep & ~_within(span, col)
    return df.filter(keep)


def own_positions(positions: DataFrame, tag: int, column: str = "magic") -> DataFrame:
    """Positions opened under ``tag``; untagged ones (0) never count."""
    return positions.filter((F.col(column) == tag) & (F.col(column) != 0))


