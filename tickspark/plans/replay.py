"""Decisions over a whole history, with the operators of the live path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.layout import Layout
from tickspark.operators import gaps, signals
from tickspark.operators.index import with_row_index
from tickspark.plans.training import ModelConfig, score


#: What the gate needs of a scored row.
GATE_COLUMNS = ("symbol", "bar_idx", "open_time", "score", "trend_alignment", "market_phase")


@dataclass(frozen=True)
class ReplayConfig:
    """Parameters of the decision path."""

    window_bars: int = 3
    structure_rows: int = 20
    confirm_bars: int = 10
    stop_factor: float = 3.0
    gate: signals.GateConfig = signals.GateConfig()
    decision: signals.DecisionConfig = signals.DecisionConfig()


def decisions(
    features: DataFrame, model=None, cfg: ReplayConfig = ReplayConfig(), model_cfg: ModelConfig = ModelConfig(),
    primary: DataFrame | None = None,
) -> DataFrame:
    """One decision row per bar of a feature table.

    Only bars inside an event window are scored, and only their scores enter the rolling
    threshold.  ``primary`` (:func:`signals.primary_signals` on the same bars) gives entry and stop of its bars;
    all others enter at the close with a stop a multiple of ATR away.
    """
    rows = signals.event_gate(features, cfg.window_bars)
    rows = signals.fallback_stop(rows, cfg.stop_factor, "atr_1m")
    rows = signals.trend_alignment(rows)
    rows = signals.structure_confirm(gaps.structure_breaks(rows, cfg.structure_rows), cfg.confirm_bars)
    asked = F.col("event_present")
    if cfg.decision.require_structure:
        asked = asked & ((F.col("trend_alignment") != "COUNTER") | F.col("structure_ok"))
    warm = F.col("bar_idx") + 1 >= cfg.decision.warmup_bars
    scored = score(rows.filter(asked & warm), model, model_cfg)
    # The gate walks the rows in Python, which keeps every column; the others need not be moved up to it.
    scored = scored.select(*[c for c in GATE_COLUMNS if c in scored.columns])
    numbered = with_row_index(
        scored, order=("open_time", "bar_idx"), slice_seconds=86_400, name="score_idx"
    )
    gated = signals.confidence_gate(numbered, cfg.gate, layout=Layout(idx="score_idx")).select(
        "symbol", "bar_idx", "score", "threshold", "gate_stage"
    )
    joined = rows.join(gated, ["symbol", "bar_idx"], "left")
    if primary is None:
        joined = joined.withColumns({"entry_price": F.col("close"), "from_primary": F.lit(False)})
    else:
        # On the exchange of the join before.
        joined = signals.primary_levels(joined, primary)
    return signals.decide(joined, cfg.decision, cfg.gate.mode).withColumn("direction", F.col("event_direction"))


def run_signals(
    features: DataFrame, model=None, cfg: ReplayConfig = ReplayConfig(), model_cfg: ModelConfig = ModelConfig(),
    primary: DataFrame | None = None,
) -> DataFrame:
    """The passing decisions in time order within each symbol."""
    return decisions(features, model, cfg, model_cfg, primary).filter("should_trade").select(
        "symbol", "bar_idx", "open_time", "direction", "entry_price", "stop_loss",
        "score", "threshold", "trend_alignment", "market_phase", "from_primary",
    )
