"""Decisions and alerts on streams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tickspark.operators.signals import DecisionConfig, GateConfig
from tickspark.streaming.run import use_rocksdb

# ---------------------------------------------------------------- decisions

DECISION_INPUT = (
    "bar_idx", "fvg_event", "st_trend_15m", "structure_signal", "score", "market_phase", "close", "atr_1m",
)
DECISION_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()), T.StructField("bar_idx", T.LongType()),
        T.StructField("event_present", T.BooleanType()), T.StructField("direction", T.LongType()),
        T.StructField("trend_alignment", T.StringType()), T.StructField("gate_stage", T.StringType()),
        T.StructField("threshold", T.DoubleType()), T.StructField("stop_loss", T.DoubleType()),
        T.StructField("filtered_reason", T.StringType()), T.StructField("should_trade", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class LiveConfig:
    """Parameters of the live decision path, those of the batch replay."""

    window_bars: int = 3
    confirm_bars: int = 10
    stop_factor: float = 3.0
    gate: GateConfig = GateConfig()
    decision: DecisionConfig = DecisionConfig()


class DecisionProcessor(StatefulProcessor):
    """Event window, last structure break and the recent scores of one symbol."""

    def __init__(self, cfg: LiveConfig):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.flags = handle.getValueState(
            "flags", "prev_event int, edge long, edge_dir int, sig int, sig_idx long"
        )
        self.scores = handle.getValueState("scores", "v array<double>, seen long")

    def _threshold(self, scores: list[float], phase: str | None, alignment: str) -> tuple[str, float | None]:
        gate, size = self.cfg.gate, len(scores)
        counter = alignment == "COUNTER"
        if gate.mode == "fixed":
            return "ROLLING", min(1.0, gate.fixed_threshold + gate.counter_boost * counter)
        if size < gate.min_required:
            return "FROZEN", None
        if size < gate.full_buffer:
            stage, limit = "FIXED", gate.fixed_threshold
        else:
            q = float(gate.by_phase.get(phase, gate.base_quantile))
            percent = {k: (v * 100 if v < 1 else v) for k, v in (("a", gate.aligned), ("c", gate.counter)) if v is not None}
            if alignment == "ALIGNED" and "a" in percent:
                q = min(q, percent["a"])
            elif counter and "c" in percent:
                q = max(q, percent["c"])
            value = float(np.percentile(scores, q))
            stage, limit = "ROLLING", max(gate.floor, min(gate.ceiling, value))
        if counter and gate.counter_boost > 0:
            limit = min(1.0, max(gate.floor, min(gate.ceiling, limit + gate.counter_boost)))
        return stage, limit

    def handleInputRows(self, key, rows, timerValues):
        cfg = self.cfg
        prev, edge, edge_dir, sig, sig_idx = self.flags.get() if self.flags.exists() else (0, -1, 0, 0, -1)
        scores, seen = self.scores.get() if self.scores.exists() else ([], 0)
        scores = list(scores)
        out = []
        pdf = pd.concat(list(rows)).sort_values("bar_idx")
        for idx, event, trend, structure, score, phase, close, atr in pdf[list(DECISION_INPUT)].itertuples(index=False, name=None):
            if event != 0 and prev == 0:
                edge, edge_dir = int(idx), int(trend) if trend != 0 else int(np.sign(event))
            prev = int(event)
            if structure != 0:
                sig, sig_idx = int(structure), int(idx)
            present = edge >= 0 and idx - edge < cfg.window_bars
            side = edge_dir if present else 0
            alignment = "UNKNOWN" if trend == 0 or side == 0 else ("ALIGNED" if trend == side else "COUNTER")
            stop = close - cfg.stop_factor * atr if side == 1 else close + cfg.stop_factor * atr
            fresh = cfg.confirm_bars == 0 or idx - sig_idx <= cfg.confirm_bars
            confirmed = sig != 0 and sig == side and fresh
            stage, limit, reason = None, None, None
            if idx + 1 < cfg.decision.warmup_bars:
                reason = "WARMUP"
            elif not present:
                reason = "NO_EVENT"
            elif cfg.decision.require_structure and alignment == "COUNTER" and not confirmed:
                reason = "COUNTER_TREND_NO_STRUCTURE"
            else:
                scores = [*scores, float(score)][-cfg.gate.buffer:]
                seen += 1
                stage, limit = self._threshold(scores, phase, alignment)
                if stage == "FROZEN":
                    reason = "COLD_START"
                elif score < limit:
                    reason = "LOW_CONFIDENCE"
                elif cfg.decision.require_transition and cfg.gate.mode == "fixed" and phase != "TRANSITION":
                    reason = "WRONG_PHASE"
                elif not stop > 0:
                    reason = "NO_STOP_LOSS"
            out.append((key[0], int(idx), present, side, alignment, stage, limit, stop, reason, reason is None))
        self.flags.update((prev, edge, edge_dir, sig, sig_idx))
        self.scores.update((scores, int(seen)))
        yield pd.DataFrame(out, columns=DECISION_SCHEMA.fieldNames())

    def close(self) -> None:
        pass


def stream_decisions(features: DataFrame, cfg: LiveConfig = LiveConfig()) -> DataFrame:
    """One decision per feature row that carries a score."""
    use_rocksdb(features.sparkSession)
    rows = features.select(
        "symbol", F.col("bar_idx").cast("long"), F.col("fvg_event").cast("int"),
        F.col("st_trend_15m").cast("int"), F.col("structure_signal").cast("int"), "score", "market_phase",
        "close", "atr_1m",
    )
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=DecisionProcessor(cfg), outputStructType=DECISION_SCHEMA,
        outputMode="Append", timeMode="None",
    )


# ---------------------------------------------------------------- alerts

def stream_alerts(
    scored: DataFrame, ts: str = "ts", window: str = "1 hour", watermark: str = "1 minute",
    low_score: float = 0.3, max_latency_ms: float = 200.0,
) -> DataFrame:
    """Counts of low, invalid and slow scores per symbol and window."""
    s, latency = F.col("score"), F.col("latency_ms")
    rows = scored.withWatermark(ts, watermark).groupBy("symbol", F.window(ts, window).alias("w"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s < low_score).alias("n_low"),
        F.count_if(F.isnan(s)).alias("n_invalid"), F.count_if(latency > max_latency_ms).alias("n_slow"),
        F.max(latency).alias("max_latency_ms"),
    ).select("symbol", F.col("w.start").alias("start_time"), "n", "n_low", "n_invalid", "n_slow", "max_latency_ms")


RUN_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()), T.StructField("seq", T.LongType()),
        T.StructField("low_run", T.LongType()), T.StructField("is_halted", T.BooleanType()),
    ]
)


class HaltProcessor(StatefulProcessor):
    """Runs of low scores per symbol; a run of ``n`` halts it for good."""

    def __init__(self, n: int, limit: float):
        self.n, self.limit = n, limit

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "length long, halted boolean")

    def handleInputRows(self, key, rows, timerValues):
        length, halted = self.state.get() if self.state.exists() else (0, False)
        out = []
        for seq, score in pd.concat(list(rows)).sort_values("seq")[["seq", "score"]].itertuples(index=False, name=None):
            length = length + 1 if score < self.limit else 0
            halted = halted or length >= self.n
            out.append((key[0], int(seq), length, halted))
        self.state.update((int(length), bool(halted)))
        yield pd.DataFrame(out, columns=RUN_SCHEMA.fieldNames())

    def close(self) -> None:
        pass


def stream_halts(scored: DataFrame, n: int = 10, limit: float = 0.3) -> DataFrame:
    """Length of the low-score run and halt flag for every scored row."""
    use_rocksdb(scored.sparkSession)
    return scored.select("symbol", "seq", "score").groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=HaltProcessor(n, limit), outputStructType=RUN_SCHEMA,
        outputMode="Append", timeMode="None",
    )
