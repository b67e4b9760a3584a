"""Position sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizing:
    """Limits and Kelly parameters of a position size."""

    mode: str = "kelly"  #: ``kelly``, ``fixed`` or ``linear``
    min_lots: float = 0.01
    max_lots: float = 0.10
    fraction: float = 0.25
    max_fraction: float = 0.5
    reward_ratio: float = 3.0


def kelly_fraction(p: Column, cfg: Sizing) -> Column:
    """Fractional Kelly bet (p*b - q) / b, clamped to 0..max_fraction."""
    full = (p * cfg.reward_ratio - (1 - p)) / cfg.reward_ratio
    return F.greatest(F.lit(0.0), F.least(full * cfg.fraction, F.lit(cfg.max_fraction)))


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def kelly_lots(df: DataFrame, cfg: Sizing = Sizing(), score: str = "score") -> DataFrame:
    """Map the Kelly bet to lots, rounded to 2 digits."""
    share = kelly_fraction(F.col(score), cfg) / cfg.max_fraction
    lots = F.round(cfg.min_lots + share * (cfg.max_lots - cfg.min_lots), 2)
    return df.withColumn("lots", _clamp(lots, cfg.min_lots, cfg.max_lots))


def position_size(df: DataFrame, cfg: Sizing = Sizing(), score: str = "score") -> DataFrame:
    """Kelly, fixed, or linear between scores 0.5 and 0.8."""
    if cfg.mode == "kelly":
        return kelly_lots(df, cfg, score)
    if cfg.mode == "fixed":
        return df.withColumn("lots", F.lit(cfg.max_lots))
    ratio = _clamp((F.col(score) - 0.5) / 0.3, 0.0, 1.0)
    return df.withColumn("lots", F.round(cfg.min_lots + ratio * (cfg.max_lots - cfg.min_lots), 2))


@dataclass(frozen=True)
class Contract:
    """Contract and account data of risk-capped sizing."""

    equity: float = 10_000.0
    risk_pct: float = 1.0
    tick_size: float = 0.01
    tick_value: float = 1.0
    volume_min: float = 0.01
    volume_max: float = 100.0
    lot_step: float = 0.01
    counter_scale: float = 0.5


def _step_down(lots: Column, step: float) -> Column:
    """Largest multiple of ``step`` not above ``lots``; the nudge undoes binary noise."""
    return F.floor(lots / step + 1e-9) * step


def risk_lots(df: DataFrame, cfg: Sizing = Sizing(), contract: Contract = Contract(), score: str = "score") -> DataFrame:
    """Kelly lots capped by the money at risk; counter-trend entries are scaled down.

    Without a usable stop distance the plain Kelly size applies.
    """
    low = max(cfg.min_lots, contract.volume_min) if contract.volume_min > 0 else cfg.min_lots
    high = min(cfg.max_lots, contract.volume_max) if contract.volume_max > 0 else cfg.max_lots
    budget = max(0.0, contract.equity * contract.risk_pct / 100)
    distance = F.abs(F.col("entry_price") - F.col("stop_loss"))
    per_lot = distance / contract.tick_size * contract.tick_value
    most = F.when(per_lot > 0, budget / per_lot)
    bet = kelly_fraction(F.col(score), cfg)
    room = F.least(F.lit(high), most)
    lots = (
        F.when((bet <= 0) | (most <= 0), F.lit(low)).when(room < low, room)
        .otherwise(low + bet / cfg.max_fraction * (room - low))
    )
    capped = _clamp(_step_down(lots, contract.lot_step), low, high)
    plain = kelly_lots(df, cfg, score)
    size = F.when((distance > 0) & F.lit(budget > 0), capped).otherwise(F.col("lots"))
    scaled = _step_down(size * max(0.0, contract.counter_scale), contract.lot_step)
    is_counter = F.col("trend_alignment") == "COUNTER"
    return plain.withColumn("lots", F.when(is_counter, scaled).otherwise(size))


def cap_position(df: DataFrame, max_lots: float = 1.0) -> DataFrame:
    """Reduce sizes above the limit and say so."""
    return df.withColumns(
        {
            "approved_lots": F.least(F.col("lots"), F.lit(max_lots)),
            "was_reduced": F.col("lots") > max_lots,
        }
    )
