"""Risk and health rollups over logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.layout import BARS, Layout
from tickspark.operators.index import running, time_slice
from tickspark.operators.scan import last_known


@dataclass(frozen=True)
class Costs:
    """Trading costs and contract value."""

    commission_per_lot: float = 7.0
    slippage_per_lot: float = 2.0
    buffer_usd: float = 1.0
    value_per_lot: float = 1.0


def mark_positions(position_ticks: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Mark each position at each of its ticks: longs leave at the bid, shorts at the ask.

    Rows that carry their ``best_price`` (:func:`positions_on_ticks`) keep it.  Otherwise it is a window per position
    over the ticks of its life.
    """
    is_long = F.col("direction") == 1
    exit_price = F.when(is_long, F.col("bid")).otherwise(F.col("ask"))
    moved = F.when(is_long, exit_price - F.col("entry_price")).otherwise(F.col("entry_price") - exit_price)
    cost = (costs.commission_per_lot + costs.slippage_per_lot) * F.col("lots") + costs.buffer_usd
    life = Window.partitionBy("symbol", "ticket").orderBy("row_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    best = F.when(is_long, F.max("bid").over(life)).otherwise(F.min("ask").over(life))
    if "best_price" in position_ticks.columns:
        best = F.col("best_price")
    gross = moved * F.col("lots") * costs.value_per_lot
    return position_ticks.withColumns(
        {
            "exit_price": exit_price, "gross_pnl_usd": gross, "net_pnl_usd": gross - cost,
            "best_price": best,
        }
    )


# ---------------------------------------------------------------- score and model health

def nan_inf_alerts(df: DataFrame, score: str = "score", vector: str = "vector") -> DataFrame:
    """Rows whose score or hidden vector holds NaN or infinity."""
    def bad(x):
        return F.isnan(x) | (F.abs(x) == float("inf"))

    in_vector = F.exists(F.col(vector), lambda x: bad(x.cast("double")))
    kind = F.when(bad(F.col(score)), F.lit("SCORE_NAN_INF")).when(in_vector, F.lit("VECTOR_NAN_INF"))
    return df.withColumn("alert", kind).filter(F.col("alert").isNotNull())


def vector_norms(df: DataFrame, vector: str = "vector") -> DataFrame:
    total = F.aggregate(
        F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return df.withColumn("norm", F.sqrt(total))


def saturation_alerts(df: DataFrame, limit: float = 100.0, vector: str = "vector") -> DataFrame:
    """Rows whose hidden vector is longer than ``limit``; NaN is no length, infinity is."""
    return vector_norms(df, vector).filter(~F.isnan("norm") & (F.col("norm") > limit))


def low_confidence_runs(
    df: DataFrame, n: int = 10, limit: float = 0.3, score: str = "score", layout: Layout = BARS
) -> DataFrame:
    """Length of the current run of scores below ``limit``, and whether it reached ``n``."""
    idx = layout.idx
    marked = df.withColumn("_ok", F.when(F.col(score) >= limit, F.col(idx).cast("double")))
    carried = last_known(marked, {"_ok": "_last_ok"}, layout)
    run = (F.col(idx) - F.coalesce("_last_ok", F.lit(-1.0))).cast("long")
    return carried.withColumns({"low_run": run, "collapsed": run >= n}).drop("_ok", "_last_ok")


def latency_alerts(df: DataFrame, limit_ms: float = 200.0, latency: str = "latency_ms") -> DataFrame:
    return df.filter(F.col(latency) > limit_ms)


def halt_state(
    df: DataFrame, alert: str = "is_alert", unlock: str = "is_unlock", layout: Layout = BARS
) -> DataFrame:
    """Halted from an alert on until the next unlock."""
    event = F.when(F.col(unlock), 0.0).when(F.col(alert), 1.0)
    carried = last_known(df.withColumn("_event", event), {"_event": "_state"}, layout)
    return carried.withColumn("is_halted", F.coalesce(F.col("_state") == 1.0, F.lit(False))).drop("_event", "_state")


# ---------------------------------------------------------------- account risk

def with_trading_day(df: DataFrame, tz: str = "UTC", cutoff_hours: int = 0, ts: str = "ts") -> DataFrame:
    """Trading day in a time zone; the day changes ``cutoff_hours`` after midnight there."""
    local = F.from_utc_timestamp(F.col(ts), tz) - F.expr(f"interval {int(cutoff_hours)} hours")
    return df.withColumn("trading_day", F.to_date(local))


FILL_SLICES = ("_minute",)


def _sliced(fills: DataFrame) -> DataFrame:
    """Fills with the slice of time they fall into; a task holds one minute of one account."""
    return fills.withColumn("_minute", time_slice("ts", 60))


def _keyed(fills: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Fills, the columns that tell accounts apart, and which of them were added."""
    return (fills, list(by), []) if by else (fills.withColumn("_account", F.lit(0)), ["_account"], ["_account"])


def daily_pnl(fills: DataFrame, tz: str = "UTC", cutoff_hours: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Running result of the trading day after each fill, in order of time and ticket.

    ``by`` names the columns of the account; without them all fills are one account.
    """
    filled = with_trading_day(fills.filter(F.col("status") == "FILLED"), tz, cutoff_hours)
    out = running(
        _sliced(filled), [*by, "trading_day"], FILL_SLICES, ["ts", "ticket"], {"daily_pnl": ("sum", "pnl")}
    )
    return out.drop(*FILL_SLICES)


def loss_streaks(fills: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive losses of the account up to each fill, and trades and wins so far."""
    filled, keys, added = _keyed(fills.filter(F.col("status") == "FILLED"), by)
    win = F.col("pnl") >= 0
    marked = _sliced(filled).withColumns({"_one": F.lit(1), "_win": win.cast("int")})
    counted = running(
        marked, keys, FILL_SLICES, ["ts", "ticket"],
        {"total_trades": ("sum", "_one"), "winning_trades": ("sum", "_win")},
    )
    at_win = counted.withColumn("_at", F.when(F.col("_win") == 1, F.col("total_trades")))
    carried = running(at_win, keys, FILL_SLICES, ["ts", "ticket"], {"_last_win": ("max", "_at")})
    return carried.withColumns(
        {
            "consecutive_losses": F.col("total_trades") - F.coalesce("_last_win", F.lit(0)),
            "win_rate": F.col("winning_trades") / F.col("total_trades"),
        }
    ).drop(*FILL_SLICES, *added, "_one", "_win", "_at", "_last_win")


def risk_breaches(
    fills: DataFrame, loss_limit: float, max_losses: int = 5, tz: str = "UTC", cutoff_hours: int = 0,
    by: Sequence[str] = (),
) -> DataFrame:
    """First fill of each trading day of an account at which the daily loss or the losing streak is too large."""
    daily = daily_pnl(fills, tz, cutoff_hours, by).select(*by, "ticket", "trading_day", "ts", "daily_pnl")
    streaks = loss_streaks(fills, by).select(*by, "ticket", "consecutive_losses")
    rows = daily.join(streaks, [*by, "ticket"])
    reason = (
        F.when(F.col("daily_pnl") < -loss_limit, F.lit("DAILY_LOSS_LIMIT"))
        .when(F.col("consecutive_losses") >= max_losses, F.lit("CONSECUTIVE_LOSSES"))
    )
    hits = rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    first = F.min_by(F.struct("ticket", "reason", "daily_pnl", "consecutive_losses"), F.struct("ts", "ticket"))
    return hits.groupBy(*by, "trading_day").agg(first.alias("f")).select(*by, "trading_day", "f.*")


def exposure_alerts(df: DataFrame, limit: float, exposure: str = "exposure_usd") -> DataFrame:
    return df.filter(F.col(exposure) > limit)


def drawdown(
    equity: DataFrame, value: str = "equity", day: str = "trading_day", by: Sequence[str] = ()
) -> DataFrame:
    """Loss since the start of the day and drawdown from the account's peak so far, in percent.

    ``equity`` has ``ts`` and ``ticket`` for its order.
    """
    rows, keys, added = _keyed(_sliced(equity), by)
    peaked = running(rows, keys, FILL_SLICES, ["ts", "ticket"], {"peak_equity": ("max", value)})
    opened = running(peaked, [*by, day], FILL_SLICES, ["ts", "ticket"], {"day_start": ("first", value)})
    v = F.col(value)
    return opened.withColumns(
        {
            "daily_loss_pct": F.when(F.col("day_start") > 0, (F.col("day_start") - v) / F.col("day_start") * 100)
            .otherwise(F.lit(0.0)),
            "drawdown_pct": F.when(F.col("peak_equity") > 0, (F.col("peak_equity") - v) / F.col("peak_equity") * 100)
            .otherwise(F.lit(0.0)),
        }
    ).drop(*FILL_SLICES, *added)


def account_equity(fills: DataFrame, start: float = 10_000.0, by: Sequence[str] = ()) -> DataFrame:
    """Account value after each fill."""
    rows, keys, added = _keyed(_sliced(fills.filter(F.col("status") == "FILLED")), by)
    out = running(rows, keys, FILL_SLICES, ["ts", "ticket"], {"_sum": ("sum", "pnl")})
    return out.withColumn("equity", F.col("_sum") + start).drop("_sum", *added, *FILL_SLICES)


# ---------------------------------------------------------------- feed health

def feed_health(ticks: DataFrame, now: DataFrame, stale_seconds: float, dead_seconds: float) -> DataFrame:
    """Age of the last tick per symbol against ``now`` (one row, column ``now``), and its status."""
    last = ticks.groupBy("symbol").agg(F.max("ts").alias("last_time"))
    rows = last.crossJoin(F.broadcast(now))
    age = (F.unix_micros("now") - F.unix_micros("last_time")) / 1e6
    status = (
        F.when(age > dead_seconds, F.lit("unhealthy")).when(age > stale_seconds, F.lit("degraded"))
        .otherwise(F.lit("healthy"))
    )
    return rows.withColumns({"age_seconds": age, "status": status}).drop("now")


def overall_status(health: DataFrame) -> DataFrame:
    """Healthy when all are, unhealthy when any is, else degraded; unknown without components."""
    return health.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "healthy").alias("_all"),
        F.bool_or(F.col("status") == "unhealthy").alias("_any"),
    ).select(
        "n", F.when(F.col("n") == 0, F.lit("unknown")).when(F.col("_all"), F.lit("healthy"))
        .when(F.col("_any"), F.lit("unhealthy")).otherwise(F.lit("degraded")).alias("overall"),
    )


def warmup_progress(bars: DataFrame, target: int = 200) -> DataFrame:
    """Share of the warm-up each symbol has seen."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return counts.withColumns(
        {
            "progress": F.least(F.lit(1.0), F.col("n_bars") / F.lit(float(target))),
            "is_warm": F.col("n_bars") >= target,
        }
    )
