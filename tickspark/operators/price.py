"""Rolling price, flow, volatility and thermodynamic features of bars.

All are window functions over the block layout.  Rows before a full window are NULL; the final
``fill_defaults`` turns them into the default of the feature table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickspark.layout import windowed

EPSILON = 1e-10

# Temperature limits between the phases and the scale of the temperature.
PHASE_LIMITS = {"frozen": 0.02, "laminar": 0.2, "turbulent": 1.0}
TEMPERATURE_SCALE = 1e6
# Phase names by feature code.
PHASES = ("FROZEN", "LAMINAR", "TURBULENT", "TRANSITION")


def _full(w: WindowSpec, n: int, value: Column) -> Column:
    """``value`` once the frame holds ``n`` rows, else NULL."""
    return F.when(F.count(F.lit(1)).over(w.rowsBetween(1 - n, 0)) == n, value)


@windowed(lookback=1)
def log_return(df: DataFrame, w, close: str = "close", out: str = "log_return") -> DataFrame:
    """ln(close / previous close), 0 on the first bar and next to a close of 0."""
    ratio = F.try_divide(F.col(close), F.lag(close).over(w))
    return df.withColumn(out, F.coalesce(F.log(ratio), F.lit(0.0)))


@windowed(lookback=lambda col, n=100, out=None: n - 1)
def rolling_zscore(df: DataFrame, w, col: str, n: int = 100, out: str | None = None) -> DataFrame:
    """(x - mean) / population deviation over the last ``n`` rows, 0 below 3 rows or if flat."""
    frame = w.rowsBetween(1 - n, 0)
    std = F.stddev_pop(col).over(frame)
    score = F.try_divide(F.col(col) - F.avg(col).over(frame), std)
    ready = (F.count(F.lit(1)).over(frame) >= 3) & (std > EPSILON)
    return df.withColumn(out or f"{col}_zscore", F.when(ready, score).otherwise(F.lit(0.0)))


def spread_bps(df: DataFrame) -> DataFrame:
    """Average spread of the bar in basis points of the close."""
    average = F.col("spread_sum") / F.greatest(F.col("tick_count"), F.lit(1))
    return df.withColumn("spread_bps", F.try_divide(average, F.col("close")) * 1e4)


def delta_t_log(df: DataFrame) -> DataFrame:
    """Log of the bar duration in ms, at least 1 ms."""
    dt = F.greatest(F.col("duration_ms"), F.lit(1.0))
    return df.withColumn("delta_t_log", F.log(dt + EPSILON))


@windowed(lookback=lambda n=20: n - 1)
def ofi_count(df: DataFrame, w, n: int = 20) -> DataFrame:
    """Sum of bar imbalances over up to ``n`` rows."""
    total = F.sum(F.col("imbalance").cast("double")).over(w.rowsBetween(1 - n, 0))
    return df.withColumn("ofi_count", total)


@windowed(lookback=lambda n=20: n - 1)
def ofi_weighted(df: DataFrame, w, n: int = 20) -> DataFrame:
    """Sum of imbalance per ms over up to ``n`` rows."""
    rate = F.col("imbalance") / F.greatest(F.col("duration_ms"), F.lit(1.0))
    return df.withColumn("ofi_weighted", F.sum(rate).over(w.rowsBetween(1 - n, 0)))


@windowed(lookback=lambda n=50: n)
def kyle_lambda(df: DataFrame, w, n: int = 50) -> DataFrame:
    """Percent price change over ``n`` bars per tick traded in them."""
    before = F.lag("close", n).over(w)
    change = F.abs(F.col("close") - before) / before * 100
    total = F.sum("tick_count").over(w.rowsBetween(1 - n, 0))
    return df.withColumn("kyle_lambda_pct", F.when(before.isNotNull() & (total > 0), change / total))


@windowed(lookback=lambda n=20: n - 1)
def realized_vol(df: DataFrame, w, n: int = 20) -> DataFrame:
    """Root of the summed squared percent returns of a full window."""
    r = F.col("log_return") * 100
    total = F.sqrt(F.sum(r * r).over(w.rowsBetween(1 - n, 0)))
    return df.withColumn("realized_volatility_pct", _full(w, n, total))


@windowed(lookback=lambda n=50: n - 1)
def temperature(df: DataFrame, w, n: int = 50) -> DataFrame:
    """Variance of log returns per mean bar duration, scaled."""
    frame = w.rowsBetween(1 - n, 0)
    dt = F.avg(F.greatest(F.col("duration_ms"), F.lit(1.0))).over(frame)
    value = F.when(dt > EPSILON, F.var_pop("log_return").over(frame) / dt * TEMPERATURE_SCALE)
    return df.withColumn("market_temperature", _full(w, n, F.coalesce(value, F.lit(0.0))))


@windowed(lookback=lambda n=50: n - 1)
def direction_entropy(df: DataFrame, w, n: int = 50) -> DataFrame:
    """Entropy of the shares of rising and falling bars in a full window."""
    frame = w.rowsBetween(1 - n, 0)
    up = F.count_if(F.col("log_return") > 0).over(frame)
    down = F.count_if(F.col("log_return") < 0).over(frame)
    total = F.greatest(up + down, F.lit(1))

    def term(count: Column) -> Column:
        p = count / total
        return F.when(count > 0, p * F.log(p + EPSILON)).otherwise(F.lit(0.0))

    return df.withColumn("market_entropy", _full(w, n, -(term(up) + term(down))))


def classify_phase(df: DataFrame, limits: dict[str, float] = PHASE_LIMITS) -> DataFrame:
    """Feature code 0 frozen, 1 laminar, 3 transition, 2 turbulent by temperature, and its name."""
    t = F.col("market_temperature")
    code = (
        F.when(t < limits["frozen"], 0).when(t < limits["laminar"], 1)
        .when(t < limits["turbulent"], 3).when(t.isNotNull(), 2)
    )
    name = F.coalesce(*[F.when(code == k, F.lit(p)) for k, p in enumerate(PHASES)])
    return df.withColumns({"ts_phase": code, "market_phase": name})


@windowed(lookback=1)
def true_range(df: DataFrame, w) -> DataFrame:
    """max(high-low, \\|high-previous close\\|, \\|low-previous close\\|); high-low on the first bar."""
    prev = F.lag("close").over(w)
    # greatest() skips NULL, so the first bar falls back to its range
    value = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )
    return df.withColumn("true_range", value)


@windowed(lookback=lambda n=14, **_: n)
def atr(df: DataFrame, w, n: int = 14, out: str = "atr") -> DataFrame:
    """Mean true range over up to ``n`` rows."""
    ranged = df if "true_range" in df.columns else true_range.step().apply(df, w)
    return ranged.withColumn(out, F.avg("true_range").over(w.rowsBetween(1 - n, 0)))


@windowed(lookback=lambda h=20, **_: h)
def close_to_close_sigma(
    df: DataFrame, w, h: int = 20, returns: str = "log_return", out: str = "sigma"
) -> DataFrame:
    """Population deviation of returns over a full window."""
    return df.withColumn(out, _full(w, h, F.stddev_pop(returns).over(w.rowsBetween(1 - h, 0))))


@windowed(lookback=lambda n=50: n - 1)
def bvc_sigma(df: DataFrame, w, n: int = 50) -> DataFrame:
    """Deviation of returns over an expanding window of up to ``n`` rows, at least 1e-6."""
    frame = w.rowsBetween(1 - n, 0)
    ready = F.count(F.lit(1)).over(frame) >= 3
    sigma = F.when(ready, F.stddev_pop("log_return").over(frame)).otherwise(F.lit(1e-6))
    return df.withColumn("bvc_sigma", F.greatest(sigma, F.lit(1e-6)))
