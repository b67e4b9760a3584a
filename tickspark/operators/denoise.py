"""Kalman and wavelet smoothing of price series."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.layout import BARS, Layout, windowed
from tickspark.operators.fold import adaptive_kalman, keyed_fold
from tickspark.operators.index import time_slice
from tickspark.operators.scan import Walk, memory_rows, walk_blocks

# Scaling (low-pass) filter coefficients of the wavelets, each summing to sqrt(2).
FILTERS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db4": (
        0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
        -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
    ),
}
#: Median absolute deviation of a unit normal.
MAD_UNIT = 0.6745


# ---------------------------------------------------------------- Kalman

def kalman_gains(q: float, r: float, p0: float, bits: int = 52) -> list[tuple[float, float]]:
    """(gain, uncertainty) by row until they no longer change; the last pair holds on."""
    p, out = p0, [(1.0, p0)]
    while True:
        ahead = p + q
        k = ahead / (ahead + r)
        p = (1 - k) * ahead
        out.append((k, p))
        if len(out) > 2 and abs(k - out[-2][0]) <= 2.0 ** -bits * k or len(out) > 100_000:
            return out


def kalman_walk(
    col: str = "close", q: float = 0.1, r: float = 1.0, p0: float = 100.0, layout: Layout = BARS
) -> Walk:
    """The filter as a walk over blocks, see :func:`kalman`."""
    table = np.array(kalman_gains(q, r, p0))
    names = ("kalman", "kalman_residual", "kalman_gain", "kalman_uncertainty")
    idx = layout.idx

    def fn(pdf: pd.DataFrame) -> dict:
        row = np.minimum(pdf[idx].to_numpy(), len(table) - 1)
        gain, p = table[row, 0], table[row, 1]
        x, estimates, residuals = None, [], []
        for z, k in zip(pdf[col].tolist(), gain.tolist()):
            residual = 0.0 if x is None else z - x
            x = z if x is None else x + k * residual
            estimates.append(x)
            residuals.append(residual)
        return dict(zip(names, (estimates, residuals, gain, p)))

    fields = [T.StructField(n, T.DoubleType()) for n in names]
    return Walk(fn, fields, memory_rows(1 - table[-1, 0]) + 1)


def with_residual_bps(df: DataFrame, col: str = "close") -> DataFrame:
    bps = F.when(F.col(col) > 0, F.col("kalman_residual") / F.col(col) * 1e4).otherwise(F.lit(0.0))
    return df.withColumn("kalman_residual_bps", bps)


def kalman(
    df: DataFrame, col: str = "close", q: float = 0.1, r: float = 1.0, p0: float = 100.0,
    layout: Layout = BARS,
) -> DataFrame:
    """Random-walk Kalman filter: estimate, residual, gain, uncertainty, residual in bps.

    The gain does not depend on the data, only on the row number, so the estimate is a decaying
    average; blocks start early enough for the starting value to vanish in rounding.
    """
    return with_residual_bps(walk_blocks(df, [kalman_walk(col, q, r, p0, layout)], layout), col)


# ---------------------------------------------------------------- wavelets

def _decompose_rows(col: str, level: int, wavelet: str = "haar") -> int:
    return (len(FILTERS[wavelet]) - 1) * (2 ** level - 1)


@windowed(lookback=lambda col="close", level=2, wavelet="haar": _decompose_rows(col, level, wavelet))
def wavelet_decompose(df: DataFrame, w, col: str = "close", level: int = 2, wavelet: str = "haar") -> DataFrame:
    """Trend and details of an undecimated transform that looks only backwards.

    Level j averages values 2**(j-1) rows apart with the filter; the detail is what the average
    removes, so trend + all details give the series back.  Before the series start the current
    value stands in for the missing ones.
    """
    taps = [h / sum(FILTERS[wavelet]) for h in FILTERS[wavelet]]
    out = df.withColumn("_a", F.col(col))
    for j in range(1, level + 1):
        gap = 2 ** (j - 1)
        smooth: Column = F.lit(0.0)
        for k, h in enumerate(taps):
            value = F.col("_a") if k == 0 else F.coalesce(F.lag("_a", gap * k).over(w), F.col("_a"))
            smooth = smooth + F.lit(h) * value
        out = out.withColumn("_s", smooth).withColumns(
            {f"detail_{j}": F.col("_a") - F.col("_s"), "_a": F.col("_s")}
        )
    return out.withColumnRenamed("_a", "wavelet_trend").drop("_s")


class RunningDeviation:
    """Scaled median deviation of the values so far, kept as one sorted list."""

    def __init__(self):
        self.values: list[float] = []
        self.rows = 0

    def step(self, value: float | None) -> float:
        self.rows += 1
        if value is not None and value == value:
            insort(self.values, value)
        n = len(self.values)
        if n == 0:
            return np.nan
        low, high = self.values[(n - 1) // 2], self.values[n // 2]
        centre = low + 0.5 * (high - low)
        split = bisect_left(self.values, centre)
        near = self._nearest((n - 1) // 2, centre, split)
        far = near if n % 2 else self._nearest(n // 2, centre, split)
        return (near + 0.5 * (far - near)) / MAD_UNIT

    def _nearest(self, k: int, centre: float, split: int) -> float:
        """The k-th smallest distance to ``centre``; the values before ``split`` lie below it.

        The k + 1 nearest values are ``i`` of those below and the rest of those above; ``i`` is found by halving.
        """
        v, n = self.values, len(self.values)
        lo, hi = max(0, k + 1 - (n - split)), min(k + 1, split)
        while lo < hi:
            i = (lo + hi) // 2
            if abs(v[split - 1 - i] - centre) < abs(v[split + k - i] - centre):
                lo = i + 1
            else:
                hi = i
        below = abs(v[split - lo] - centre) if lo else 0.0
        above = abs(v[split + k - lo] - centre) if lo <= k else 0.0
        return max(below, above)


def _noise_so_far(rows: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Add ``_sigma`` and ``_n`` of the rows of the period up to each row."""

    def fn(state: RunningDeviation, pdf: pd.DataFrame) -> pd.DataFrame:
        first = state.rows
        sigma = [state.step(x) for x in pdf["detail_1"].tolist()]
        return pdf.assign(_sigma=sigma, _n=np.arange(first + 1, first + 1 + len(pdf), dtype="int64"))

    added = [T.StructField("_sigma", T.DoubleType()), T.StructField("_n", T.LongType())]
    return keyed_fold(rows, keys, [idx], RunningDeviation, fn, added)


def _noise_of_period(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_sigma`` and ``_n`` of the whole period, later rows included."""
    centre = rows.groupBy(*keys).agg(
        F.percentile("detail_1", 0.5).alias("_med"), F.count(F.lit(1)).alias("_n")
    )
    spread = (
        rows.join(centre, keys).groupBy(*keys)
        .agg((F.percentile(F.abs(F.col("detail_1") - F.col("_med")), 0.5) / MAD_UNIT).alias("_sigma"),
             F.max("_n").alias("_n"))
    )
    return rows.join(spread, keys)


def wavelet_denoise(
    df: DataFrame, col: str = "close", level: int = 2, wavelet: str = "haar", mode: str = "soft",
    rule: str = "universal", period_seconds: int = 86_400, ts: str = "open_time", layout: Layout = BARS,
    causal: bool = True,
) -> DataFrame:
    """Shrink the details by a threshold per series and period, then add everything up.

    The noise level is the scaled median deviation of the finest detail of the rows of the period up to this one
    (null and NaN details left out), so later rows change nothing; the first row of a period is not shrunk.  One
    period of a series is walked in one task, whose memory is eight bytes and a list slot per row of the period.
    ``causal=False`` takes the level of the whole period, for tables that are read as a whole.
    """
    parts = wavelet_decompose(df, col, level, wavelet, layout=layout)
    keys = [*layout.by, "_period"]
    rows = parts.withColumn("_period", time_slice(ts, period_seconds))
    noisy = _noise_so_far(rows, keys, layout.idx) if causal else _noise_of_period(rows, keys)
    n = F.col("_n").cast("double")
    if rule == "minimax":
        factor = F.when(n <= 32, F.lit(0.0)).otherwise(0.3936 + 0.1829 * F.log2(n))
    elif rule in ("universal", "sqtwolog", "sure"):
        factor = F.sqrt(2 * F.log(n))
    else:
        raise ValueError(f"unknown threshold rule {rule}")
    limited = noisy.withColumn("_limit", F.col("_sigma") * factor)
    total = F.col("wavelet_trend")
    for j in range(1, level + 1):
        d = F.col(f"detail_{j}")
        if mode == "soft":
            kept = F.signum(d) * F.greatest(F.abs(d) - F.col("_limit"), F.lit(0.0))
        else:
            kept = F.when(F.abs(d) > F.col("_limit"), d).otherwise(F.lit(0.0))
        total = total + kept
    return limited.withColumn("denoised", total).drop("_period", "_limit", "_sigma", "_n")


@windowed(lookback=lambda level=2, n=20, trend_rows=100, col="close": max(n, trend_rows - 1))
def wavelet_features(
    df: DataFrame, w, level: int = 2, n: int = 20, trend_rows: int = 100, col: str = "close"
) -> DataFrame:
    """Energy and rolling deviation of the details, share of the trend in the price variance."""
    prior, recent = w.rowsBetween(-n, -1), w.rowsBetween(1 - trend_rows, 0)
    full = F.count(F.lit(1)).over(prior) == n
    out = {}
    for j in range(1, level + 1):
        d = F.col(f"detail_{j}")
        out[f"wavelet_energy_{j}"] = d * d
        out[f"wavelet_volatility_{j}"] = F.when(full, F.stddev_pop(d).over(prior))
    ratio = F.var_pop("wavelet_trend").over(recent) / (F.var_pop(col).over(recent) + 1e-10)
    return df.withColumns({**out, "wavelet_trend_ratio": ratio})


def as_signals(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per bar and price column, so one transform serves many signals."""
    pairs = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("value")) for c in columns])
    return bars.select("symbol", "bar_idx", "open_time", F.explode(pairs).alias("p")).select(
        "symbol", "bar_idx", "open_time", "p.signal", "p.value"
    )


def denoise(
    df: DataFrame, mode: str = "kalman", col: str = "close", wavelet: str = "haar", level: int = 2,
    layout: Layout = BARS, causal: bool = True, **kalman_params: float,
) -> DataFrame:
    """``none``, ``wavelet``, ``kalman``, ``adaptive`` or ``combined``; keeps the original column."""
    if mode == "none":
        return df.withColumn("denoised", F.col(col))
    if mode == "kalman":
        return kalman(df, col, layout=layout, **kalman_params).withColumn("denoised", F.col("kalman"))
    if mode == "adaptive":
        return adaptive_kalman(df, col).withColumn("denoised", F.col("kalman"))
    smooth = wavelet_denoise(df, col, level, wavelet, layout=layout, causal=causal)
    if mode == "wavelet":
        return smooth
    if mode == "combined":
        renamed = smooth.withColumnRenamed("denoised", "_wave")
        return kalman(renamed, "_wave", layout=layout, **kalman_params).withColumn(
            "denoised", F.col("kalman")
        ).drop("_wave")
    raise ValueError(f"unknown mode {mode}")
