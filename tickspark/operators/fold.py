"""Recurrences whose state cannot be summarised: walked in order along each series.

Rows are dealt by key, sorted on disk and passed in batches, from one to the next of which only the state
goes, so memory does not grow with the series.  One series is one task, as each state needs the one before.
Where ``session_seconds`` is given, the key includes a session (a fixed span of time), at which the state
starts anew, and tasks hold sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.operators.bars import with_mid_spread
from tickspark.operators.index import time_slice

SESSION = "_session"


def keyed_fold(
    df: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], Any],
    fn: Callable[[Any, pd.DataFrame], pd.DataFrame], added: Sequence[T.StructField],
) -> DataFrame:
    """Run ``fn`` on the ordered rows of each key, stretch by stretch; it returns the rows with the added columns.

    ``fn`` gets the state, which is ``start()`` at the first row of a key, and changes it in place.
    """
    schema = T.StructType([*df.schema.fields, *added])
    names, by = schema.fieldNames(), list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[by]
            other = ((keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())).any(axis=1).to_numpy()
            other[0] = True
            edges = [*np.flatnonzero(other).tolist(), len(pdf)]
            for lo, hi in zip(edges, edges[1:]):
                here = tuple(None if pd.isna(x) else x for x in keys.iloc[lo])
                if here != key:
                    key, state = here, start()
                yield fn(state, pdf.iloc[lo:hi].reset_index(drop=True))[names]

    out = df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
    doubles = [f.name for f in added if isinstance(f.dataType, T.DoubleType)]
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else out


def with_session(df: DataFrame, ts: str, seconds: int | None) -> DataFrame:
    """Add the session of each row; all of a series are in one where ``seconds`` is None."""
    return df.withColumn(SESSION, F.lit(0).cast("long") if seconds is None else time_slice(ts, seconds))


# ---------------------------------------------------------------- imbalance bars

class ImbalanceBars:
    """Bar number per tick, and whether the tick closes its bar.

    A bar closes when the absolute sum of tick directions reaches the expected number of ticks
    times the expected absolute imbalance; both expectations then move towards the closed bar.
    """

    def __init__(self, expected_ticks: float = 50.0, expected_imbalance: float = 0.5, alpha: float = 0.1):
        self.ticks, self.imbalance, self.alpha = expected_ticks, expected_imbalance, alpha
        self.bar, self.total, self.count = 0, 0.0, 0
        #: Ticks seen, and the last mid.
        self.seen, self.mid = 0, None

    def step(self, step: float) -> tuple[int, bool]:
        self.total += 0.0 if self.count == 0 else step
        self.count += 1
        bar, done = self.bar, abs(self.total) >= self.ticks * self.imbalance
        if done:
            self.ticks = self.alpha * self.count + (1 - self.alpha) * self.ticks
            self.imbalance = self.alpha * abs(self.total) / self.count + (1 - self.alpha) * self.imbalance
            self.bar, self.total, self.count = bar + 1, 0.0, 0
        return bar, done


def imbalance_bar_ids(
    steps: Sequence[float], expected_ticks: float = 50.0, expected_imbalance: float = 0.5,
    alpha: float = 0.1,
) -> tuple[list[int], list[bool]]:
    """Bar number per tick of one series, and whether the tick closes its bar."""
    state = ImbalanceBars(expected_ticks, expected_imbalance, alpha)
    found = [state.step(step) for step in steps]
    return [bar for bar, _ in found], [done for _, done in found]


def imbalance_bars(
    ticks: DataFrame, expected_ticks: float = 50.0, expected_imbalance: float = 0.5,
    alpha: float = 0.1, session_seconds: int | None = None,
) -> DataFrame:
    """Tick-imbalance bars over the whole series.

    With ``session_seconds``, expectations and the open bar restart in every session; without, ``bar_in_session``
    counts the bars of the series and ``session_start`` is null.
    """
    rows = with_session(
        with_mid_spread(ticks.filter((F.col("bid") > 0) & (F.col("ask") > 0))), "ts", session_seconds
    ).select("symbol", SESSION, "ts", "seq", "mid", "spread")

    def fold(state: ImbalanceBars, pdf: pd.DataFrame) -> pd.DataFrame:
        mid = pdf["mid"].to_numpy()
        steps = np.sign(np.diff(mid, prepend=mid[0] if state.mid is None else state.mid))
        found = [state.step(x) for x in steps.tolist()]
        position = state.seen + np.arange(len(pdf))
        state.seen, state.mid = state.seen + len(pdf), mid[-1]
        return pdf.assign(bar_in_session=[b for b, _ in found], closes_bar=[c for _, c in found], _pos=position, _step=steps)

    added = [
        T.StructField("bar_in_session", T.LongType()), T.StructField("closes_bar", T.BooleanType()),
        T.StructField("_pos", T.LongType()), T.StructField("_step", T.DoubleType()),
    ]
    folded = keyed_fold(
        rows, ["symbol", SESSION], ["ts", "seq"], lambda: ImbalanceBars(expected_ticks, expected_imbalance, alpha), fold, added
    )
    bars = folded.groupBy("symbol", SESSION, "bar_in_session").agg(
        F.min("ts").alias("open_time"), F.max("ts").alias("close_time"),
        F.min_by("mid", "_pos").alias("open"), F.max("mid").alias("high"),
        F.min("mid").alias("low"), F.max_by("mid", "_pos").alias("close"),
        F.count(F.lit(1)).alias("tick_count"), F.sum("spread").alias("spread_sum"),
        (F.sum("_step") - F.min_by("_step", "_pos")).alias("imbalance"),
        F.bool_or("closes_bar").alias("is_complete"),
    )
    start = F.timestamp_micros(F.col(SESSION) * ((session_seconds or 0) * 1_000_000))
    return bars.withColumn("session_start", start if session_seconds else F.when(F.lit(False), start))


# ---------------------------------------------------------------- adaptive Kalman

class AdaptiveKalman:
    """Random-walk filter that tunes its noise levels from recent innovations."""

    def __init__(self, q: float = 0.1, r: float = 1.0, p0: float = 100.0, rate: float = 0.1, window: int = 20):
        self.q0, self.q, self.r, self.p = q, q, r, p0
        self.rate, self.window = rate, window
        self.x: float | None = None
        self.recent: list[float] = []

    def step(self, z: float) -> tuple[float, float, float]:
        """(estimate, residual, gain) after seeing ``z``."""
        if self.x is None:
            self.x, residual, gain = z, 0.0, 1.0
        else:
            ahead = self.p + self.q
            gain = ahead / (ahead + self.r)
            residual = z - self.x
            self.x += gain * residual
            self.p = (1 - gain) * ahead
        self.recent = [*self.recent, residual][-self.window:]
        if len(self.recent) >= self.window // 2:
            self._tune()
        return self.x, residual, gain

    def _tune(self) -> None:
        ratio = float(np.var(self.recent)) / (self.q + self.r + 1e-10)
        half = self.rate * 0.5
        if ratio > 1.5:
            self.r *= 1 + half
        elif ratio < 0.5:
            self.r = max(self.r * (1 - half), 0.01)
        last = self.recent[-3:]
        if len(last) == 3 and (min(last) > 0 or max(last) < 0):
            self.q *= 1 + self.rate
        elif len(last) == 3:
            small = self.rate * 0.1
            self.q = self.q * (1 - small) + self.q0 * small


def adaptive_kalman(
    bars: DataFrame, col: str = "close", session_seconds: int | None = None, ts: str = "open_time",
    order: Sequence[str] = ("bar_idx",), **params: float,
) -> DataFrame:
    """Adaptive Kalman estimate along each series, or per session of it where ``session_seconds`` is given."""
    def fold(flt: AdaptiveKalman, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.array([flt.step(z) for z in pdf[col].tolist()])
        return pdf.assign(kalman=out[:, 0], kalman_residual=out[:, 1], kalman_gain=out[:, 2])

    added = [T.StructField(c, T.DoubleType()) for c in ("kalman", "kalman_residual", "kalman_gain")]
    rows = with_session(bars, ts, session_seconds)
    out = keyed_fold(rows, ["symbol", SESSION], order, lambda: AdaptiveKalman(**params), fold, added)
    bps = F.when(F.col(col) > 0, F.col("kalman_residual") / F.col(col) * 1e4).otherwise(F.lit(0.0))
    return out.withColumn("kalman_residual_bps", bps).drop(SESSION)


# ---------------------------------------------------------------- counter-trend cap

def counter_cap(
    entries: DataFrame, window: int = 20, max_ratio: float = 0.3, min_samples: int = 5,
    session_seconds: int | None = None, ts: str = "ts", order: Sequence[str] = ("ts", "seq"),
    alignment: str = "trend_alignment",
) -> DataFrame:
    """Skip counter-trend entries while they are too frequent among the last accepted ones.

    Skipped entries are not remembered.  Input: candidate entries only.  The last accepted entries are forgotten
    at the edges of sessions only where ``session_seconds`` is given.
    """
    def fold(past: list[bool], pdf: pd.DataFrame) -> pd.DataFrame:
        accepted = []
        for value in pdf[alignment]:
            counter = value == "COUNTER"
            full = len(past) >= min_samples and sum(past) / max(1, len(past)) >= max_ratio
            ok = not (counter and full)
            accepted.append(ok)
            if ok:
                past.append(counter)
                del past[:-window]
        return pdf.assign(accepted=accepted)

    rows = with_session(entries, ts, session_seconds)
    added = [T.StructField("accepted", T.BooleanType())]
    return keyed_fold(rows, ["symbol", SESSION], order, list, fold, added).drop(SESSION)

