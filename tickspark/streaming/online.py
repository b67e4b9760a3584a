"""All features per bar as it arrives, with the values of the batch table.

One stateful step per symbol keeps what the features need of the past: the last rows for windows, the state of
each recurrence (the kernels of the batch scans, continued from where they stopped), live gaps, the volume bucket
and the higher-timeframe bar in progress.  All of it is bounded by window lengths.  What is made row by row from
these columns are the expressions of the batch plan, applied to the stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tickspark.operators import calendar, gaps, price, trend
from tickspark.operators.denoise import FILTERS, kalman_gains
from tickspark.operators.price import EPSILON, TEMPERATURE_SCALE
from tickspark.operators.scan import Kernel, LastKnown, PivotCenter, Stage, VolumeReset
from tickspark.plans.features import (
    HIGHER_COLUMNS, INTENSITY_ALPHA, MICRO_VOL_LAMBDA, FeatureConfig, combined, finished,
)
from tickspark.streaming.run import use_rocksdb

PRICES = ("open", "high", "low", "close")
IN_COLUMNS = ("bar_idx", "open_us", *PRICES, "tick_count", "spread_sum", "imbalance", "duration_ms")
#: Rows of the past that windows need besides the bar columns: made here, so kept here.
MADE = ("log_return", "vpin", "st_line")
GAP_NAMES = tuple(gaps.ACTIVE_FIELDS.fieldNames())
WHOLE = ("fvg_age_bars", "ce_bull_idx", "ce_bear_idx")
EVENT_NAMES = ("_ev_idx", "_ev_close", "_ev_up", "_ev_dn")
OUT_COLUMNS = (
    "log_return", "log_return_zscore", "ofi_count", "ofi_weighted", "kyle_lambda_pct", "realized_volatility_pct",
    "market_temperature", "market_entropy", "tick_intensity", "micro_volatility_pct", "pdi",
    "vpin", "vpin_zscore", "kalman_residual_bps", "kalman_gain", "wavelet_energy_1", "wavelet_energy_2", "wavelet_trend_ratio",
    "atr", "fvg_type", "gap_top", "gap_bottom", "gap_size", *GAP_NAMES, "_kept", *EVENT_NAMES,
    "st_dir", "st_line", "trend_duration", "range_break", "_break_before", "_since", *HIGHER_COLUMNS,
)
#: Recurrences over bars, over rows that may begin a session, and over higher-timeframe bars.
STATE = (
    "kernels array<array<double>>, higher_kernels array<array<double>>, scalars array<double>, live array<array<double>>, "
    "buckets array<array<double>>, higher_bar array<double>, higher_rows array<array<double>>, higher_now array<double>"
)


# ---------------------------------------------------------------- windows

def windows(x: np.ndarray, n: int, own: int) -> np.ndarray:
    """The last ``n`` values at each of the last ``own`` rows, NaN where there are none."""
    padded = np.concatenate([np.full(n - 1, np.nan), x])[len(x) - own:] if n > 1 else x[len(x) - own:]
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def lagged(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(len(x) - k, 0)]])


def known(w: np.ndarray) -> np.ndarray:
    return (~np.isnan(w)).sum(1)


def total(w: np.ndarray) -> np.ndarray:
    return np.nansum(w, axis=1)


def mean(w: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return total(w) / known(w)


def variance(w: np.ndarray) -> np.ndarray:
    return mean((w - mean(w)[:, None]) ** 2)


def full(w: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value where the whole window is known."""
    return np.where(known(w) == w.shape[1], value, np.nan)


def zscore(x: np.ndarray, n: int, own: int) -> np.ndarray:
    """(x - mean) / deviation over up to ``n`` rows, 0 below 3 rows or if flat."""
    w = windows(x, n, own)
    std = np.sqrt(variance(w))
    ready = (known(w) >= 3) & (std > EPSILON)
    return np.where(ready, (x[len(x) - own:] - mean(w)) / np.where(ready, std, 1.0), 0.0)


def returns(close: np.ndarray) -> np.ndarray:
    """ln(close / previous close), 0 on the first bar and next to a close of 0."""
    before = lagged(close, 1)
    good = (close > 0) & (before > 0)
    return np.where(good, np.log(np.where(good, close, 1.0) / np.where(good, before, 1.0)), 0.0)


def true_ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = lagged(close, 1)
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def pivots(high: np.ndarray, low: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Strict local extremes of ``k`` rows on both sides, reported ``k`` rows later."""
    found = []
    for x, best in ((high, np.fmax), (low, np.fmin)):
        w = windows(x, 2 * k + 1, own)
        left, right, middle = best.reduce(w[:, :k], axis=1), best.reduce(w[:, k + 1:], axis=1), w[:, k]
        beats = (middle > np.fmax(left, right)) if best is np.fmax else (middle < np.fmin(left, right))
        found.append(np.where((known(w[:, :k]) == k) & beats, middle, np.nan))
    return found[0], found[1]


def details(close: np.ndarray, level: int, wavelet: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Details and trend of the transform that looks only backwards."""
    taps = np.array(FILTERS[wavelet]) / sum(FILTERS[wavelet])
    a, out = close, []
    for j in range(level):
        smooth = np.zeros(len(a))
        for k, h in enumerate(taps):
            before = lagged(a, k << j)
            smooth = smooth + h * np.where(np.isnan(before), a, before)
        out.append(a - smooth)
        a = smooth
    return out, a


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z.tolist()])


# ---------------------------------------------------------------- recurrences

def scan(rows: pd.DataFrame, stages: Sequence[Stage], states: list[list[float]]) -> tuple[pd.DataFrame, list[list[float]]]:
    """Continue the stages of a batch scan over new rows; ``states`` has one state per kernel in order."""
    after, at = [], 0
    for stage in stages:
        if callable(stage):
            rows = rows.assign(**stage(rows))
            continue
        added = {}
        for kernel in [stage] if isinstance(stage, Kernel) else stage:
            state = list(states[at])
            at += 1
            found = kernel.replay(rows, state)
            if isinstance(kernel, PivotCenter):
                # The summary gives the centre up to rounding; the walk itself ends with it.
                after.append([float(found[c][-1]) for c in (kernel.last, kernel.center)])
            else:
                after.append(kernel.advance(state, [float(x) for x in kernel.summarize(rows)]))
            added |= found
        rows = rows.assign(**added)
    return rows, after


def first_states(stages: Sequence[Stage]) -> list[list[float]]:
    return [k.initial() for s in stages if not callable(s) for k in ([s] if isinstance(s, Kernel) else s)]


def trend_inputs(rows: pd.DataFrame, own: int, cfg: trend.SuperTrend) -> dict[str, np.ndarray]:
    """What the SuperTrend stages need, for the last ``own`` rows."""
    high, low, close = (rows[c].to_numpy() for c in ("high", "low", "close"))
    top, bottom = pivots(high, low, cfg.lookback, own)
    return {
        "prev_close": lagged(close, 1)[len(close) - own:], "st_atr": mean(windows(true_ranges(high, low, close), cfg.atr_rows, own)),
        "pivot_high": top, "pivot_low": bottom, "pivot": np.where(np.isnan(bottom), top, bottom),
    }


def trend_line(rows: pd.DataFrame) -> np.ndarray:
    side = rows["st_dir"].to_numpy()
    return np.select([side == 1, side == -1], [rows["tup"], rows["tdown"]], rows["center"].fillna(0.0))


class Online:
    """The features of one series, moved on by each call of :meth:`add`; ``past`` and ``state`` are plain lists."""

    def __init__(self, cfg: FeatureConfig, past: Sequence[Sequence[float]] | None = None, state: Sequence | None = None):
        self.cfg = cfg
        self.volume = VolumeReset("tick_count", cfg.bucket_volume)
        self.stages = [
            *trend.supertrend_stages(cfg.trend), *gaps.event_stages(cfg.cooldown_bars, 3),
            [LastKnown({"_session_start": "_since"}), gaps.structure_stage(), self.volume],
        ]
        self.higher_stages = trend.supertrend_stages(cfg.trend)
        self.gains = np.array(kalman_gains(0.1, 1.0, 100.0))[:, 0]
        span = (len(FILTERS[cfg.wavelet]) - 1) * 3
        self.keep = max(
            cfg.zscore_rows, cfg.kyle_rows + 1, cfg.thermo_rows, cfg.volatility_rows, cfg.atr_rows + 1, cfg.sigma_rows, cfg.ofi_rows,
            cfg.trend.atr_rows + 1, 2 * cfg.trend.lookback + 1, 100 + span, 22,
        )
        self.names = [*IN_COLUMNS, *MADE]
        self.past = pd.DataFrame(dict(zip(self.names, past)) if past else {c: [] for c in self.names}, dtype="float64")
        nan = math.nan
        if state is None:
            state = (
                first_states(self.stages), first_states(self.higher_stages),
                # intensity, variance, Kalman estimate, session before, bucket's buys less sells, its volume, vpin
                [nan, nan, nan, float(calendar.CLOSED), 0.0, 0.0, nan], [], [], [], [], [nan] * len(HIGHER_COLUMNS),
            )
        (self.kernels, self.higher_kernels, self.scalars, self.live, self.buckets, self.higher_bar, self.higher_rows,
         self.higher_now) = [[list(v) if isinstance(v, (list, tuple)) else v for v in part] for part in state]

    def state(self) -> tuple:
        return tuple(
            [[float(v) for v in p] if isinstance(p, list) else float(p) for p in part]
            for part in (self.kernels, self.higher_kernels, self.scalars, self.live, self.buckets, self.higher_bar,
                         self.higher_rows, self.higher_now)
        )

    def add(self, new: pd.DataFrame) -> pd.DataFrame:
        """Columns :data:`OUT_COLUMNS` of bars that follow those seen, in order of ``bar_idx``."""
        cfg, own = self.cfg, len(new)
        rows = pd.concat([self.past, new], ignore_index=True)
        close = rows["close"].to_numpy()
        rows["log_return"] = np.where(np.arange(len(rows)) < len(self.past), rows["log_return"], returns(close))
        out = self._windows(rows, own)
        fresh = rows.iloc[len(rows) - own:].reset_index(drop=True)
        flow = self._volume(fresh, out.pop("_sigma"))
        out |= self._recursive(fresh) | self._higher(fresh)

        walk = fresh.assign(**trend_inputs(rows, own, cfg.trend), **self._gap(rows, own), **self._breaks(rows, own))
        walk["_session_start"] = self._session_starts(fresh)
        walk, self.kernels = scan(walk, self.stages, self.kernels)
        walk["st_line"] = trend_line(walk)
        live = pd.DataFrame(gaps.active_rows(walk, "bar_idx", cfg.gap_max_age, 10, 5.0, self.live), columns=GAP_NAMES)

        rows.loc[len(rows) - own:, "vpin"] = flow(walk)
        rows.loc[len(rows) - own:, "st_line"] = walk["st_line"].to_numpy()
        out["vpin"] = rows["vpin"].to_numpy()[len(rows) - own:]
        out["vpin_zscore"] = zscore(np.nan_to_num(rows["vpin"].to_numpy()), cfg.zscore_rows, own)
        for c in (*GAP_NAMES, "atr", "fvg_type", "gap_top", "gap_bottom", "gap_size", "_kept", *EVENT_NAMES, "st_dir", "st_line",
                  "trend_duration", "range_break", "_break_before", "_since"):
            out[c] = (live if c in GAP_NAMES else walk)[c].to_numpy()
        self.past = rows.iloc[-self.keep:].reset_index(drop=True)
        return pd.DataFrame(out)[list(OUT_COLUMNS)].astype("float64")

    def _windows(self, rows: pd.DataFrame, own: int) -> dict[str, np.ndarray]:
        cfg, at = self.cfg, len(rows) - own
        close, ret = rows["close"].to_numpy(), rows["log_return"].to_numpy()
        dt = np.maximum(rows["duration_ms"].to_numpy(), 1.0)
        imbalance = rows["imbalance"].to_numpy()
        before = lagged(close, cfg.kyle_rows)[at:]
        ticks = total(windows(rows["tick_count"].to_numpy(), cfg.kyle_rows, own))
        percent = windows((ret * 100) ** 2, cfg.volatility_rows, own)
        thermo, spans = windows(ret, cfg.thermo_rows, own), mean(windows(dt, cfg.thermo_rows, own))
        up, down = (thermo > 0).sum(1), (thermo < 0).sum(1)
        shares = [x / np.maximum(up + down, 1) for x in (up, down)]
        (fine, coarse), smooth = details(close, 2, cfg.wavelet)
        with np.errstate(invalid="ignore", divide="ignore"):
            kyle = np.abs(close[at:] - before) / before * 100 / ticks
        sigma = windows(ret, cfg.sigma_rows, own)
        return {
            "log_return": ret[at:], "log_return_zscore": zscore(ret, cfg.zscore_rows, own),
            "ofi_count": total(windows(imbalance, cfg.ofi_rows, own)), "ofi_weighted": total(windows(imbalance / dt, cfg.ofi_rows, own)),
            "kyle_lambda_pct": np.where(ticks > 0, kyle, np.nan),
            "realized_volatility_pct": full(percent, np.sqrt(total(percent))),
            "market_temperature": full(thermo, variance(thermo) / spans * TEMPERATURE_SCALE),
            "market_entropy": full(thermo, -sum(np.where(p > 0, p * np.log(p + EPSILON), 0.0) for p in shares)),
            "wavelet_energy_1": (fine * fine)[at:], "wavelet_energy_2": (coarse * coarse)[at:],
            "wavelet_trend_ratio": variance(windows(smooth, 100, own)) / (variance(windows(close, 100, own)) + 1e-10),
            "_sigma": np.maximum(np.where(known(sigma) >= 3, np.sqrt(variance(sigma)), 1e-6), 1e-6),
        }

    def _recursive(self, fresh: pd.DataFrame) -> dict[str, list[float]]:
        intensity, var, x, *_ = self.scalars
        cols = {c: [] for c in ("tick_intensity", "micro_volatility_pct", "pdi", "kalman_residual_bps", "kalman_gain")}
        for idx, ret, close, ms in fresh[["bar_idx", "log_return", "close", "duration_ms"]].itertuples(index=False, name=None):
            inverse, square = 1 / max(math.log(max(ms, 1.0) + EPSILON), 0.1), (ret * 100) ** 2
            intensity = inverse if intensity != intensity else INTENSITY_ALPHA * inverse + (1 - INTENSITY_ALPHA) * intensity
            var = square if var != var else (1 - MICRO_VOL_LAMBDA) * square + MICRO_VOL_LAMBDA * var
            gain = float(self.gains[min(int(idx), len(self.gains) - 1)])
            residual = 0.0 if x != x else close - x
            x = close if x != x else x + gain * residual
            for c, v in zip(cols, (intensity, math.sqrt(var), float(np.sign(ret)) * intensity, residual / close * 1e4 if close > 0 else 0.0, gain)):
                cols[c].append(v)
        self.scalars[:3] = [intensity, var, x]
        return cols

    def _volume(self, fresh: pd.DataFrame, sigma: np.ndarray):
        """Buys less sells per bar now; the buckets they fall into are known after the scan."""
        share = normal_cdf(fresh["log_return"].to_numpy() / sigma)
        volume = fresh["tick_count"].to_numpy()
        net = volume * share - (volume - volume * share)

        def rate(walk: pd.DataFrame) -> list[float]:
            open_net, open_volume, value = self.scalars[4:7]
            out = []
            for closes, d, v in zip(walk["closes_bucket"], net.tolist(), volume.tolist()):
                open_net, open_volume = open_net + d, open_volume + v
                if closes:
                    self.buckets = [*self.buckets, [abs(open_net), open_volume]][-self.cfg.n_buckets:]
                    open_net = open_volume = 0.0
                    if len(self.buckets) == self.cfg.n_buckets:
                        moved, traded = (sum(b[k] for b in self.buckets) for k in (0, 1))
                        value = moved / traded if traded else 0.0
                out.append(value)
            self.scalars[4:7] = [open_net, open_volume, value]
            return out

        return rate

    def _gap(self, rows: pd.DataFrame, own: int) -> dict[str, np.ndarray]:
        at = len(rows) - own
        high, low, close = (rows[c].to_numpy() for c in ("high", "low", "close"))
        high2, low2, middle = (lagged(x, k)[at:] for x, k in ((high, 2), (low, 2), ((high + low) / 2, 1)))
        up, down = high2 < low[at:], low2 > high[at:]
        top, bottom = np.select([up, down], [low[at:], low2], np.nan), np.select([up, down], [high2, high[at:]], np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            keep = (top - bottom) / np.where(middle == 0, np.nan, middle) * 1e4 >= self.cfg.gap_min_bps
        return {
            "atr": mean(windows(true_ranges(high, low, close), self.cfg.atr_rows, own)),
            "fvg_type": np.where(keep, np.select([up, down], [1.0, -1.0], 0.0), 0.0).astype("int64"),
            "gap_top": np.where(keep, top, np.nan), "gap_bottom": np.where(keep, bottom, np.nan), "gap_size": np.where(keep, top - bottom, np.nan),
        }

    def _breaks(self, rows: pd.DataFrame, own: int, n: int = 20) -> dict[str, np.ndarray]:
        before = [windows(lagged(rows[c].to_numpy(), 1), n, own) for c in ("high", "low")]
        close = rows["close"].to_numpy()[len(rows) - own:]
        top, bottom = np.fmax.reduce(before[0], axis=1), np.fmin.reduce(before[1], axis=1)
        return {"range_break": np.select([close > top, close < bottom], [1.0, -1.0], np.nan)}

    def _session_starts(self, fresh: pd.DataFrame) -> np.ndarray:
        hour = fresh["open_us"].to_numpy() // 3_600_000_000 % 24
        inside = {m: (hour >= a) & (hour < e) for m, (a, e) in calendar.MARKET_HOURS.items()}
        code = np.select(
            [inside["NewYork"] & inside["London"], inside["NewYork"], inside["London"], inside["Asia"]], [3.0, 2.0, 1.0, 0.0], float(calendar.CLOSED)
        )
        before = np.concatenate([[self.scalars[3]], code[:-1]])
        self.scalars[3] = float(code[-1])
        return np.where((code != before) & (code != calendar.CLOSED), fresh["bar_idx"].to_numpy(), np.nan)

    def _higher(self, fresh: pd.DataFrame) -> dict[str, np.ndarray]:
        """Columns of the higher timeframe; a bar counts once one of the next period has come."""
        width = self.cfg.higher_seconds * 1_000_000
        done, seen = [], []
        bar = self.higher_bar
        for us, *prices in fresh[["open_us", *PRICES]].itertuples(index=False, name=None):
            begins = us // width * width
            if bar and begins == bar[0]:
                bar = [bar[0], bar[1], max(bar[2], prices[1]), min(bar[3], prices[2]), prices[3], bar[5]]
            else:
                if bar:
                    done.append(bar)
                bar = [begins, *prices, bar[5] + 1 if bar else 0.0]
            seen.append(len(done))
        self.higher_bar = bar
        table = np.array([self.higher_now])
        if done:
            columns = ["start", *PRICES, "bar_idx", "st_line"]
            past = pd.DataFrame(self.higher_rows, columns=columns, dtype="float64")
            both = pd.concat([past, pd.DataFrame([[*b, math.nan] for b in done], columns=columns)], ignore_index=True)
            own = both.iloc[len(past):].reset_index(drop=True)
            rows, self.higher_kernels = scan(own.assign(**trend_inputs(both, len(own), self.cfg.trend)), self.higher_stages, self.higher_kernels)
            line = trend_line(rows)
            both.loc[len(past):, "st_line"] = line
            unit = np.maximum(rows["st_atr"].to_numpy(), trend.EPSILON)
            slope = (line - lagged(both["st_line"].to_numpy(), 1)[len(past):]) / unit
            made = {
                "mid_15m_range": (rows["high"] + rows["low"]) / 2, "atr_15m": np.maximum(rows["high"] - rows["low"], 1e-10),
                "st_trend_15m": rows["st_dir"], "st_distance_15m": np.where(line > 0, (rows["close"] - line) / unit, 0.0),
                "st_bars_since_flip_15m": rows["trend_duration"], "st_slope_15m": np.nan_to_num(slope),
                "st_bandwidth_15m": 2 * self.cfg.trend.factor * rows["st_atr"],
            }
            table = np.vstack([table, np.column_stack([np.asarray(made[c], float) for c in HIGHER_COLUMNS])])
            keep = max(self.cfg.trend.atr_rows, 2 * self.cfg.trend.lookback) + 1
            self.higher_rows = both.iloc[-keep:].to_numpy().tolist()
            self.higher_now = table[-1].tolist()
        return {c: table[seen, k] for k, c in enumerate(HIGHER_COLUMNS)}


# ---------------------------------------------------------------- streams

#: Bars worked on at once: the windows of one bar hold some hundred values.
CHUNK = 4096


class FeatureProcessor(StatefulProcessor):
    """The state of one symbol's features."""

    def __init__(self, cfg: FeatureConfig):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.past = handle.getValueState("past", "rows array<array<double>>")
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([r[list(IN_COLUMNS)] for r in rows]).astype("float64").sort_values("bar_idx", ignore_index=True)
        seen = self.state.exists()
        online = Online(self.cfg, self.past.get()[0] if seen else None, self.state.get() if seen else None)
        for at in range(0, len(new), CHUNK):
            part = new.iloc[at:at + CHUNK].reset_index(drop=True)
            yield pd.concat([pd.DataFrame({"symbol": key[0]}, index=part.index), part, online.add(part)], axis=1)
        self.past.update(([online.past[c].tolist() for c in online.names],))
        self.state.update(online.state())

    def close(self) -> None:
        pass


FEATURE_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in (*IN_COLUMNS, *OUT_COLUMNS)]]
)
INTEGERS = ("bar_idx", "tick_count", "fvg_type", *GAP_NAMES[:3], *WHOLE, "st_dir", "trend_duration")
FROM_HIGHER = ("st_trend_15m", "st_bars_since_flip_15m")


def stream_features(bars: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """All features of each bar as it arrives, NULL while they warm up; bars of a symbol arrive in order of ``bar_idx``.

    Also ``market_phase`` and the structure breaks that decisions ask for.
    """
    use_rocksdb(bars.sparkSession)
    narrow = bars.withColumn("open_us", F.unix_micros("open_time")).select(
        "symbol", *[F.col(c).cast("double") for c in IN_COLUMNS]
    )
    raw = narrow.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=FeatureProcessor(cfg), outputStructType=FEATURE_SCHEMA, outputMode="Append", timeMode="None",
    )
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in OUT_COLUMNS}
    rows = raw.withColumns(numbers).withColumns({
        **{c: F.col(c).cast("long") for c in INTEGERS}, **{c: F.col(c).cast("int") for c in FROM_HIGHER},
        "_kept": F.col("_kept") == 1, "open_time": F.timestamp_micros(F.col("open_us").cast("long")),
    })
    rows = price.classify_phase(price.delta_t_log(price.spread_bps(rows)), cfg.phase_limits)
    rows = calendar.session_edges(calendar.session(calendar.cyclic_hour(calendar.calendar(rows))))
    rows = calendar.session_age(rows.withColumn("_session_start", F.lit(None)))
    rows = trend.trend_columns(gaps.structure_columns(gaps.event_columns(gaps.active_columns(rows))))
    return combined(rows).drop("open_us")


def stream_feature_table(bars: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The rows of :func:`tickspark.plans.features.feature_table`, one by one."""
    return finished(stream_features(bars, cfg))
