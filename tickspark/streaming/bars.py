"""Event bars and time bars on streams."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tickspark.operators.bars import tick_bars, with_mid_spread
from tickspark.streaming.run import use_rocksdb

BAR_FIELDS = (
    "bar_idx", "open_us", "close_us", "open", "high", "low", "close", "tick_count", "volume",
    "buy_count", "sell_count", "spread_sum",
)
INTEGERS = ("bar_idx", "open_us", "close_us", "tick_count", "buy_count", "sell_count")
BAR_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("symbol", T.StringType()),
        T.StructField("late_seq", T.LongType()), T.StructField("late_us", T.LongType()),
        *[T.StructField(f, T.LongType() if f in INTEGERS else T.DoubleType()) for f in BAR_FIELDS],
    ]
)


class OpenBar:
    """The bar being built; its whole state is a list of numbers."""

    def __init__(self, n: int, values: list[float] | None = None):
        self.n = n
        self.values = list(values) if values is not None else [0.0] + [math.nan] * 6 + [0.0] * 5

    def push(self, us: int, mid: float, spread: float, volume: float) -> list[float] | None:
        """Add a tick; returns the finished bar when it is the last one."""
        v = self.values
        if v[7] == 0:
            v[1:7] = [us, us, mid, mid, mid, mid]
        else:
            v[9] += mid > v[6]
            v[10] += mid < v[6]
            v[2], v[4], v[5], v[6] = us, max(v[4], mid), min(v[5], mid), mid
        v[7] += 1
        v[8] += volume
        v[11] += spread
        if v[7] < self.n:
            return None
        self.values = [v[0] + 1] + [math.nan] * 6 + [0.0] * 5
        return v


class BarProcessor(StatefulProcessor):
    """Ticks of one symbol to bars.

    Ticks wait until they are ``delay_ms`` older than the newest tick of the symbol and are then
    used in time order.  A tick older than what was already used is put out as a ``late`` row.
    With ``timed`` an event-time timer stands at the end of the wait of the newest tick, so a symbol that
    goes quiet gives its last ticks once the watermark has passed.
    """

    def __init__(self, n: int, delay_ms: int, timed: bool = False):
        self.n, self.delay_us, self.timed = n, delay_ms * 1000, timed

    def init(self, handle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "v array<double>")
        self.clock = handle.getValueState("clock", "newest long, used long")
        self.waiting = handle.getListState(
            "waiting", "us long, seq long, mid double, spread double, volume double"
        )

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.bar.update(([float(x) for x in first["bar_state"]],))
        self.clock.update((int(first["newest_us"]), int(first["newest_us"])))

    def handleInputRows(self, key, rows, timerValues):
        newest, used = self.clock.get() if self.clock.exists() else (-1, -1)
        open_bar = OpenBar(self.n, self.bar.get()[0] if self.bar.exists() else None)
        pending = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        late, fresh = [], []
        for pdf in rows:
            for tick in pdf[["us", "seq", "mid", "spread", "volume"]].itertuples(index=False, name=None):
                (late if tick[0] < used else fresh).append(tick)
        pending = sorted([*pending, *fresh], key=lambda t: (t[0], t[1]))
        newest = max([newest, *[t[0] for t in fresh]])
        out = [("late", key[0], int(t[1]), int(t[0]), *[None] * len(BAR_FIELDS)) for t in late]
        yield self._use(key, open_bar, pending, newest, used, newest - self.delay_us, out)
        if self.timed:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if self.waiting.exists():
                self.handle.registerTimer(int(newest + self.delay_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Nothing came behind the newest tick while it waited: use all that waits."""
        newest, used = self.clock.get()
        open_bar = OpenBar(self.n, self.bar.get()[0])
        pending = sorted((tuple(r) for r in self.waiting.get()), key=lambda t: (t[0], t[1])) if self.waiting.exists() else []
        yield self._use(key, open_bar, pending, newest, used, newest, [])

    def _use(self, key, open_bar: OpenBar, pending: list, newest: int, used: int, until: int, out: list) -> pd.DataFrame:
        """Use the waiting ticks up to ``until`` and keep the rest."""
        ready = [t for t in pending if t[0] <= until]
        for us, _, mid, spread, volume in ready:
            done = open_bar.push(us, mid, spread, volume)
            if done is not None:
                out.append(("bar", key[0], None, None, *done))
        if ready:
            used = ready[-1][0]
        # A whole number in an array of doubles would be read back as NULL.
        self.bar.update(([float(v) for v in open_bar.values],))
        self.clock.update((int(newest), int(used)))
        rest = pending[len(ready):]
        if rest:
            self.waiting.put([(int(t[0]), int(t[1]), *map(float, t[2:])) for t in rest])
        elif self.waiting.exists():
            self.waiting.clear()
        frame = pd.DataFrame(out, columns=BAR_SCHEMA.fieldNames())
        for c in ("late_seq", "late_us", *INTEGERS):
            frame[c] = frame[c].astype("float64").astype("Int64")
        return frame

    def close(self) -> None:
        pass


def _tick_rows(stream: DataFrame, clock: str | None = None) -> DataFrame:
    quotes = with_mid_spread(stream.filter((F.col("bid") > 0) & (F.col("ask") > 0)))
    volume = F.col("last_volume") if "last_volume" in stream.columns else F.lit(1.0)
    return quotes.select(
        "symbol", F.unix_micros("ts").alias("us"), "seq", "mid", "spread", volume.cast("double").alias("volume"),
        *([F.col(clock).alias("clock")] if clock else []),
    )


def stream_bars(
    stream: DataFrame, n: int = 100, delay_ms: int = 0, history: DataFrame | None = None,
    clock: str | None = None, watermark: str = "0 seconds",
) -> DataFrame:
    """Rows of kind ``bar`` as bars close, and of kind ``late`` for ticks that came too late.

    ``history`` (:func:`bar_state`) continues bars from a batch of earlier ticks.  ``clock`` names the
    column whose watermark releases the waiting ticks of a quiet symbol: the time of receipt where the
    feed has one.  With the tick's own time, Spark drops ticks behind the watermark before they can be put out as
    late, so ``watermark`` must then be as long as any tick may be late.
    """
    use_rocksdb(stream.sparkSession)
    rows = _tick_rows(stream, clock)
    if clock:
        rows = rows.withWatermark("clock", watermark)
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=BarProcessor(n, delay_ms, clock is not None), outputStructType=BAR_SCHEMA,
        outputMode="Append", timeMode="EventTime" if clock else "None",
        initialState=history.groupBy("symbol") if history is not None else None,
    )


def finished_bars(rows: DataFrame) -> DataFrame:
    """Bar columns as the batch operator gives them."""
    sides = F.col("buy_count") + F.col("sell_count")
    return rows.filter(F.col("kind") == "bar").select(
        "symbol", "bar_idx", F.timestamp_micros("open_us").alias("open_time"),
        F.timestamp_micros("close_us").alias("close_time"), "open", "high", "low", "close", "tick_count",
        "volume", (F.col("buy_count") - F.col("sell_count")).alias("imbalance"),
        ((F.col("buy_count") - F.col("sell_count")) / F.greatest(F.lit(1), sides)).alias("imbalance_ratio"),
        "buy_count", "sell_count", (F.col("tick_count") - sides).alias("neutral_count"), "spread_sum",
        ((F.col("close_us") - F.col("open_us")) / 1000.0).alias("duration_ms"),
    )


def late_ticks(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == "late").select(
        "symbol", F.col("late_seq").alias("seq"), F.timestamp_micros("late_us").alias("ts")
    )


def bar_state(ticks: DataFrame, n: int = 100) -> DataFrame:
    """State to start a stream from: the open bar after ``ticks``, one row per symbol.

    Nothing is put out for the history; the bars in it are counted by :func:`tick_bars`.
    """
    partial = tick_bars(ticks, n, emit_partial=True)
    per_symbol = partial.groupBy("symbol").agg(
        F.max_by(F.struct("*"), "bar_idx").alias("b"), F.max("close_time").alias("_newest")
    )
    zero, nan = F.lit(0.0), F.lit(float("nan"))
    open_values = [
        "b.bar_idx", F.unix_micros("b.open_time"), F.unix_micros("b.close_time"), "b.open", "b.high",
        "b.low", "b.close", "b.tick_count", "b.volume", "b.buy_count", "b.sell_count", "b.spread_sum",
    ]
    current = F.array(*[(F.col(v) if isinstance(v, str) else v).cast("double") for v in open_values])
    fresh = F.array((F.col("b.bar_idx") + 1).cast("double"), *[nan] * 6, *[zero] * 5)
    return per_symbol.select(
        "symbol", F.when(F.col("b.tick_count") == n, fresh).otherwise(current).alias("bar_state"),
        F.unix_micros("_newest").alias("newest_us"),
    )


def stream_time_bars(stream: DataFrame, interval: str = "15 minutes", watermark: str = "1 minute") -> DataFrame:
    """Tumbling OHLC of the mid, put out when the watermark passes the end of a window."""
    rows = with_mid_spread(stream.filter((F.col("bid") > 0) & (F.col("ask") > 0)))
    grouped = rows.withWatermark("ts", watermark).groupBy("symbol", F.window("ts", interval).alias("w"))
    order = F.struct("ts", "seq")
    return grouped.agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"),
        F.max_by("mid", order).alias("close"), F.count(F.lit(1)).alias("tick_volume"),
    ).select("symbol", F.col("w.start").alias("start_time"), "open", "high", "low", "close", "tick_volume")


