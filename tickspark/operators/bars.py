"""Event bars, time bars and columns derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.layout import TICKS, Layout, windowed
from tickspark.operators.index import SLICE, with_row_index
from tickspark.operators.joins import with_key_row
from tickspark.operators.scan import volume_resets

# Timeframe names and their seconds.
TIMEFRAMES = {
    "M1": 60,
    "M5": 300,
    "M15": 900,
    "M30": 1800,
    "H1": 3600,
    "H4": 14400,
    "D1": 86400,
}

BAR_COLUMNS = [
    "symbol", "bar_idx", "open_time", "close_time", "open", "high", "low", "close",
    "tick_count", "volume", "imbalance", "imbalance_ratio", "buy_count", "sell_count",
    "neutral_count", "spread_sum", "duration_ms",
]


def with_mid_spread(ticks: DataFrame) -> DataFrame:
    """mid = (bid+ask)/2 and spread = ask-bid."""
    return ticks.withColumns(
        {"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")}
    )


def _micros(col: str) -> Column:
    return F.unix_micros(F.col(col))


def _pieces(
    rows: DataFrame, keys: Sequence[str], by: Sequence[str], extra: Sequence[Column]
) -> DataFrame:
    """Aggregate the part of a bar that lies in one time slice.

    ``rows`` are already distributed by (series, slice) and sorted, so this moves nothing.
    """
    in_slice = Window.partitionBy(*by, SLICE).orderBy("ts", "seq")
    bar_id = keys[-1]
    stepped = rows.withColumns(
        {
            "_step": F.col("mid") - F.lag("mid").over(in_slice),
            "_inside": F.lag(bar_id).over(in_slice) == F.col(bar_id),
        }
    )
    return stepped.groupBy(*keys, SLICE).agg(
        F.min("ts").alias("open_time"),
        F.max("ts").alias("close_time"),
        F.min_by("mid", "row_idx").alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", "row_idx").alias("close"),
        F.count(F.lit(1)).alias("tick_count"),
        F.sum("volume").alias("volume"),
        F.sum("spread").alias("spread_sum"),
        F.count_if(F.col("_inside") & (F.col("_step") > 0)).alias("buy_count"),
        F.count_if(F.col("_inside") & (F.col("_step") < 0)).alias("sell_count"),
        *extra,
    )


def aggregate_bars(
    rows: DataFrame, bar_id: str = "bar_idx", by: Sequence[str] = ("symbol",),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """OHLC, counts and tick-rule imbalance for ticks that carry a bar number.

    ``rows`` needs ``row_idx`` and the slice column of :func:`with_row_index`.  Each bar is
    first reduced inside its slices and the few pieces of a bar are merged afterwards, so only
    about one row per bar is shuffled.  A tick's direction compares it with the tick before in
    the same bar; the first tick of a bar has none.
    """
    keys = [*by, bar_id]
    pieces = _pieces(rows, keys, by, extra)
    along = Window.partitionBy(*keys).orderBy(SLICE)
    joined = pieces.withColumn("_step", F.col("open") - F.lag("close").over(along))
    bars = joined.groupBy(*keys).agg(
        F.min("open_time").alias("open_time"),
        F.max("close_time").alias("close_time"),
        F.min_by("open", SLICE).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", SLICE).alias("close"),
        F.sum("tick_count").alias("tick_count"),
        F.sum("volume").alias("volume"),
        F.sum("spread_sum").alias("spread_sum"),
        (F.sum("buy_count") + F.count_if(F.col("_step") > 0)).alias("buy_count"),
        (F.sum("sell_count") + F.count_if(F.col("_step") < 0)).alias("sell_count"),
        *[F.bool_or(c).alias(c) for c in joined.columns if c == "is_complete"],
    )
    sides = F.col("buy_count") + F.col("sell_count")
    return bars.withColumns(
        {
            "imbalance": F.col("buy_count") - F.col("sell_count"),
            "imbalance_ratio": (F.col("buy_count") - F.col("sell_count"))
            / F.greatest(F.lit(1), sides),
            "neutral_count": F.col("tick_count") - sides,
            "duration_ms": (_micros("close_time") - _micros("open_time")) / 1000.0,
        }
    )


def indexed_ticks(ticks: DataFrame, slice_seconds: int = 900) -> DataFrame:
    """Valid quotes with mid, spread, volume and their position in the series."""
    quotes = with_mid_spread(ticks.filter((F.col("bid") > 0) & (F.col("ask") > 0)))
    volume = F.col("last_volume") if "last_volume" in ticks.columns else F.lit(1.0)
    narrow = quotes.select("symbol", "ts", "seq", "mid", "spread", volume.alias("volume"))
    return with_row_index(narrow, slice_seconds=slice_seconds, keep_slice=True)


def tick_bars(
    ticks: DataFrame, n: int = 100, emit_partial: bool = False, slice_seconds: int = 900
) -> DataFrame:
    """A bar every ``n`` ticks; the unfinished last bar is dropped unless asked for."""
    rows = indexed_ticks(ticks, slice_seconds)
    bars = aggregate_bars(rows.withColumn("bar_idx", F.floor(F.col("row_idx") / n).cast("long")))
    if not emit_partial:
        bars = bars.filter(F.col("tick_count") == n)
    return bars.select(BAR_COLUMNS)


def with_tick_direction(
    ticks: DataFrame, gamma: float | None = None, threshold: float = 0.5, n: int = 100,
    slice_seconds: int = 900,
) -> DataFrame:
    """Sign of the mid change inside each ``n``-tick bar; 0 on the first tick of a bar.

    With ``gamma`` the sign is weighted by ``gamma ** ticks since bar start`` and values whose
    size is below ``threshold`` count as neutral.
    """
    rows = indexed_ticks(ticks, slice_seconds).withColumn(
        "bar_idx", F.floor(F.col("row_idx") / n).cast("long")
    )
    in_bar = Window.partitionBy("symbol", "bar_idx").orderBy("row_idx")
    sign = F.coalesce(F.signum(F.col("mid") - F.lag("mid").over(in_bar)), F.lit(0.0))
    if gamma is not None:
        weighted = sign * F.pow(F.lit(gamma), (F.row_number().over(in_bar) - 1).cast("double"))
        sign = F.when(F.abs(weighted) >= threshold, F.signum(weighted)).otherwise(F.lit(0.0))
    return rows.withColumn("direction", sign.cast("int")).drop(SLICE)


def synthetic_volume(ticks: DataFrame, base: float = 100.0) -> DataFrame:
    """Volume from price movement and spread for feeds without traded volume.

    The published description is "volatility x spread scaled by a base"; our definition is
    ``base * (1 + |relative mid change| * 1e4) * (1 + relative spread * 1e4)``, both in basis
    points, with no change for the first tick.
    """
    rows = with_row_index(
        with_mid_spread(ticks.filter((F.col("bid") > 0) & (F.col("ask") > 0))), carry=["mid"]
    )
    move = F.coalesce(F.abs(F.col("mid") / F.col("prev_mid") - 1), F.lit(0.0)) * 1e4
    width = F.col("spread") / F.col("mid") * 1e4
    return rows.withColumn("synthetic_volume", F.lit(base) * (1 + move) * (1 + width))


def bar_shape(bars: DataFrame) -> DataFrame:
    """Range, body, their percentages, colour and average spread."""
    rng = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    price = F.col("open")
    return bars.withColumns(
        {
            "range": rng,
            "body": body,
            "range_pct": F.when(price > 0, rng / price * 100).otherwise(F.lit(0.0)),
            "body_pct": F.when(rng > 0, body / rng * 100).otherwise(F.lit(0.0)),
            "is_bullish": F.col("close") > F.col("open"),
            "is_bearish": F.col("close") < F.col("open"),
            "avg_spread": F.col("spread_sum") / F.greatest(F.col("tick_count"), F.lit(1)),
        }
    )


def _ohlc_by(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.min_by("open", "bar_idx").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_idx").alias("close"),
        F.sum("tick_count").alias("tick_volume"),
        F.count(F.lit(1)).alias("bar_count"),
    )


def time_bars(bars: DataFrame, interval_seconds: int = 900, align: bool = True) -> DataFrame:
    """Fixed-interval bars from event bars, assigned by their open time.

    ``align=False`` starts a bar at every distinct open time instead.
    """
    if not align:
        out = _ohlc_by(bars.withColumn("start_time", F.col("open_time")), ["symbol", "start_time"])
        return out.withColumn("end_time", F.col("start_time"))
    width = interval_seconds * 1_000_000
    start = F.floor(_micros("open_time") / width) * width
    keyed = bars.withColumn("start_time", F.timestamp_micros(start.cast("long")))
    out = _ohlc_by(keyed, ["symbol", "start_time"])
    return out.withColumn(
        "end_time", F.timestamp_micros(_micros("start_time") + F.lit(width))
    )


def multi_timeframe(bars: DataFrame, frames: Sequence[str] = tuple(TIMEFRAMES)) -> DataFrame:
    """Time bars of several timeframes from one pass and one grouping."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("timeframe"), F.lit(TIMEFRAMES[f] * 1_000_000).alias("width"))
        for f in frames
    ])
    rows = bars.withColumn("_f", F.explode(pairs)).select("*", "_f.timeframe", "_f.width")
    start = (F.floor(_micros("open_time") / F.col("width")) * F.col("width")).cast("long")
    keyed = rows.withColumn("start_time", F.timestamp_micros(start))
    return _ohlc_by(keyed, ["symbol", "timeframe", "start_time"])


def index_time_bars(frames: DataFrame, slice_seconds: int = 30 * 86400) -> DataFrame:
    """Give time bars a dense ``bar_idx`` so bar operators apply to them."""
    return with_row_index(
        frames, order=("start_time",), slice_seconds=slice_seconds, name="bar_idx"
    )


@windowed(lookahead=1)
def fill_gaps(df: DataFrame, w, interval_seconds: int) -> DataFrame:
    """Insert flat bars at the last close for intervals without events (indexed time bars)."""
    width = interval_seconds * 1_000_000
    start = F.unix_micros("start_time")
    until = F.coalesce(F.lead(start).over(w), start + width)
    rows = df.withColumn("_until", until).withColumn(
        "_t", F.explode(F.sequence(start, F.col("_until") - 1, F.lit(width)))
    )
    is_real = F.col("_t") == start
    flat = {c: F.when(is_real, F.col(c)).otherwise(F.col("close")) for c in ("open", "high", "low")}
    counts = {c: F.when(is_real, F.col(c)).otherwise(F.lit(0)) for c in ("tick_volume", "bar_count")}
    times = {
        "start_time": F.timestamp_micros("_t"),
        "end_time": F.timestamp_micros(F.col("_t") + F.lit(width)),
    }
    return rows.withColumns({**flat, **counts, **times}).drop("_t", "_until")


def recent_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars per symbol: dense indices make this one small join."""
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    rows = with_key_row(bars, last, ["symbol"], ["bar_idx"])
    return rows.filter(F.col("bar_idx") > F.col("_last") - n).drop("_last")


def bar_stats(bars: DataFrame) -> DataFrame:
    """Totals per symbol."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_bars"),
        F.sum("tick_count").alias("total_ticks"),
        F.avg("tick_count").alias("avg_ticks_per_bar"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.min("open_time").alias("first_time"),
        F.max("close_time").alias("last_time"),
    )


def open_bar_progress(ticks: DataFrame, n: int = 100) -> DataFrame:
    """How far the unfinished bar of each symbol has come."""
    counts = (
        ticks.filter((F.col("bid") > 0) & (F.col("ask") > 0))
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("n_ticks"))
    )
    return counts.select(
        "symbol", (F.col("n_ticks") % n).alias("ticks_in_bar"),
        (F.col("n_ticks") % n / F.lit(float(n))).alias("progress"),
    )


def ohlc(bars: DataFrame) -> DataFrame:
    """Only identity and OHLC."""
    return bars.select("symbol", "bar_idx", "open_time", "open", "high", "low", "close")


@windowed(lookback=1)
def with_prev_close(df: DataFrame, w) -> DataFrame:
    """Close of the bar before."""
    return df.withColumn("prev_close", F.lag("close").over(w))


def volume_bars(
    ticks: DataFrame, target: float = 100.0, source: str = "tick_count", grid: bool = False,
    emit_partial: bool = False, slice_seconds: int = 900, base_volume: float = 100.0,
    layout: Layout = TICKS,
) -> DataFrame:
    """Bars that close when their volume reaches ``target``.

    ``source``: ``tick_count`` (1 per tick), ``real`` (the volume column) or ``synthetic``.
    The next bar starts from zero; ``grid=True`` cuts the running total at multiples of
    ``target`` instead, so an overshoot is carried over.
    """
    if source == "tick_count":
        return tick_bars(ticks, int(target), emit_partial, slice_seconds)
    if source == "synthetic":
        priced = synthetic_volume(ticks, base_volume)
        ticks = priced.withColumn("last_volume", F.col("synthetic_volume"))
    rows = indexed_ticks(ticks, slice_seconds)
    if grid:
        rows = _running_volume(rows).withColumn(
            "bar_idx", F.floor(F.col("_before") / target).cast("long")
        ).withColumn("_done", F.floor(F.col("_after") / target) > F.col("bar_idx"))
    else:
        rows = volume_resets(rows, "volume", target, layout).withColumnsRenamed(
            {"bucket": "bar_idx", "closes_bucket": "_done"}
        )
    bars = aggregate_bars(rows, extra=[F.bool_or("_done").alias("is_complete")])
    if not emit_partial:
        bars = bars.filter("is_complete")
    return bars.select(BAR_COLUMNS)


def _running_volume(rows: DataFrame) -> DataFrame:
    """Volume before and after each tick, from slice totals and a running sum inside slices."""
    totals = rows.groupBy("symbol", SLICE).agg(F.sum("volume").alias("_v"))
    over = Window.partitionBy("symbol").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("symbol", SLICE, F.coalesce(F.sum("_v").over(over), F.lit(0.0)).alias("_o"))
    inside = Window.partitionBy("symbol", SLICE).orderBy("row_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = rows.join(offsets, ["symbol", SLICE]).withColumn(
        "_after", F.col("_o") + F.sum("volume").over(inside)
    )
    return out.withColumn("_before", F.col("_after") - F.col("volume")).drop("_o")
