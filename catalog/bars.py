"""Bars: event bars, time bars and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BAR_TICKS, BARS, TICKS, bars, query, ticks
from tickspark.operators import bars as ops

BAR_SPEC = (
    "symbol:s bar_idx:i open_time:t close_time:t open:f high:f low:f close:f tick_count:i "
    "volume:f imbalance:i imbalance_ratio:f buy_count:i sell_count:i neutral_count:i "
    "spread_sum:f duration_ms:f"
)


@query("B1_tick_bars", BAR_SPEC, f"with {BARS} select * from bars")
def _(spark, sf):
    return bars(spark, sf)


@query(
    "B5_tick_direction", "symbol:s seq:i bar_idx:i direction:i",
    f"""with {BARS} select symbol, seq, bar_idx, coalesce(sign(step), 0) as direction from d_bars""",
)
def _(spark, sf):
    return ops.with_tick_direction(ticks(spark, sf), n=BAR_TICKS)


@query(
    "B5_tick_direction_decayed", "symbol:s seq:i bar_idx:i direction:i",
    f"""with {BARS}, s as (
      select symbol, seq, bar_idx, coalesce(sign(step), 0)
             * power(0.95, row_number() over (partition by symbol, bar_idx order by row_idx) - 1) as v
      from d_bars)
    select symbol, seq, bar_idx, case when abs(v) >= 0.5 then sign(v) else 0 end as direction from s""",
)
def _(spark, sf):
    return ops.with_tick_direction(ticks(spark, sf), gamma=0.95, threshold=0.5, n=BAR_TICKS)


@query(
    "B6_bar_imbalance",
    "symbol:s bar_idx:i buy_count:i sell_count:i neutral_count:i imbalance:i imbalance_ratio:f",
    f"with {BARS} select * from bars",
)
def _(spark, sf):
    return bars(spark, sf)


@query(
    "B3_synthetic_volume", "symbol:s seq:i synthetic_volume:f",
    f"""with {TICKS}, q as (
      select symbol, ts, seq, (bid + ask) / 2 as mid, ask - bid as spread from ticks
      where bid > 0 and ask > 0),
    r as (select *, lag(mid) over (partition by symbol order by ts, seq) as prev from q)
    select symbol, seq, 100.0 * (1 + coalesce(abs(mid / prev - 1), 0.0) * 1e4)
           * (1 + spread / mid * 1e4) as synthetic_volume from r""",
)
def _(spark, sf):
    return ops.synthetic_volume(ticks(spark, sf))


@query(
    "B7_bar_shape",
    "symbol:s bar_idx:i range:f body:f range_pct:f body_pct:f is_bullish:b is_bearish:b avg_spread:f",
    f"""with {BARS} select symbol, bar_idx, high - low as range, abs(close - open) as body,
      case when open > 0 then (high - low) / open * 100 else 0 end as range_pct,
      case when high > low then abs(close - open) / (high - low) * 100 else 0 end as body_pct,
      close > open as is_bullish, close < open as is_bearish,
      spread_sum / greatest(tick_count, 1) as avg_spread from bars""",
)
def _(spark, sf):
    return ops.bar_shape(bars(spark, sf))


TIME_SPEC = "symbol:s start_time:t open:f high:f low:f close:f tick_volume:i bar_count:i"


def time_bars_sql(seconds: int, source: str = "bars") -> str:
    start = f"make_timestamp((epoch_us(open_time) // {seconds * 1000000}) * {seconds * 1000000})"
    return f"""select symbol, {start} as start_time, arg_min(open, bar_idx) as open,
      max(high) as high, min(low) as low, arg_max(close, bar_idx) as close,
      sum(tick_count) as tick_volume, count(*) as bar_count
      from {source} group by symbol, {start}"""


@query("B8_time_bars", TIME_SPEC, f"with {BARS} {time_bars_sql(86400)}")
def _(spark, sf):
    return ops.time_bars(bars(spark, sf), 86_400)


@query(
    "B9_time_bars_unaligned", TIME_SPEC,
    f"""with {BARS} select symbol, open_time as start_time, arg_min(open, bar_idx) as open,
      max(high) as high, min(low) as low, arg_max(close, bar_idx) as close,
      sum(tick_count) as tick_volume, count(*) as bar_count
      from bars group by symbol, open_time""",
)
def _(spark, sf):
    return ops.time_bars(bars(spark, sf), align=False)


@query(
    "B10_multi_timeframe", "timeframe:s " + TIME_SPEC,
    f"with {BARS} "
    + " union all ".join(
        f"select '{name}' as timeframe, * from ({time_bars_sql(sec)})"
        for name, sec in ops.TIMEFRAMES.items()
    ),
)
def _(spark, sf):
    return ops.multi_timeframe(bars(spark, sf))


@query(
    "B11_recent_bars", "symbol:s bar_idx:i close:f",
    f"""with {BARS} select * from (select *, row_number() over (partition by symbol
      order by bar_idx desc) as r from bars) where r <= 20""",
)
def _(spark, sf):
    return ops.recent_bars(bars(spark, sf), 20)


@query(
    "B11_bar_stats",
    "symbol:s total_bars:i total_ticks:i avg_ticks_per_bar:f avg_duration_ms:f first_time:t last_time:t",
    f"""with {BARS} select symbol, count(*) as total_bars, sum(tick_count) as total_ticks,
      avg(tick_count) as avg_ticks_per_bar, avg(duration_ms) as avg_duration_ms,
      min(open_time) as first_time, max(close_time) as last_time from bars group by symbol""",
)
def _(spark, sf):
    return ops.bar_stats(bars(spark, sf))


@query(
    "B11_open_bar_progress", "symbol:s ticks_in_bar:i progress:f",
    f"""with {TICKS} select symbol, count(*) % 20 as ticks_in_bar, (count(*) % 20) / 20.0 as progress
      from ticks where bid > 0 and ask > 0 group by symbol""",
)
def _(spark, sf):
    return ops.open_bar_progress(ticks(spark, sf), BAR_TICKS)


@query(
    "B12_ohlc", "symbol:s bar_idx:i open_time:t open:f high:f low:f close:f",
    f"with {BARS} select * from bars",
)
def _(spark, sf):
    return ops.ohlc(bars(spark, sf))


@query(
    "B8_fill_gaps", "symbol:s start_time:t open:f high:f low:f close:f bar_count:i",
    f"""with {BARS}, tb as ({time_bars_sql(3600)}),
    nx as (select *, coalesce(lead(start_time) over (partition by symbol order by start_time),
             start_time + interval 1 hour) as nxt from tb),
    ex as (select *, unnest(generate_series(start_time, nxt - interval 1 microsecond, interval 1 hour)) as t
           from nx)
    select symbol, t as start_time, case when t = start_time then open else close end as open,
      case when t = start_time then high else close end as high,
      case when t = start_time then low else close end as low, close,
      case when t = start_time then bar_count else 0 end as bar_count from ex""",
)
def _(spark, sf):
    hourly = ops.index_time_bars(ops.time_bars(bars(spark, sf), 3600))
    return ops.fill_gaps(hourly, 3600)


@query(
    "A1_group_ohlc", "symbol:s day:t open:f high:f low:f close:f total:f n:i",
    f"""with {TICKS} select symbol, date_trunc('day', ts)::timestamp as day,
      arg_min((bid + ask) / 2, ts) as open, max((bid + ask) / 2) as high,
      min((bid + ask) / 2) as low, arg_max((bid + ask) / 2, ts) as close,
      sum(last_volume) as total, count(*) as n from ticks group by symbol, date_trunc('day', ts)""",
)
def _(spark, sf):
    t = ops.with_mid_spread(ticks(spark, sf)).withColumn("day", F.date_trunc("day", "ts"))
    return t.groupBy("symbol", "day").agg(
        F.min_by("mid", "ts").alias("open"), F.max("mid").alias("high"),
        F.min("mid").alias("low"), F.max_by("mid", "ts").alias("close"),
        F.sum("last_volume").alias("total"), F.count(F.lit(1)).alias("n"),
    )
