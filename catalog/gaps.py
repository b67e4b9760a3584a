"""Gap patterns, structure, calendar, alignment and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BARS, GAP_BARS, TICKS, bars, gap_bars, query, ticks
from catalog.bars import time_bars_sql
from catalog.features import ID, ST, TR, st_features_sql, supertrend_sql, w
from tickspark.layout import run_blocked
from tickspark.operators import asof, calendar, gaps, joins, price, trend
from tickspark.operators.bars import index_time_bars, indexed_ticks, time_bars
from tickspark.operators.index import SLICE
from tickspark.operators.risk import mark_positions

MIN_BPS = 5.0
AGE = 40

DET = f"""{GAP_BARS}, g0 as (select *, greatest(high - low, abs(high - lag(close) over p), abs(low - lag(close) over p)) as trv,
    lag(high, 2) over p as h2, lag(low, 2) over p as l2, (lag(high) over p + lag(low) over p) / 2 as mid1
    from bars window p as (partition by symbol order by bar_idx)),
  g1 as (select *, avg(trv) {w(14)} as atr, case when h2 < low then 1 when l2 > high then -1 else 0 end as k,
    case when h2 < low then low when l2 > high then l2 end as t,
    case when h2 < low then h2 when l2 > high then high end as b from g0),
  det as (select *, case when k <> 0 and (t - b) / mid1 * 1e4 >= {MIN_BPS} then k else 0 end as fvg_type,
    case when (t - b) / mid1 * 1e4 >= {MIN_BPS} then t end as gap_top,
    case when (t - b) / mid1 * 1e4 >= {MIN_BPS} then b end as gap_bottom,
    case when (t - b) / mid1 * 1e4 >= {MIN_BPS} then t - b end as gap_size,
    case when (t - b) / mid1 * 1e4 >= {MIN_BPS} then (t - b) / mid1 * 1e4 end as gap_size_bps from g1),
  zn as (select symbol, bar_idx as gap_idx, fvg_type, gap_top, gap_bottom, (gap_top + gap_bottom) / 2 as gap_mid,
    gap_size, gap_size_bps from det where fvg_type <> 0)"""


def detected(spark, sf):
    steps = [price.true_range.step(), price.atr.step(14), gaps.detect_fvg.step(MIN_BPS)]
    return run_blocked(gap_bars(spark, sf), steps)


@query("G1_detect_fvg", ID + "fvg_type:i gap_top:f gap_bottom:f gap_size_bps:f",
       f"with {DET} select * from det")
def _(spark, sf):
    return detected(spark, sf)


FILLS = f""", fl as (select z.symbol, z.gap_idx, z.fvg_type, z.gap_top, z.gap_bottom, z.gap_mid,
    min(case when (fvg_type = 1 and low <= gap_mid) or (fvg_type = -1 and high >= gap_mid) then b.bar_idx end) as partial_idx,
    min(case when (fvg_type = 1 and low <= gap_bottom) or (fvg_type = -1 and high >= gap_top) then b.bar_idx end) as fill_idx
    from zn z left join bars b on b.symbol = z.symbol and b.bar_idx between z.gap_idx + 1 and z.gap_idx + {AGE - 1}
    group by all)"""


@query("G2_fvg_fill", "symbol:s gap_idx:i fvg_type:i partial_idx:i fill_idx:i",
       f"with {DET}{FILLS} select * from fl")
def _(spark, sf):
    return gaps.fvg_fill(detected(spark, sf), AGE)


@query("G10_expire_fvg", "symbol:s gap_idx:i end_idx:i end_reason:s",
       f"""with {DET}{FILLS} select symbol, gap_idx, coalesce(fill_idx, gap_idx + {AGE}) as end_idx,
       case when fill_idx is null then 'EXPIRED' else 'FILLED' end as end_reason from fl""")
def _(spark, sf):
    return gaps.fvg_fill(detected(spark, sf), AGE)


@query("J5_first_touch", "symbol:s n_gaps:i n_filled:i avg_bars_to_fill:f",
       f"""with {DET}{FILLS} select symbol, count(*) as n_gaps, count(fill_idx) as n_filled,
       avg(fill_idx - gap_idx) as avg_bars_to_fill from fl group by symbol""")
def _(spark, sf):
    fills = gaps.fvg_fill(detected(spark, sf), AGE)
    return fills.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.count("fill_idx").alias("n_filled"),
        F.avg(F.col("fill_idx") - F.col("gap_idx")).alias("avg_bars_to_fill"),
    )


EVER = f""", ev as (select z.symbol, z.gap_idx, z.fvg_type,
    min(case when (fvg_type = 1 and low <= gap_mid) or (fvg_type = -1 and high >= gap_mid) then b.bar_idx end) as partial_idx,
    min(case when (fvg_type = 1 and low <= gap_bottom) or (fvg_type = -1 and high >= gap_top) then b.bar_idx end) as fill_idx
    from zn z left join bars b on b.symbol = z.symbol and b.bar_idx > z.gap_idx group by all)"""


@query("G2_fvg_fill_any_age", "symbol:s gap_idx:i fvg_type:i partial_idx:i fill_idx:i end_idx:i end_reason:s",
       f"""with {DET}{EVER} select *, fill_idx as end_idx,
       case when fill_idx is null then 'OPEN' else 'FILLED' end as end_reason from ev""")
def _(spark, sf):
    return gaps.fvg_fill(detected(spark, sf), None)


ACTIVE = f""", pr as (select z.*, b.bar_idx, b.close, b.atr,
      b.bar_idx > z.gap_idx and ((fvgt = 1 and low <= z.gap_bottom) or (fvgt = -1 and high >= z.gap_top)) as fills,
      case when b.bar_idx > z.gap_idx and fvgt = 1 and low <= z.gap_mid then least(1.0, (z.gap_top - low) / z.gap_size)
           when b.bar_idx > z.gap_idx and fvgt = -1 and high >= z.gap_mid then least(1.0, (high - z.gap_bottom) / z.gap_size) end as depth
      from (select *, fvg_type as fvgt from zn) z
      join det b on b.symbol = z.symbol and b.bar_idx between z.gap_idx and z.gap_idx + {AGE - 1}),
    al as (select *, bool_or(fills) over gw as gone, last_value(depth ignore nulls) over gw as pct from pr
      window gw as (partition by symbol, gap_idx order by bar_idx rows between unbounded preceding and current row)),
    rk as (select *, row_number() over (partition by symbol, bar_idx order by gap_idx desc) as r from al where not gone),
    nw as (select *, abs(close - gap_mid) as dist from rk where r <= 10),
    ag as (select symbol, bar_idx, max(case when fvgt = 1 then 1 else 0 end) as bullish_fvg,
      max(case when fvgt = -1 then 1 else 0 end) as bearish_fvg, count(*) as active_fvg_count,
      arg_min(gap_size, struct_pack(d := dist, g := gap_idx)) / greatest(any_value(atr), 1e-10) as fvg_size_atr,
      any_value(bar_idx) - arg_min(gap_idx, struct_pack(d := dist, g := gap_idx)) as fvg_age_bars,
      (any_value(close) - arg_min(gap_mid, struct_pack(d := dist, g := gap_idx))) / greatest(any_value(atr), 1e-10) as price_to_fvg_mid,
      arg_min(coalesce(pct, 0.0), struct_pack(d := dist, g := gap_idx)) as fvg_filled_pct,
      min(dist) / greatest(any_value(atr), 1e-10) as nearest_fvg_distance,
      min(case when fvgt = 1 and dist / gap_mid * 1e4 <= 20 then gap_idx end) as ce_bull_idx,
      min(case when fvgt = -1 and dist / gap_mid * 1e4 <= 20 then gap_idx end) as ce_bear_idx
      from nw group by symbol, bar_idx),
    act as (select d.symbol, d.bar_idx, coalesce(bullish_fvg, 0) as bullish_fvg, coalesce(bearish_fvg, 0) as bearish_fvg,
      coalesce(active_fvg_count, 0) as active_fvg_count, fvg_size_atr, fvg_age_bars, price_to_fvg_mid, fvg_filled_pct,
      nearest_fvg_distance, ce_bull_idx, ce_bear_idx from det d left join ag a on a.symbol = d.symbol and a.bar_idx = d.bar_idx)"""


def active(spark, sf):
    return gaps.fvg_state_features(detected(spark, sf), AGE, 10, ce_bps=20.0)


@query("G3_fvg_state_features",
       ID + "bullish_fvg:i bearish_fvg:i active_fvg_count:i fvg_size_atr:f fvg_age_bars:i "
       "price_to_fvg_mid:f fvg_filled_pct:f nearest_fvg_distance:f",
       f"with {DET}{ACTIVE} select * from act")
def _(spark, sf):
    return active(spark, sf)


@query("G9_ce_entry", ID + "ce_bull_idx:i ce_bear_idx:i", f"with {DET}{ACTIVE} select * from act")
def _(spark, sf):
    return active(spark, sf)


EVENT = f""", er as (select symbol, bar_idx, fvg_type as fvg_event, case when fvg_type <> 0 then bar_idx else -1000 end as last_at,
      cast(null as double) as base, 0.0::double as up, 0.0::double as dn from det where bar_idx = 0
    union all select symbol, bar_idx, ev, case when ev <> 0 then bar_idx else last_at end,
      case when ev <> 0 then close else base end,
      case when ev <> 0 then 0 when base is not null and bar_idx - last_at <= 3 then greatest(up, close - base) else up end,
      case when ev <> 0 then 0 when base is not null and bar_idx - last_at <= 3 then least(dn, close - base) else dn end
    from (select d.symbol, d.bar_idx, d.close, e.last_at, e.base, e.up, e.dn,
      case when d.bar_idx - e.last_at > 2 then d.fvg_type else 0 end as ev
      from er e join det d on d.symbol = e.symbol and d.bar_idx = e.bar_idx + 1)),
    ev as (select d.*, e.fvg_event, case when e.fvg_event <> 0 then d.gap_size / d.atr else 0 end as fvg_impulse_atr,
      case when base is not null then up / d.atr end as fvg_follow_up_3,
      case when base is not null then dn / d.atr end as fvg_follow_dn_3,
      case when base is not null then d.bar_idx - last_at end as fvg_follow_bars,
      (d.close - base) / d.atr as fvg_follow_net
      from er e join det d on d.symbol = e.symbol and d.bar_idx = e.bar_idx)"""


def events(spark, sf):
    return gaps.fvg_event(detected(spark, sf))


@query("G4_fvg_event", ID + "fvg_event:i fvg_impulse_atr:f", f"with recursive {DET}{EVENT} select * from ev")
def _(spark, sf):
    return events(spark, sf)


@query("G6_fvg_follow",
       ID + "fvg_follow_up_3:f fvg_follow_dn_3:f fvg_follow_bars:i fvg_follow_net:f",
       f"with recursive {DET}{EVENT} select * from ev")
def _(spark, sf):
    return events(spark, sf)


@query("G8_event_anchors", "symbol:s anchor_count:i rising_edge_count:i ratio_diff:f is_pulse:b used:s",
       f"""with {DET}, an as (select *, coalesce(lag(fvg_type) over (partition by symbol order by bar_idx), 0) as pv from det),
       c as (select symbol, count(*) filter (where fvg_type <> 0) as anchor_count,
         count(*) filter (where fvg_type <> 0 and pv = 0) as rising_edge_count from an group by symbol)
       select *, abs(rising_edge_count - anchor_count) / anchor_count as ratio_diff,
         abs(rising_edge_count - anchor_count) / anchor_count < 0.01 as is_pulse,
         case when abs(rising_edge_count - anchor_count) / anchor_count > 0.05 then 'rising_edge' else 'anchor' end as used from c""")
def _(spark, sf):
    return gaps.anchor_audit(gaps.event_anchors(detected(spark, sf), "fvg_type"))


STRUCT = f"""{ST}, rb as (select *, max(high) over rp as mh, min(low) over rp as ml from st
      window rp as (partition by symbol order by bar_idx rows between 20 preceding and 1 preceding)),
    rs as (select *, case when close > mh then 1 when close < ml then -1 end as range_break from rb),
    rd as (select *, coalesce(last_value(range_break ignore nulls) over (partition by symbol order by bar_idx
      rows between unbounded preceding and 1 preceding), 0) as before from rs),
    rt as (select *, case when range_break is not null and before = -range_break then range_break else 0 end as choch,
      case when range_break is not null and before <> -range_break then range_break else 0 end as bos,
      case when st_line > 0 and st_dir = -1 and close > st_line then 1
           when st_line > 0 and st_dir = 1 and close < st_line then -1 else 0 end as tl_break from rd),
    sx as (select *, case when choch <> 0 then choch when bos <> 0 then bos else tl_break end as structure_signal from rt)"""


def structure(spark, sf):
    return gaps.structure_breaks(trend.pivot_supertrend(bars(spark, sf)), 20)


@query("G11_structure_breaks", ID + "bos:i choch:i tl_break:i structure_signal:i",
       f"with recursive {STRUCT} select * from sx")
def _(spark, sf):
    return structure(spark, sf)


# ---------------------------------------------------------------- higher timeframe

DAY = 86_400
DAILY = f"""{BARS}, tb as ({time_bars_sql(DAY)}),
  hi as (select *, start_time + interval 1 day as end_time, (high + low) / 2 as mid_15m_range,
    greatest(high - low, 1e-10) as atr_15m,
    row_number() over (partition by symbol order by start_time) - 1 as bar_idx from tb)"""


def daily(spark, sf):
    """Daily bars stand in for 15-minute bars: these ticks are hours apart."""
    return higher(time_bars(bars(spark, sf), DAY))


def higher(frames):
    return frames.withColumns(
        {
            "mid_15m_range": (F.col("high") + F.col("low")) / 2,
            "atr_15m": F.greatest(F.col("high") - F.col("low"), F.lit(1e-10)),
        }
    )


def asof_sql(kind: str, columns: str) -> str:
    return f"""select b.symbol, b.bar_idx, {columns} from bars b asof left join hi h
      on h.symbol = b.symbol and h.{kind} <= b.open_time"""


@query("J1_asof_join", ID + "mid_15m_range:f atr_15m:f",
       f"with {DAILY} {asof_sql('end_time', 'h.mid_15m_range, h.atr_15m')}")
def _(spark, sf):
    return asof.asof_join(
        bars(spark, sf), daily(spark, sf), "open_time", "end_time", ["mid_15m_range", "atr_15m"]
    )


@query("J1_asof_join_in_progress", ID + "mid_15m_range:f",
       f"with {DAILY} {asof_sql('start_time', 'h.mid_15m_range')}")
def _(spark, sf):
    return asof.align_features(
        bars(spark, sf), daily(spark, sf), ["mid_15m_range"], causal=False, default=None
    )


@query("J2_align_features", ID + "mid_15m_range:f atr_15m:f",
       f"with {DAILY} {asof_sql('end_time', 'coalesce(h.mid_15m_range, 0) as mid_15m_range, coalesce(h.atr_15m, 0) as atr_15m')}")
def _(spark, sf):
    return asof.align_features(bars(spark, sf), daily(spark, sf), ["mid_15m_range", "atr_15m"])


@query("F29_atr_15m", ID + "atr_ratio_1m_15m:f",
       f"""with {DAILY}, al as ({asof_sql('end_time', 'h.atr_15m')}),
       {TR.split(', tr as ')[1].join(['tr as ', ''])}
       select t.symbol, t.bar_idx, t.atr / a.atr_15m as atr_ratio_1m_15m from
       (select symbol, bar_idx, avg(true_range) {w(14)} as atr from tr) t
       join al a on a.symbol = t.symbol and a.bar_idx = t.bar_idx""")
def _(spark, sf):
    aligned = asof.align_features(
        price.atr(bars(spark, sf), 14), daily(spark, sf), ["atr_15m"], default=None
    )
    ratio = F.col("atr") / F.greatest(F.col("atr_15m"), F.lit(1e-10))
    # greatest() skips NULL: without a finished higher bar there is no ratio
    return aligned.withColumn("atr_ratio_1m_15m", F.when(F.col("atr_15m").isNotNull(), ratio))


@query("G5_fvg_location", ID + "fvg_location_15m:f",
       f"""with {DAILY}, al as ({asof_sql('end_time', 'b.close, h.mid_15m_range as m, h.atr_15m as a')})
       select symbol, bar_idx, case when m > 0 then (close - m) / a else 0 end as fvg_location_15m from al""")
def _(spark, sf):
    aligned = asof.align_features(
        bars(spark, sf), daily(spark, sf), ["mid_15m_range", "atr_15m"], default=None
    )
    return gaps.fvg_location(aligned)


ST_COLUMNS = ["st_trend_15m", "st_distance_15m", "st_bars_since_flip_15m", "st_slope_15m", "st_bandwidth_15m"]
ST15 = f"""{DAILY}, {supertrend_sql('hi')}, {st_features_sql('_15m')},
  sa as (select b.symbol, b.bar_idx, {', '.join(f'coalesce(h.{c}, 0) as {c}' for c in ST_COLUMNS)}
    from bars b asof left join sf h on h.symbol = b.symbol and h.end_time <= b.open_time)"""


def supertrend_daily(spark, sf):
    frames = index_time_bars(time_bars(bars(spark, sf), DAY))
    return trend.supertrend_features(trend.pivot_supertrend(frames), "_15m")


@query("F38_supertrend_15m",
       ID + "st_trend_15m:i st_distance_15m:f st_bars_since_flip_15m:i st_slope_15m:f st_bandwidth_15m:f",
       f"with recursive {ST15} select * from sa")
def _(spark, sf):
    return asof.align_features(bars(spark, sf), supertrend_daily(spark, sf), ST_COLUMNS)


@query("G7_st_alignment", ID + "st_alignment:i",
       f"""with recursive {DET}{EVENT}, e2 as (select * from ev), tb as ({time_bars_sql(DAY)}),
       hi as (select *, start_time + interval 1 day as end_time,
         row_number() over (partition by symbol order by start_time) - 1 as bar_idx from tb),
       {supertrend_sql('hi')}
       select e.symbol, e.bar_idx, coalesce(s.st_dir, 0) * e.fvg_event as st_alignment
       from e2 e asof left join st s on s.symbol = e.symbol and s.end_time <= e.open_time""")
def _(spark, sf):
    frames = index_time_bars(time_bars(gap_bars(spark, sf), DAY))
    high = trend.supertrend_features(trend.pivot_supertrend(frames), "_15m")
    return gaps.st_alignment(asof.align_features(events(spark, sf), high, ["st_trend_15m"]))


# ---------------------------------------------------------------- joins

@query("J3_features_at", ID + "seq_share:f range_pct:f",
       f"""with {BARS}, ev as (select symbol, bar_idx, buy_count / tick_count as seq_share from bars where imbalance > 0)
       select e.*, (b.high - b.low) / b.open * 100 as range_pct from ev e join bars b using (symbol, bar_idx)""")
def _(spark, sf):
    b = bars(spark, sf)
    ev = b.filter(F.col("imbalance") > 0).select(
        "symbol", "bar_idx", (F.col("buy_count") / F.col("tick_count")).alias("seq_share")
    )
    feats = b.select("symbol", "bar_idx", ((F.col("high") - F.col("low")) / F.col("open") * 100).alias("range_pct"))
    return joins.features_at(ev, feats)


@query("J4_event_window", ID + "n:i max_close:f min_close:f",
       f"""with {BARS}, ev as (select symbol, bar_idx from bars where imbalance > 0)
       select e.symbol, e.bar_idx, count(*) as n, max(b.close) as max_close, min(b.close) as min_close
       from ev e join bars b on b.symbol = e.symbol and b.bar_idx between e.bar_idx + 1 and e.bar_idx + 20
       group by e.symbol, e.bar_idx""")
def _(spark, sf):
    b = bars(spark, sf)
    ev = b.filter(F.col("imbalance") > 0).select("symbol", "bar_idx")
    pairs = joins.event_window(ev, b.select("symbol", "bar_idx", "close"), 1, 20)
    return pairs.groupBy("symbol", "bar_idx").agg(
        F.count(F.lit(1)).alias("n"), F.max("close").alias("max_close"), F.min("close").alias("min_close")
    )


@query("J6_missing_keys", ID + "close:f",
       f"""with {BARS} select a.symbol, a.bar_idx, a.close from bars a
       where not exists (select 1 from bars b where b.symbol = a.symbol and b.bar_idx = a.bar_idx and b.imbalance > 0)""")
def _(spark, sf):
    b = bars(spark, sf)
    return joins.missing_keys(b, b.filter(F.col("imbalance") > 0))


@query("J7_with_scalars", ID + "relative_range:f",
       f"""with {BARS}, s as (select avg(high - low) as m from bars)
       select symbol, bar_idx, (high - low) / m as relative_range from bars, s""")
def _(spark, sf):
    b = bars(spark, sf)
    scalars = b.agg(F.avg(F.col("high") - F.col("low")).alias("m"))
    return joins.with_scalars(b, scalars).withColumn(
        "relative_range", (F.col("high") - F.col("low")) / F.col("m")
    )


@query("J8_with_features", ID + "range:f delta_t_log:f spread_bps:f",
       f"""with {BARS} select symbol, bar_idx, high - low as range, ln(greatest(duration_ms, 1.0) + 1e-10) as delta_t_log,
       spread_sum / greatest(tick_count, 1) / close * 1e4 as spread_bps from bars""")
def _(spark, sf):
    b = bars(spark, sf)
    blocks = [price.delta_t_log(b).select("symbol", "bar_idx", "delta_t_log"),
              price.spread_bps(b).select("symbol", "bar_idx", "spread_bps")]
    base = b.select("symbol", "bar_idx", (F.col("high") - F.col("low")).alias("range"))
    return joins.with_features(base, blocks)


POSITIONS = f"""{BARS}, po as (select symbol, bar_idx as ticket, case when bar_idx % 2 = 0 then 1 else -1 end as direction,
    close as entry_price, close_time as entry_time, 0.10 as lots, (bar_idx + 1) * 20 - 1 as start_row,
    case when bar_idx % 50 < 49 then (bar_idx + 1) * 20 - 1 + 40 + bar_idx % 7 * 60 end as close_row from bars),
  pt as (select p.*, t.row_idx, t.ts, t.mid - t.spread / 2 as bid, t.mid + t.spread / 2 as ask
    from po p join q_bars t on t.symbol = p.symbol and t.row_idx > p.start_row
      and (p.close_row is null or t.row_idx <= p.close_row))"""


def open_positions(spark, sf, stop_distance: float = 5.0):
    """One position per bar, long and short in turn, opened at its close; one in 50 is never closed."""
    opened = (F.col("bar_idx") + 1) * 20 - 1
    side = F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1)
    return bars(spark, sf).select(
        "symbol", F.col("bar_idx").alias("ticket"), side.alias("direction"),
        F.col("close").alias("entry_price"), F.col("close_time").alias("entry_time"),
        F.lit(0.10).alias("lots"), opened.alias("start_row"),
        F.when(F.col("bar_idx") % 50 < 49, opened + 40 + F.col("bar_idx") % 7 * 60).alias("close_row"),
        (F.col("close") - side * stop_distance).alias("stop_loss"),
    )


def position_quotes(spark, sf):
    return indexed_ticks(ticks(spark, sf)).drop(SLICE).withColumns(
        {"bid": F.col("mid") - F.col("spread") / 2, "ask": F.col("mid") + F.col("spread") / 2}
    )


def position_ticks(spark, sf, best: bool = False):
    return joins.positions_on_ticks(open_positions(spark, sf), position_quotes(spark, sf), best=best)


MARK = """select symbol, ticket, row_idx, exit_price, gross, gross - (7.0 * lots + 2.0 * lots + 1.0) as net_pnl_usd,
    case when direction = 1 then max(bid) over pw else min(ask) over pw end as best_price from (
    select *, case when direction = 1 then bid else ask end as exit_price,
      case when direction = 1 then (bid - entry_price) else (entry_price - ask) end * lots as gross from pt)
  window pw as (partition by symbol, ticket order by row_idx rows between unbounded preceding and current row)"""


@query("J9_mark_positions", "symbol:s ticket:i row_idx:i net_pnl_usd:f", f"with {POSITIONS} {MARK}")
def _(spark, sf):
    return mark_positions(position_ticks(spark, sf))


@query("R13_mark_positions",
       "symbol:s ticket:i row_idx:i exit_price:f gross_pnl_usd:f net_pnl_usd:f best_price:f",
       f"with {POSITIONS} select *, gross as gross_pnl_usd from ({MARK})")
def _(spark, sf):
    return mark_positions(position_ticks(spark, sf, best=True))


# ---------------------------------------------------------------- calendar

CAL = f"""{BARS}, cal as (select *, hour(open_time) as hour_of_day, minute(open_time) as minute_of_hour,
    isodow(open_time) - 1 as day_of_week from bars),
  ses as (select *, case when hour_of_day between 13 and 15 then 3 when hour_of_day between 13 and 20 then 2
    when hour_of_day between 8 and 15 then 1 when hour_of_day < 8 then 0 else 4 end as session from cal)"""


def cal(spark, sf):
    return calendar.session(calendar.calendar(bars(spark, sf)))


@query("T1_calendar", ID + "hour_of_day:i minute_of_hour:i day_of_week:i", f"with {CAL} select * from cal")
def _(spark, sf):
    return calendar.calendar(bars(spark, sf))


@query("T2_cyclic_hour", ID + "hour_sin:f hour_cos:f",
       f"""with {CAL} select *, sin(2 * pi() * (hour_of_day + minute_of_hour / 60.0) / 24) as hour_sin,
       cos(2 * pi() * (hour_of_day + minute_of_hour / 60.0) / 24) as hour_cos from cal""")
def _(spark, sf):
    return calendar.cyclic_hour(calendar.calendar(bars(spark, sf)))


@query("T3_session", ID + "session:i", f"with {CAL} select * from ses")
def _(spark, sf):
    return cal(spark, sf)


@query("T4_session_edges", "symbol:s seq:i is_session_open:i is_session_close:i",
       f"""with {TICKS}, m as (select symbol, seq, (epoch_us(ts) % 86400000000) / 60000000.0 as mi from ticks)
       select symbol, seq, case when (mi >= 0 and mi < 30) or (mi >= 480 and mi < 510) or (mi >= 780 and mi < 810)
         then 1 else 0 end as is_session_open,
       case when (mi >= 450 and mi < 480) or (mi >= 930 and mi < 960) or (mi >= 1230 and mi < 1260)
         then 1 else 0 end as is_session_close from m""")
def _(spark, sf):
    return calendar.session_edges(ticks(spark, sf), ts="ts")


@query("T5_bars_from_session_open", ID + "bars_from_session_open:i",
       f"""with {CAL}, ch as (select *, case when session <> coalesce(lag(session) over (partition by symbol order by bar_idx), 4)
         and session <> 4 then bar_idx end as st from ses)
       select symbol, bar_idx, bar_idx - coalesce(max(st) over (partition by symbol order by bar_idx
         rows between unbounded preceding and current row), 0) as bars_from_session_open from ch""")
def _(spark, sf):
    return calendar.bars_from_session_open(cal(spark, sf))


@query("T6_session_name", ID + "session_name:s",
       f"with {CAL} select *, ['Asia', 'London', 'NewYork', 'Overlap', 'Closed'][session + 1] as session_name from ses")
def _(spark, sf):
    return calendar.session_name(cal(spark, sf))


@query("T7_interactions",
       ID + "trend_fvg_alignment:f trend_strength_x_fvg:f trend_duration_x_vol:f trend_fvg_distance:f "
       "session_trend_interaction:f",
       f"""with recursive {DET}{ACTIVE}, {supertrend_sql('bars')}, {st_features_sql()},
       sn as (select symbol, bar_idx, hour(open_time) as h from bars),
       jn as (select s.*, a.bullish_fvg, a.bearish_fvg, a.fvg_size_atr, a.price_to_fvg_mid,
         case when h between 13 and 15 then 3 when h between 13 and 20 then 2 when h between 8 and 15 then 1
              when h < 8 then 0 else 4 end as session
         from sf s join act a using (symbol, bar_idx) join sn using (symbol, bar_idx))
       select symbol, bar_idx, st_trend * (bullish_fvg - bearish_fvg) as trend_fvg_alignment,
         abs(st_distance) * fvg_size_atr as trend_strength_x_fvg, st_bars_since_flip * (high - low) as trend_duration_x_vol,
         st_distance * price_to_fvg_mid as trend_fvg_distance, session * st_trend as session_trend_interaction from jn""")
def _(spark, sf):
    # the bar range stands in for the volatility column
    rows = trend.supertrend_features(trend.pivot_supertrend(active(spark, sf)))
    rows = calendar.session(calendar.calendar(rows)).withColumn("_vol", F.col("high") - F.col("low"))
    return calendar.interactions(rows, suffix="", vol="_vol")
