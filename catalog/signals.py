"""Signals, gates, sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BARS, DIRTY, bars, dirty_ticks, query, table
from catalog.features import ID, supertrend_sql
from catalog.gaps import ACTIVE, DET, EVENT, STRUCT, active, detected, events, structure
from tickspark.operators import fold, gaps, trend
from tickspark.operators import signals as sig
from tickspark.operators import sizing

# ---------------------------------------------------------------- primary signals

PRIM = f"{DET}, {supertrend_sql('det')}"
BASIC = trend.SuperTrend()


def cooldown_sql(candidate: str, gap: int, source: str = "cand") -> str:
    """CTE ``keep`` of the greedy cooldown over all rows of ``source``."""
    return f"""kp as (select symbol, bar_idx, ({candidate}) as kept, case when {candidate} then bar_idx else -1000000 end as last
        from {source} where bar_idx = 0
      union all select s.symbol, s.bar_idx, ({candidate}) and s.bar_idx - k.last >= {gap},
        case when ({candidate}) and s.bar_idx - k.last >= {gap} then s.bar_idx else k.last end
      from kp k join {source} s on s.symbol = k.symbol and s.bar_idx = k.bar_idx + 1),
      keep as (select s.* from {source} s join kp using (symbol, bar_idx) where kp.kept)"""


STOP = """case when st_dir = 1 then least(edge, case when last_pivot_low > 0 then last_pivot_low end,
      case when st_line > 0 then st_line end) - close * 0.0005
    else greatest(edge, case when last_pivot_high > 0 then last_pivot_high end,
      case when st_line > 0 then st_line end) + close * 0.0005 end as stop_loss"""

SIGNALS = f"""{PRIM}, cand as (select *, case when st_dir = 1 then gap_bottom else gap_top end as edge,
    (gap_top + gap_bottom) / 2 as entry_price, coalesce(st_dir <> 0 and trend_duration >= 3 and fvg_type = st_dir, false) as ok from st),
  {cooldown_sql('ok', 5)}, sg as (select *, {STOP} from keep)"""

SIG_SPEC = ID + "direction:i entry_price:f stop_loss:f trend_duration:i"


def trended(rows):
    return trend.pivot_supertrend(rows, BASIC)


@query("P1_primary_signals", SIG_SPEC, f"with recursive {SIGNALS} select *, st_dir as direction from sg")
def _(spark, sf):
    return sig.primary_signals(trended(detected(spark, sf)))


@query("P2_ce_signals", ID + "direction:i trend_duration:i",
       f"""with recursive {DET}{ACTIVE}, {supertrend_sql('det')}, cand as (select s.*, coalesce(st_dir <> 0 and trend_duration >= 3 and
         case when st_dir = 1 then ce_bull_idx is not null else ce_bear_idx is not null end, false) as ok
         from st s join act a using (symbol, bar_idx)), {cooldown_sql('ok', 5)}
       select *, st_dir as direction from keep""")
def _(spark, sf):
    return sig.primary_signals(trended(active(spark, sf)), sig.PrimaryConfig(mode="ce"))


@query("P2_trend_only_signals", ID + "direction:i entry_price:f",
       f"""with recursive {PRIM}, cand as (select *, coalesce(st_dir <> 0 and trend_duration >= 3, false) as ok from st),
       {cooldown_sql('ok', 5)} select *, st_dir as direction, close as entry_price from keep""")
def _(spark, sf):
    return sig.primary_signals(trended(detected(spark, sf)), sig.PrimaryConfig(mode="trend_only"))


@query("P3_cooldown", ID + "close:f",
       f"with recursive {BARS}, cand as (select *, imbalance > 0 as ok from bars), {cooldown_sql('ok', 4)} select * from keep")
def _(spark, sf):
    from tickspark.operators.scan import cooldown

    b = bars(spark, sf).withColumn("ok", F.col("imbalance") > 0)
    return cooldown(b, "ok", 4, "kept").filter("kept")


@query("P4_structure_stop", ID + "stop_loss:f", f"with recursive {SIGNALS} select * from sg")
def _(spark, sf):
    return sig.primary_signals(trended(detected(spark, sf)))


@query("P5_confidence_factors", ID + "risk_bps:f fvg_size_bps:f trend_duration:i",
       f"""with recursive {SIGNALS} select *, abs(entry_price - stop_loss) / entry_price * 1e4 as risk_bps,
       gap_size_bps as fvg_size_bps from sg""")
def _(spark, sf):
    rows = sig.primary_signals(trended(detected(spark, sf)))
    return rows.select("*", "confidence_factors.fvg_size_bps")


# ---------------------------------------------------------------- event gate

GATE = f"""{DET}{EVENT}, gt as (select *, case when bar_idx % 3 = 0 then 1 when bar_idx % 3 = 1 then -1 else 0 end as up_trend from ev),
  ge as (select *, fvg_event <> 0 and coalesce(lag(fvg_event) over (partition by symbol order by bar_idx), 0) = 0 as edge from gt),
  gl as (select *, max(case when edge then bar_idx end) over u as last_edge,
    last_value(case when edge then case when up_trend <> 0 then up_trend else sign(fvg_event) end end ignore nulls) over u as last_dir
    from ge window u as (partition by symbol order by bar_idx rows between unbounded preceding and current row)),
  gg as (select *, coalesce(bar_idx - last_edge < 3, false) as event_present from gl),
  gate as (select *, case when event_present then last_dir else 0 end as event_direction,
    case when edge then 'rising_edge' when event_present then 'window' end as event_source from gg)"""


def with_up_trend(rows):
    """A made-up higher trend that takes all three values."""
    k = F.col("bar_idx") % 3
    return rows.withColumn("up_trend", F.when(k == 0, 1).when(k == 1, -1).otherwise(0))


def gated(spark, sf):
    return sig.event_gate(with_up_trend(events(spark, sf)), 3, align="up_trend")


@query("P6_event_gate", ID + "event_present:b event_direction:i event_source:s",
       f"with recursive {GATE} select * from gate")
def _(spark, sf):
    return gated(spark, sf)


@query("P6_event_gate_decay", ID + "event_present:b event_direction:i event_source:s",
       f"""with recursive {GATE[:GATE.index(', gt as')]}{ACTIVE}{GATE[GATE.index(', gt as'):]},
       dc as (select g.*, not event_present and coalesce(a.fvg_age_bars > 0 and a.fvg_age_bars <= 8 and (a.bullish_fvg = 1 or a.bearish_fvg = 1), false)
         as young, case when up_trend <> 0 then up_trend when a.bullish_fvg = 1 and a.bearish_fvg = 0 then 1
           when a.bearish_fvg = 1 and a.bullish_fvg = 0 then -1 else 0 end as faded
         from gate g join act a using (symbol, bar_idx))
       select symbol, bar_idx, event_present or (young and faded <> 0) as event_present,
         case when young and faded <> 0 then faded else event_direction end as event_direction,
         case when young and faded <> 0 then 'decay' else event_source end as event_source from dc""")
def _(spark, sf):
    rows = gaps.fvg_event(active(spark, sf))
    return sig.event_gate(with_up_trend(rows), 3, decay_bars=8, align="up_trend")


@query("V15_primary_levels", ID + "event_direction:i entry_price:f stop_loss:f from_primary:b",
       f"""with recursive {SIGNALS}{GATE[len(DET):]}
       select g.symbol, g.bar_idx, g.event_direction, coalesce(s.entry_price, g.close) as entry_price,
         coalesce(s.stop_loss, case when g.event_direction = 1 then g.close - 3 * g.atr else g.close + 3 * g.atr end) as stop_loss,
         s.bar_idx is not null as from_primary
       from gate g left join sg s on s.symbol = g.symbol and s.bar_idx = g.bar_idx where g.event_present""")
def _(spark, sf):
    """Levels of the replay: the primary signal's where there is one, else close and ATR."""
    rows = sig.fallback_stop(gated(spark, sf)).filter("event_present")
    return sig.primary_levels(rows, sig.primary_signals(trended(detected(spark, sf))))


@query("P7_fallback_stop", ID + "stop_loss:f",
       f"with recursive {GATE} select *, case when event_direction = 1 then close - 3 * atr else close + 3 * atr end as stop_loss from gate")
def _(spark, sf):
    return sig.fallback_stop(gated(spark, sf))


@query("P8_trend_alignment", ID + "trend_alignment:s",
       f"""with recursive {GATE} select *, case when up_trend = 0 or event_direction = 0 then 'UNKNOWN'
       when up_trend = event_direction then 'ALIGNED' else 'COUNTER' end as trend_alignment from gate""")
def _(spark, sf):
    return sig.trend_alignment(gated(spark, sf), "up_trend")


@query("P9_structure_confirm", ID + "structure_ok:b",
       f"""with recursive {STRUCT}, sc as (select *, last_value(nullif(structure_signal, 0) ignore nulls) over u as ls,
         max(case when structure_signal <> 0 then bar_idx end) over u as li, case when bar_idx % 2 = 0 then 1 else -1 end as want
         from sx window u as (partition by symbol order by bar_idx rows between unbounded preceding and current row))
       select symbol, bar_idx, coalesce(ls = want and bar_idx - li <= 10, false) as structure_ok from sc""")
def _(spark, sf):
    rows = structure(spark, sf).withColumn("want", F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1))
    return sig.structure_confirm(rows, 10, "want")


# ---------------------------------------------------------------- scored rows

SCORED = f"""{BARS}, scored as (select *, ((bar_idx * 7919) % 1000) / 1000.0 as score,
    case bar_idx % 4 when 0 then 'FROZEN' when 1 then 'LAMINAR' when 2 then 'TURBULENT' else 'TRANSITION' end as market_phase,
    case bar_idx % 3 when 0 then 'ALIGNED' when 1 then 'COUNTER' else 'UNKNOWN' end as trend_alignment,
    case when imbalance >= 0 then 1 else -1 end as direction, bar_idx % 5 <> 0 as event_present,
    bar_idx % 7 <> 0 as structure_ok,
    close as entry_price, case when bar_idx % 11 = 0 then 0.0 when imbalance >= 0 then close - 5 - bar_idx % 20
      else close + 5 + bar_idx % 20 end as stop_loss from bars)"""


def scored(spark, sf):
    """Bars with made-up scores, phases and directions, every value a rule of the bar number."""
    i = F.col("bar_idx")
    side = F.when(F.col("imbalance") >= 0, 1).otherwise(-1)
    far = 5 + i % 20
    return bars(spark, sf).withColumns(
        {
            "score": ((i * 7919) % 1000) / 1000.0, "score_idx": i,
            "market_phase": F.when(i % 4 == 0, "FROZEN").when(i % 4 == 1, "LAMINAR")
            .when(i % 4 == 2, "TURBULENT").otherwise("TRANSITION"),
            "trend_alignment": F.when(i % 3 == 0, "ALIGNED").when(i % 3 == 1, "COUNTER").otherwise("UNKNOWN"),
            "direction": side, "event_present": i % 5 != 0, "structure_ok": i % 7 != 0,
            "entry_price": F.col("close"),
            "stop_loss": F.when(i % 11 == 0, F.lit(0.0)).otherwise(F.col("close") - side * far),
        }
    )


QPHASE = "case market_phase when 'FROZEN' then 99.0 when 'LAMINAR' then 97.0 when 'TURBULENT' then 92.0 else 95.0 end"
QCASE = " ".join(
    f"when quantile = {q} then quantile_cont(score, {q / 100}) over u" for q in (90.0, 92.0, 95.0, 97.0, 99.0)
)
CONF = f"""{SCORED}, qq as (select *, case when trend_alignment = 'ALIGNED' then least({QPHASE}, 90.0)
      when trend_alignment = 'COUNTER' then greatest({QPHASE}, 97.0) else {QPHASE} end as quantile from scored),
  th as (select *, case {QCASE} end as picked, least(bar_idx + 1, 60) as size from qq
    window u as (partition by symbol order by bar_idx rows between 59 preceding and current row)),
  cg as (select *, case when size < 10 then 'FROZEN' when size < 30 then 'FIXED' else 'ROLLING' end as gate_stage,
    case when size >= 10 and size < 30 then 0.7 when size >= 30 then greatest(0.1, least(0.9, picked)) end as raw from th),
  conf as (select *, case when trend_alignment = 'COUNTER' and raw is not null then least(1.0, greatest(0.1, least(0.9, raw + 0.02))) else raw end as threshold from cg)"""

GATE_CFG = sig.GateConfig(buffer=60, min_required=10, full_buffer=30, aligned=0.90, counter=97, counter_boost=0.02)


@query("P10_confidence_gate", ID + "gate_stage:s quantile:f threshold:f",
       f"with {CONF} select * from conf")
def _(spark, sf):
    return sig.confidence_gate(scored(spark, sf), GATE_CFG)


@query("P10_confidence_gate_fixed", ID + "gate_stage:s threshold:f",
       f"""with {SCORED} select *, 'ROLLING' as gate_stage,
       case when trend_alignment = 'COUNTER' then 0.75 else 0.7 end as threshold from scored""")
def _(spark, sf):
    return sig.confidence_gate(scored(spark, sf), sig.GateConfig(mode="fixed", counter_boost=0.05))


DECIDE = f"""{CONF}, dec as (select *, case when bar_idx + 1 < 5 then 'WARMUP' when not event_present then 'NO_EVENT'
    when trend_alignment = 'COUNTER' and not structure_ok then 'COUNTER_TREND_NO_STRUCTURE'
    when gate_stage = 'FROZEN' then 'COLD_START' when score < threshold then 'LOW_CONFIDENCE'
    when stop_loss <= 0 then 'NO_STOP_LOSS' end as filtered_reason from conf)"""


def decided(spark, sf):
    return sig.decide(sig.confidence_gate(scored(spark, sf), GATE_CFG), sig.DecisionConfig(warmup_bars=5))


@query("P11_decide", ID + "filtered_reason:s should_trade:b",
       f"with {DECIDE} select *, filtered_reason is null as should_trade from dec")
def _(spark, sf):
    return decided(spark, sf)


@query("P12_price_guard", "symbol:s seq:i guard_reason:s",
       f"""with {DIRTY}, g as (select *, case when seq % 2 = 0 then ask - bid + 0.5 else 0 end as o,
         case when seq % 2 = 0 then 1 else -1 end as direction, (bid + ask) / 2 + (seq % 9 - 4) * 0.5 as entry_price from dirty),
       v as (select *, case when direction = 1 then ask - entry_price else entry_price - bid end as over from g)
       select symbol, seq, case when bid <= 0 or ask <= 0 then 'invalid_bid_ask' when (ask - bid) / 0.01 > 4.5 then 'spread_too_wide'
         when entry_price <= 0 then null when over > 1.0 then 'entry_band' when over > 2.0 then 'slippage' end as guard_reason from v""")
def _(spark, sf):
    rows = dirty_ticks(spark, sf).withColumns(
        {
            "direction": F.when(F.col("seq") % 2 == 0, 1).otherwise(-1),
            "entry_price": (F.col("bid") + F.col("ask")) / 2 + (F.col("seq") % 9 - 4) * 0.5,
        }
    )
    return sig.price_guard(rows, sig.PriceGuard(max_spread=4.5))


@query("P13_counter_cap", ID + "accepted:b",
       f"""with recursive {SCORED}, ss as (select symbol, bar_idx, trend_alignment = 'COUNTER' as c, 0 as sn from scored),
       rn as (select *, row_number() over (partition by symbol, sn order by bar_idx) as k from ss),
       rr as (select symbol, sn, bar_idx, k, true as accepted, [c::int] as past from rn where k = 1
         union all select symbol, sn, bar_idx, k, ok, case when ok then list_append(past, c::int)[-20:] else past end from (
           select n.symbol, n.sn, n.bar_idx, n.k, n.c, r.past, not (n.c and len(r.past) >= 5 and list_sum(r.past) / len(r.past) >= 0.3) as ok
           from rr r join rn n on n.symbol = r.symbol and n.sn = r.sn and n.k = r.k + 1))
       select symbol, bar_idx, accepted from rr""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("ts", F.col("open_time"))
    return fold.counter_cap(rows, order=("bar_idx",))


@query("P13_counter_cap_sessions", ID + "accepted:b",
       f"""with recursive {SCORED}, ss as (select symbol, bar_idx, trend_alignment = 'COUNTER' as c, epoch_us(open_time) // 864000000000 as sn from scored),
       rn as (select *, row_number() over (partition by symbol, sn order by bar_idx) as k from ss),
       rr as (select symbol, sn, bar_idx, k, true as accepted, [c::int] as past from rn where k = 1
         union all select symbol, sn, bar_idx, k, ok, case when ok then list_append(past, c::int)[-20:] else past end from (
           select n.symbol, n.sn, n.bar_idx, n.k, n.c, r.past, not (n.c and len(r.past) >= 5 and list_sum(r.past) / len(r.past) >= 0.3) as ok
           from rr r join rn n on n.symbol = r.symbol and n.sn = r.sn and n.k = r.k + 1))
       select symbol, bar_idx, accepted from rr""")
def _(spark, sf):
    rows = scored(spark, sf).withColumn("ts", F.col("open_time"))
    return fold.counter_cap(rows, session_seconds=10 * 86_400, order=("bar_idx",))


KELLY = "greatest(0.0, least((score * 3.0 - (1 - score)) / 3.0 * 0.25, 0.5))"


@query("P14_kelly_lots", ID + "lots:f",
       f"with {SCORED} select *, greatest(0.01, least(round(0.01 + {KELLY} / 0.5 * 0.09, 2), 0.10)) as lots from scored")
def _(spark, sf):
    return sizing.kelly_lots(scored(spark, sf))


@query("P15_position_size", ID + "mode:s lots:f",
       f"""with {SCORED} select symbol, bar_idx, 'fixed' as mode, 0.10 as lots from scored union all
       select symbol, bar_idx, 'linear', round(0.01 + greatest(0.0, least((score - 0.5) / 0.3, 1.0)) * 0.09, 2) from scored""")
def _(spark, sf):
    rows = scored(spark, sf)
    parts = [
        sizing.position_size(rows, sizing.Sizing(mode=m)).select("symbol", "bar_idx", F.lit(m).alias("mode"), "lots")
        for m in ("fixed", "linear")
    ]
    return parts[0].unionByName(parts[1])


RISK = f"""{SCORED}, rk as (select *, abs(entry_price - stop_loss) as dist, {KELLY} as bet,
    greatest(0.01, least(round(0.01 + {KELLY} / 0.5 * 0.09, 2), 0.10)) as plain from scored),
  rl as (select *, 100.0 / (dist / 0.01 * 1.0) as most from rk),
  rr as (select *, least(0.10, most) as room from rl),
  ls as (select *, case when bet <= 0 or most <= 0 then 0.01 when room < 0.01 then room else 0.01 + bet / 0.5 * (room - 0.01) end as l from rr),
  sz as (select *, case when dist > 0 then greatest(0.01, least(floor(l / 0.01 + 1e-9) * 0.01, 0.10)) else plain end as sized from ls)"""


@query("P16_risk_lots", ID + "lots:f",
       f"""with {RISK} select *, case when trend_alignment = 'COUNTER' then floor(sized * 0.5 / 0.01 + 1e-9) * 0.01 else sized end as lots from sz""")
def _(spark, sf):
    return sizing.risk_lots(scored(spark, sf))


@query("P17_cap_position", ID + "approved_lots:f was_reduced:b",
       f"""with {SCORED} select *, least(score, 0.5) as approved_lots, score > 0.5 as was_reduced from scored""")
def _(spark, sf):
    return sizing.cap_position(scored(spark, sf).withColumn("lots", F.col("score")), 0.5)


@query("P18_regime_filter", ID + "regime_reason:s",
       f"""with {SCORED} select *, case when market_phase = 'FROZEN' then 'FROZEN_MARKET' when score > 0.6 then 'HIGH_ENTROPY'
       when score / 2 < 0.1 then 'FROZEN_MARKET' end as regime_reason from scored""")
def _(spark, sf):
    rows = scored(spark, sf).withColumns(
        {"market_entropy": F.col("score"), "market_temperature": F.col("score") / 2}
    )
    return sig.regime_filter(rows, 0.6, 0.1)


@query("P19_phase_route", ID + "order_type:s route_allowed:b",
       f"""with {SCORED} select *, case market_phase when 'FROZEN' then 'none' when 'TRANSITION' then 'market' else 'limit' end as order_type,
       case market_phase when 'FROZEN' then false when 'LAMINAR' then score >= 0.55 when 'TURBULENT' then score >= 0.5
         else score >= 0.52 end as route_allowed from scored""")
def _(spark, sf):
    return sig.phase_route(scored(spark, sf))


@query("P20_session_filter", "symbol:s seq:i",
       f"""with {DIRTY}, m as (select *, hour(ts) * 60 + minute(ts) as mi, isodow(ts) - 1 as wd from dirty where ts is not null)
       select symbol, seq from m where ((mi between 480 and 960 and wd < 5) or mi >= 1320 or mi <= 60)
         and not (mi between 720 and 750)""")
def _(spark, sf):
    rows = dirty_ticks(spark, sf).filter("ts is not null")
    hours = [sig.TradingHours("day", "08:00", "16:00", (0, 1, 2, 3, 4)), sig.TradingHours("night", "22:00", "01:00")]
    return sig.session_filter(rows, hours, [sig.TradingHours("news", "12:00", "12:30")])


@query("P21_own_positions", "o_orderkey:i tag:i",
       "select o_orderkey, o_custkey % 5 as tag from orders where o_custkey % 5 = 3")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("tag", F.col("o_custkey") % 5)
    return sig.own_positions(o, 3, "tag")


