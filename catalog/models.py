"""Feature schema, feature table, models and staged exits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog.base import BARS, GAP_BARS, bars, gap_bars, query, table
from catalog.features import ID, INV, RET, THERMO, VPIN, ewma_sql, st_features_sql, supertrend_sql, w, zscore_sql
from catalog.gaps import ACTIVE, AGE, CAL, DAILY, DET, EVENT, MIN_BPS, POSITIONS, open_positions, position_quotes
from catalog.indicators import HAAR, KAL
from catalog.labels import labelled
from tickspark import schema
from tickspark.operators import exits
from tickspark.operators.labels import Barriers
from tickspark.operators.risk import Costs
from tickspark.plans import training
from tickspark.plans.features import FeatureConfig, feature_table
from tickspark.plans.replay import ReplayConfig, run_signals

# ---------------------------------------------------------------- schema checks

FEATS = """ft as (select event_type as symbol, event_id as bar_idx, (value - 50) / 100 as log_return, value / 20 - 2 as log_return_zscore,
    case when event_id % 13 = 0 then null when event_id % 17 = 0 then 'nan'::double else value end as spread_bps from events)"""


def raw_features(spark, sf):
    """Three features with values in and out of range, NULL and NaN."""
    e, i, v = table(spark, sf, "events"), F.col("event_id"), F.col("value")
    spread = F.when(i % 13 == 0, None).when(i % 17 == 0, F.lit(float("nan"))).otherwise(v)
    return e.select(
        F.col("event_type").alias("symbol"), i.alias("bar_idx"), ((v - 50) / 100).alias("log_return"),
        (v / 20 - 2).alias("log_return_zscore"), spread.alias("spread_bps"),
    )


@query("C17_validate_features", ID + "is_in_range:b errors:s",
       f"""with {FEATS}, m as (select *, list_filter([case when log_return < -0.1 or log_return > 0.1 then 'log_return: outside [-0.1, 0.1]' end,
         case when log_return_zscore < -5 or log_return_zscore > 5 then 'log_return_zscore: outside [-5, 5]' end,
         case when isnan(spread_bps) then 'spread_bps: not finite' when spread_bps < 0 or spread_bps > 100 then 'spread_bps: outside [0, 100]' end],
         lambda x: x is not null) as e from ft)
       select symbol, bar_idx, len(e) = 0 as is_in_range, array_to_string(e, '; ') as errors from m""")
def _(spark, sf):
    rows = schema.validate_features(raw_features(spark, sf))
    return rows.withColumn("errors", F.array_join("feature_errors", "; "))


@query("C18_clip_features", ID + "log_return:f log_return_zscore:f",
       f"""with {FEATS} select symbol, bar_idx, greatest(-0.1, least(0.1, log_return)) as log_return,
       greatest(-5, least(5, log_return_zscore)) as log_return_zscore from ft""")
def _(spark, sf):
    return schema.clip_features(raw_features(spark, sf))


@query("C19_fill_defaults", ID + "spread_bps:f",
       f"""with {FEATS} select symbol, bar_idx, case when isnan(spread_bps) then -1 else coalesce(spread_bps, 0) end
       as spread_bps from ft""")
def _(spark, sf):
    rows = schema.fill_defaults(raw_features(spark, sf))
    return rows.withColumn("spread_bps", F.nanvl("spread_bps", F.lit(-1.0)))


HELD = ", ".join(f"({i}, '{s.name}')" for i, s in enumerate(schema.FEATURES))


@query("C20_schema_hash", "hash:s same:b n_rows:i",
       f"""with {GAP_BARS}, f(idx, name) as (values {HELD})
       select substr(md5(string_agg(name || ':double', ',' order by idx)), 1, 16) as hash, true as same,
         (select count(*) from bars) as n_rows from f""")
def _(spark, sf):
    """Fingerprint of the feature table as built and put in order, and whether the written schema reads back as the same."""
    rows = schema.select_features(feature_table(gap_bars(spark, sf), SHORT), [s.name for s in schema.FEATURES])
    back = schema.from_json(schema.to_json())
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"hash": F.lit(schema.table_hash(rows)), "same": F.lit(schema.is_compatible(schema.FEATURES, back))}
    )


@query("C21_select_features", ID + "spread_bps:f log_return:f",
       f"""with {FEATS} select symbol, bar_idx, case when isnan(spread_bps) then -1 else spread_bps end as spread_bps,
       log_return from ft""")
def _(spark, sf):
    rows = schema.select_features(raw_features(spark, sf), ["spread_bps", "log_return"])
    return rows.withColumn("spread_bps", F.nanvl("spread_bps", F.lit(-1.0)))


# ---------------------------------------------------------------- feature table and models

SHORT = FeatureConfig(
    bucket_volume=100.0, n_buckets=10, higher_seconds=86_400, gap_min_bps=MIN_BPS, gap_max_age=AGE, wavelet="haar"
)


def renamed(sql: str, names: str) -> str:
    """The same CTEs under other names, to use them twice."""
    return re.sub(rf"\b({names})\b", r"h_\1", sql)


VPIN_50 = VPIN[len(RET) + 2:].replace("// 5", "// 50").replace("1) % 5 ", "1) % 50 ").replace("count(*) = 5)", "count(*) = 50)")
HIGHER = renamed(f"{supertrend_sql('hi')}, {st_features_sql('_15m')}", "tr0|tr1|tr2|pv0|pv1|pv|pw|sr|st|sf")
UP_DOWN = " + ".join(
    f"case when {c} > 0 then {c} / greatest(up + dn, 1) * ln({c} / greatest(up + dn, 1) + 1e-10) else 0 end" for c in ("up", "dn")
)
FEATURE_SQL = f"""with recursive {DET}{ACTIVE}{EVENT}, {INV[len(BARS) + 2:]}, {ewma_sql('inv', 'x', 0.9, 'ti')},
  sq as (select symbol, bar_idx, power(log_return * 100, 2) as x from ret), {ewma_sql('sq', 'x', 0.94, 'mv')},
  {THERMO[len(RET) + 2:]}, {KAL[len(BARS) + 2:]}, {HAAR}, {VPIN_50}, {supertrend_sql('bars')}, {DAILY[len(BARS) + 2:]}, {HIGHER},
  {CAL[len(BARS) + 2:]},
  ro as (select *, {zscore_sql('log_return', 100)} as zr, sum(imbalance) {w(20)} as oc,
      sum(imbalance / greatest(duration_ms, 1.0)) {w(20)} as ow, lag(close, 50) over (partition by symbol order by bar_idx) as p50,
      sum(tick_count) {w(50)} as n50, case when count(*) {w(20)} = 20 then sqrt(sum(power(log_return * 100, 2)) {w(20)}) end as rv from th),
  wv as (select *, (var_pop(wavelet_trend) {w(100)}) / ((var_pop(close) {w(100)}) + 1e-10) as tratio from haar),
  vf as (select symbol, bar_idx, vpin, coalesce(vpin, 0.0) as v0 from vb),
  vz as (select *, {zscore_sql('v0', 100)} as zv from vf),
  sc as (select *, case when session <> coalesce(lag(session) over (partition by symbol order by bar_idx), 4) and session <> 4
      then bar_idx end as started, (epoch_us(open_time) % 86400000000) / 60000000.0 as mi from ses),
  sa as (select *, bar_idx - coalesce(max(started) over (partition by symbol order by bar_idx rows between unbounded preceding and current row), 0) as age from sc),
  hb as (select b.symbol, b.bar_idx, h.mid_15m_range, h.atr_15m, h.st_trend_15m, h.st_distance_15m, h.st_bars_since_flip_15m, h.st_slope_15m,
      h.st_bandwidth_15m from bars b asof left join h_sf h on h.symbol = b.symbol and h.end_time <= b.open_time),
  jn as (select ro.symbol, ro.bar_idx, ro.log_return, greatest(-5, least(5, zr)) as log_return_zscore,
    ro.spread_sum / greatest(ro.tick_count, 1) / ro.close * 1e4 as spread_bps, ln(ro.dt + 1e-10) as delta_t_log, ti_r.y as tick_intensity,
    oc as ofi_count, ow as ofi_weighted, abs(ro.close - p50) / p50 * 100 / n50 as kyle_lambda_pct, sign(ro.log_return) * ti_r.y as pdi,
    sqrt(mv_r.y) as micro_volatility_pct, rv as realized_volatility_pct, temp as market_temperature,
    case when cnt = 50 then -({UP_DOWN}) end as market_entropy,
    case when temp < 0.02 then 0 when temp < 0.2 then 1 when temp < 1.0 then 3 when temp is not null then 2 end as ts_phase,
    vz.vpin, greatest(-5, least(5, zv)) as vpin_zscore, (ro.close - st.st_line) / ro.close * 100 as trend_deviation, st.st_dir as trend_direction,
    st.trend_duration, kr.res / ro.close * 1e4 as kalman_residual_bps, kr.k as kalman_gain, wv.detail_1 * wv.detail_1 as wavelet_energy_1,
    wv.detail_2 * wv.detail_2 as wavelet_energy_2, tratio as wavelet_trend_ratio, act.bullish_fvg, act.bearish_fvg, act.fvg_size_atr,
    act.fvg_age_bars, act.price_to_fvg_mid, act.fvg_filled_pct, act.active_fvg_count, act.nearest_fvg_distance, ev.fvg_event,
    ev.fvg_impulse_atr, case when hb.mid_15m_range > 0 then (ro.close - hb.mid_15m_range) / hb.atr_15m else 0 end as fvg_location_15m,
    ev.fvg_follow_up_3, ev.fvg_follow_dn_3, ev.fvg_follow_bars, ev.fvg_follow_net, hb.st_trend_15m, hb.st_distance_15m,
    hb.st_bars_since_flip_15m, hb.st_slope_15m, hb.st_bandwidth_15m, sa.session, sa.hour_of_day, sa.minute_of_hour, sa.day_of_week,
    sa.age as bars_from_session_open,
    ((mi >= 0 and mi < 30) or (mi >= 480 and mi < 510) or (mi >= 780 and mi < 810))::int as is_session_open,
    ((mi >= 450 and mi < 480) or (mi >= 930 and mi < 960) or (mi >= 1230 and mi < 1260))::int as is_session_close,
    sin(2 * pi() * (sa.hour_of_day + sa.minute_of_hour / 60.0) / 24) as hour_sin, cos(2 * pi() * (sa.hour_of_day + sa.minute_of_hour / 60.0) / 24) as hour_cos,
    hb.st_trend_15m * (act.bullish_fvg - act.bearish_fvg) as trend_fvg_alignment, abs(hb.st_distance_15m) * act.fvg_size_atr as trend_strength_x_fvg,
    hb.st_bars_since_flip_15m * sqrt(mv_r.y) as trend_duration_x_vol, hb.st_distance_15m * act.price_to_fvg_mid as trend_fvg_distance,
    sa.session * hb.st_trend_15m as session_trend_interaction, hb.st_trend_15m * ev.fvg_event as st_alignment,
    ev.atr / hb.atr_15m as atr_ratio_1m_15m, ev.atr as atr_1m, hb.atr_15m, hb.mid_15m_range
    from ro join ti_r using (symbol, bar_idx) join mv_r using (symbol, bar_idx) join kr using (symbol, bar_idx) join wv using (symbol, bar_idx)
    join act using (symbol, bar_idx) join ev using (symbol, bar_idx) join vz using (symbol, bar_idx) join st using (symbol, bar_idx)
    join hb using (symbol, bar_idx) join sa using (symbol, bar_idx))
  select symbol, bar_idx, true as is_valid, {', '.join(f'coalesce({n}, 0) as {n}' for n in schema.FEATURE_NAMES)} from jn"""


@query("feature_table", ID + " ".join(f"{n}:f" for n in schema.FEATURE_NAMES) + " is_valid:b", FEATURE_SQL)
def _(spark, sf):
    return feature_table(gap_bars(spark, sf), SHORT)


def small_samples(spark, sf):
    """Labelled bars with a few plain features."""
    from catalog.evaluation import samples

    feats = bars(spark, sf).select(
        "symbol", "bar_idx", ((F.col("high") - F.col("low")) / F.col("open")).alias("f_range"),
        F.col("imbalance_ratio").alias("f_imbalance"), (F.col("close") / F.col("open") - 1).alias("f_return"),
    )
    truth = labelled(spark, sf).select("symbol", "bar_idx", "meta_label", F.lit(1.0).alias("sample_weight"))
    return samples(spark, sf).join(truth, ["symbol", "bar_idx"]).join(feats, ["symbol", "bar_idx"])


MODEL = training.ModelConfig(features=("f_range", "f_imbalance", "f_return"), max_depth=3, rounds=5)


@query("V5_fit_meta", "n_trees:i n_features:i")
def _(spark, sf):
    rows = small_samples(spark, sf)
    model = training.fit_meta(rows, MODEL)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(model.getNumTrees).alias("n_trees"), F.lit(model.numFeatures).alias("n_features")
    )


@query("V6_score", ID + "fold:i score_ok:b",
       None)
def _(spark, sf):
    scored = training.cross_validate(small_samples(spark, sf), 3, MODEL)
    return scored.withColumn("score_ok", F.col("score").between(0, 1))


@query("V6_score_without_model", ID + "score:f",
       f"with {BARS} select symbol, bar_idx, 0.5 as score from bars")
def _(spark, sf):
    return training.score(bars(spark, sf), None)


@query("V15_run_signals_features", ID + "direction:i entry_price:f stop_loss:f score:f")
def _(spark, sf):
    """Bars to features to labelled events to a model to passing signals, end to end."""
    from tickspark.operators.signals import DecisionConfig, GateConfig
    from tickspark.session import materialize

    feats = materialize(feature_table(gap_bars(spark, sf), SHORT), "features")
    events = training.labelled_events(feats, Barriers(vertical=20))
    model = training.fit_meta(events, training.ModelConfig(rounds=5))
    cfg = ReplayConfig(
        gate=GateConfig(buffer=200, min_required=20, full_buffer=100),
        decision=DecisionConfig(warmup_bars=50, require_structure=False),
    )
    return run_signals(feats, model, cfg)


# ---------------------------------------------------------------- staged exits

def exit_positions(spark, sf):
    kind = F.col("ticket") % 3
    alignment = F.when(kind == 0, "ALIGNED").when(kind == 1, "COUNTER").otherwise("UNKNOWN")
    return open_positions(spark, sf).withColumn("trend_alignment", alignment)


#: Ticks of a block here: the series of these tables are short.
EXIT_BLOCK = 512


EXIT_SPEC = "symbol:s ticket:i row_idx:i action:s stage:s price:f new_sl:f close_lots:f pnl_usd:f"

PT = f"""{POSITIONS}, px as (select *, row_idx - start_row as k, epoch_us(ts) / 1e6 as now, epoch_us(entry_time) / 1e6 as opened,
    entry_price - direction * 5.0 as stop0 from pt)"""

MID_SQL = f"""with recursive {PT},
  r as (select symbol, ticket, 0::bigint as k, false as be, false as pa, stop0 as sl, 0.0::double as tsl, 0.0::double as best,
      0.10::double as lots, 0.0::double as mv, true as live, null::varchar as stage, null::double as price, null::double as new_sl,
      null::double as close_lots, null::double as pnl from px where k = 1
    union all
    select symbol, ticket, k, be or coalesce(st = 'BE', false), pa or coalesce(st = 'PARTIAL', false),
      case when st = 'BE' then even when st = 'TRAILING' then cand else sl end,
      case when st = 'PARTIAL' then sl when st = 'TRAILING' then cand else tsl end,
      case when st = 'PARTIAL' then p else nbest end,
      case when st = 'PARTIAL' then lots - part else lots end,
      case when st in ('BE', 'TRAILING') then now else mv end, coalesce(st <> 'SL_HIT', true), st, p,
      case when st = 'BE' then even when st = 'TRAILING' then cand end,
      case when st = 'SL_HIT' then lots when st = 'PARTIAL' then part end, pl
    from (select *, case when sl > 0 and (p - sl) * direction <= 0 then 'SL_HIT'
          when be and not pa and pl >= 30 and part >= 0.01 then 'PARTIAL' when not be and pl >= 15 then 'BE'
          when pa and now - mv >= 1.0 and (nbest - direction * 5.0 - tsl - direction * 1.0) * direction > 0 then 'TRAILING' end as st
      from (select x.symbol, x.ticket, x.k, x.direction, x.now, (x.bid + x.ask) / 2 as p, r.be, r.pa, r.sl, r.tsl, r.lots, r.mv,
          round(x.entry_price + x.direction * 1.0, 2) as even, ((x.bid + x.ask) / 2 - x.entry_price) * x.direction * r.lots * 10 as pl,
          case when r.pa and ((x.bid + x.ask) / 2 - r.best) * x.direction > 0 then (x.bid + x.ask) / 2 else r.best end as nbest,
          round((case when r.pa and ((x.bid + x.ask) / 2 - r.best) * x.direction > 0 then (x.bid + x.ask) / 2 else r.best end)
            - x.direction * 5.0, 2) as cand,
          case when r.lots - round(r.lots * 0.5, 2) >= 0.01 then round(r.lots * 0.5, 2) else greatest(0.0, round(r.lots - 0.01, 2)) end as part
        from r join px x on x.symbol = r.symbol and x.ticket = r.ticket and x.k = r.k + 1 where r.live)))
  select symbol, ticket, (ticket + 1) * 20 - 1 + k as row_idx, case stage when 'SL_HIT' then 'FULL_CLOSE' when 'PARTIAL' then 'PARTIAL_CLOSE'
    else 'MOVE_SL' end as action, stage, price, new_sl, close_lots, pnl as pnl_usd from r where stage is not null"""


@query("R15_staged_exits_mid", EXIT_SPEC, MID_SQL)
def _(spark, sf):
    return exits.staged_exits_mid(exit_positions(spark, sf), position_quotes(spark, sf), exits.MidExitRules(value_per_lot=10.0), EXIT_BLOCK)


NET_SQL = f"""with recursive {PT}, pf as (select *, case ticket % 3 when 0 then 1.3 when 1 then 0.7 else 1.0 end as pm,
    case ticket % 3 when 0 then 1.2 when 1 then 0.8 else 1.0 end as dm from px),
  r as (select symbol, ticket, 0::bigint as k, 0 as sg, false as tr, stop0 as sl, 0.0::double as tsl, null::double as best,
      0.10::double as lots, 0.0::double as mv, 0.0::double as act, true as live, null::varchar as stage, null::double as price,
      null::double as new_sl, null::double as close_lots, null::double as pnl from pf where k = 1
    union all
    select symbol, ticket, k, case st when 'BE' then 1 when 'PARTIAL' then 2 else sg end,
      tr or coalesce(st = 'PARTIAL', false) or (wants and coalesce(st not in ('SL_HIT', 'PARTIAL', 'BE'), true) and held),
      case st when 'BE' then even when 'TRAILING' then case when (cand - tnow) * direction > 0 then cand else sl end else sl end,
      case when st = 'BE' then even when st = 'TRAILING' and (cand - tnow) * direction > 0 then cand when wants and held then tnow else tsl end,
      case when st = 'PARTIAL' then p else nbest end, case when st = 'PARTIAL' then lots - part else lots end,
      case when st = 'BE' or (st = 'TRAILING' and (cand - tnow) * direction > 0) then now else mv end,
      case when st in ('BE', 'PARTIAL') then now else act end, coalesce(st <> 'SL_HIT', true), st, p,
      case st when 'BE' then even when 'TRAILING' then cand end, case st when 'SL_HIT' then lots when 'PARTIAL' then part end, net
    from (select *, case when not held then null when sl > 0 and (p - sl) * direction <= 0 then 'SL_HIT'
          when sg = 1 and net >= 30 * pm and part >= 0.02 and now - act >= 5.0 then 'PARTIAL'
          when sg = 0 and net >= 15 * pm and not (mv > 0 and now - mv < 2.0) and (p - direction * 0.5 - even) * direction > 0
            and (sl <= 0 or (sl - even) * direction <= 0) then 'BE'
          when wants and now - mv >= 2.0 and (p - direction * 0.5 - cand) * direction > 0 and (sl <= 0 or (sl - cand) * direction <= 0)
            and (tnow <= 0 or (tnow + direction * 0.5 - cand) * direction <= 0) then 'TRAILING' end as st
      from (select *, sg >= 2 or (sg = 1 and net >= 25 * pm) as wants, case when tr then tsl else sl end as tnow,
          round(nbest - direction * 3.0 * dm, 4) as cand
        from (select *, case when best is null or (p - best) * direction > 0 then p else best end as nbest,
            (p - entry_price) * direction * lots * 10 - (7.0 * 0.1 + 2.0 * 0.1 + 1.0) as net,
            round(entry_price + direction * 0.5, 4) as even, now - opened >= 30.0 as held,
            case when lots - round(lots * 0.5, 2) >= 0.02 then round(lots * 0.5, 2) else greatest(0.0, round(lots - 0.02, 2)) end as part
          from (select x.symbol, x.ticket, x.k, x.direction, x.now, x.opened, x.entry_price, x.pm, x.dm,
              case when x.direction = 1 then x.bid else x.ask end as p, r.sg, r.tr, r.sl, r.tsl, r.best, r.lots, r.mv, r.act
            from r join pf x on x.symbol = r.symbol and x.ticket = r.ticket and x.k = r.k + 1 where r.live)))))
  select symbol, ticket, (ticket + 1) * 20 - 1 + k as row_idx, case stage when 'SL_HIT' then 'FULL_CLOSE' when 'PARTIAL' then 'PARTIAL_CLOSE'
    else 'MOVE_SL' end as action, stage, price, new_sl, close_lots, pnl as pnl_usd from r where stage is not null"""


@query("R14_staged_exits", EXIT_SPEC, NET_SQL)
def _(spark, sf):
    rules = exits.ExitRules(costs=Costs(value_per_lot=10.0), digits=4)
    return exits.staged_exits(exit_positions(spark, sf), position_quotes(spark, sf), rules, EXIT_BLOCK)
