"""Streaming operators, run over the whole tables and compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BARS, TICKS, bars, gap_bars, query, table, ticks
from catalog.bars import BAR_SPEC, time_bars_sql
from catalog.features import (
    ID, INV, RET, ST, THERMO, VPIN, ewma_sql, st_features_sql, supertrend_sql, w, zscore_sql,
)
from catalog.gaps import (
    ACTIVE, AGE, CAL, DAILY, DAY, DET, EVENT, MIN_BPS, ST15, ST_COLUMNS, STRUCT, asof_sql,
)
from catalog.indicators import HAAR, KAL
from tickspark.operators.bars import BAR_COLUMNS
from tickspark.plans.features import FeatureConfig
from tickspark.session import materialize, scratch_path
from tickspark.sources.ticks import stream_ticks
from tickspark.streaming import bars as sbars
from tickspark.streaming import features as sfeat
from tickspark.streaming.guard import GuardConfig, stream_guard
from tickspark.streaming.online import stream_features
from tickspark.streaming.run import run_to_table


#: Rows of a part, about: what one trigger reads does not grow with the table.
PART_ROWS = 1_000_000


def write_parts(df, path: str, part, by: tuple = ("symbol",)) -> None:
    """Append the rows of part 0, 1, ... one part after the other, in two files; rows equal in ``by`` share a file."""
    rows = materialize(df.withColumn("_part", part), "arriving", ("_part",))
    for (k,) in sorted(rows.select("_part").distinct().collect()):
        rows.filter(F.col("_part") == k).drop("_part").repartition(2, *by).write.mode("append").parquet(path)


def write_in_order(df, path: str, order: str, parts: int = 4, by: tuple = ("symbol",)) -> None:
    """Append ``parts`` parts of similar size, more of a large table, so that they arrive in order of ``order``."""
    rows = materialize(df, "in-order")
    key, parts = F.col(order).cast("double"), max(parts, -(-rows.count() // PART_ROWS))
    cuts = rows.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)])).first()[0]
    write_parts(rows, path, F.size(F.filter(F.lit(cuts), lambda c: key > c)), by)


def as_stream(df, label: str, order: str, per_trigger: int = 2, parts: int = 4):
    """The rows as a stream that reads them a part at a time in order of ``order``."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    write_in_order(df, path, order, parts)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tick_stream(spark, sf, parts: int = 3):
    """Ticks in order of time over several triggers."""
    path = scratch_path(spark, "stream-ticks")
    write_in_order(ticks(spark, sf), path, "ts", parts)
    return stream_ticks(spark, path, max_files_per_trigger=2)


@query("X1_stream_bars", BAR_SPEC, f"with {BARS} select * from bars")
def _(spark, sf):
    out = run_to_table(sbars.stream_bars(tick_stream(spark, sf), 20), "x1")
    return sbars.finished_bars(out).select(BAR_COLUMNS)


@query("X2_stream_time_bars", "symbol:s start_time:t open:f high:f low:f close:f tick_volume:i",
       f"""with {TICKS}, tb as (select symbol, time_bucket(interval 1 day, ts) as start_time, arg_min((bid + ask) / 2, ts) as open,
       max((bid + ask) / 2) as high, min((bid + ask) / 2) as low, arg_max((bid + ask) / 2, ts) as close, count(*) as tick_volume
       from ticks group by all)
       select * from tb where start_time + interval 1 day <= (select max(ts) from ticks) - interval 1 minute""")
def _(spark, sf):
    return run_to_table(sbars.stream_time_bars(tick_stream(spark, sf), "1 day"), "x2")


STREAM_SPEC = (
    "log_return:f log_return_zscore:f spread_bps:f delta_t_log:f tick_intensity:f ofi_count:f "
    "kyle_lambda_pct:f pdi:f micro_volatility_pct:f realized_volatility_pct:f market_entropy:f atr_1m:f"
)


@query("X3_stream_features", ID + STREAM_SPEC,
       f"""with recursive {INV}, {ewma_sql('inv', 'x', 0.9, 'ti')}, sq as (select symbol, bar_idx, power(log_return * 100, 2) as x from ret),
       {ewma_sql('sq', 'x', 0.94, 'mv')}, {THERMO[len(RET) + 2:]},
       wn as (select *, {zscore_sql('log_return', 100)} as log_return_zscore, spread_sum / greatest(tick_count, 1) / close * 1e4 as spread_bps,
         ln(dt + 1e-10) as delta_t_log, sum(imbalance) {w(20)} as ofi_count, lag(close, 50) over (partition by symbol order by bar_idx) as p,
         sum(tick_count) {w(50)} as n50, case when count(*) {w(20)} = 20 then sqrt(sum(power(log_return * 100, 2)) {w(20)}) end as realized_volatility_pct,
         greatest(high - low, abs(high - lag(close) over (partition by symbol order by bar_idx)),
           abs(low - lag(close) over (partition by symbol order by bar_idx))) as trv from th),
       wt as (select *, avg(trv) {w(14)} as atr_1m, abs(close - p) / p * 100 / n50 as kyle_lambda_pct,
         case when cnt = 50 then -(case when up > 0 then up / greatest(up + dn, 1) * ln(up / greatest(up + dn, 1) + 1e-10) else 0 end
         + case when dn > 0 then dn / greatest(up + dn, 1) * ln(dn / greatest(up + dn, 1) + 1e-10) else 0 end) end as market_entropy from wn)
       select wt.*, ti_r.y as tick_intensity, sqrt(mv_r.y) as micro_volatility_pct, sign(log_return) * ti_r.y as pdi
       from wt join ti_r using (symbol, bar_idx) join mv_r using (symbol, bar_idx)""")
def _(spark, sf):
    return stream_feature_table(spark, sf)


def stream_feature_table(spark, sf):
    return run_to_table(stream_features(as_stream(bars(spark, sf), "bar-stream", "bar_idx"), ONLINE), "x3")


ONLINE = FeatureConfig(higher_seconds=DAY, bucket_volume=100.0, n_buckets=10, wavelet="haar")
ONLINE_GAPS = FeatureConfig(higher_seconds=DAY, gap_min_bps=MIN_BPS, gap_max_age=AGE)


@query("X3_stream_flow", ID + "vpin:f vpin_zscore:f",
       f"""with {VPIN}, f as (select *, coalesce(vpin, 0.0) as v from vb)
       select symbol, bar_idx, vpin, {zscore_sql('v', 100)} as vpin_zscore from f""")
def _(spark, sf):
    return stream_feature_table(spark, sf)


@query("X3_stream_trend", ID + "trend_deviation:f trend_direction:i trend_duration:i bos:i choch:i structure_signal:i",
       f"""with recursive {STRUCT} select *, (close - st_line) / close * 100 as trend_deviation, st_dir as trend_direction from sx""")
def _(spark, sf):
    return stream_feature_table(spark, sf)


@query("X3_stream_denoise", ID + "kalman_residual_bps:f kalman_gain:f wavelet_energy_1:f wavelet_energy_2:f wavelet_trend_ratio:f",
       f"""with recursive {KAL}, {HAAR} select h.symbol, h.bar_idx, res / close * 1e4 as kalman_residual_bps, k as kalman_gain,
       detail_1 * detail_1 as wavelet_energy_1, detail_2 * detail_2 as wavelet_energy_2,
       (var_pop(wavelet_trend) {w(100)}) / ((var_pop(close) {w(100)}) + 1e-10) as wavelet_trend_ratio
       from haar h join kr using (symbol, bar_idx)""")
def _(spark, sf):
    return stream_feature_table(spark, sf)


@query("X3_stream_calendar",
       ID + "hour_of_day:i minute_of_hour:i day_of_week:i hour_sin:f hour_cos:f session:i bars_from_session_open:i "
       "is_session_open:i is_session_close:i",
       f"""with {CAL}, ch as (select *, case when session <> coalesce(lag(session) over (partition by symbol order by bar_idx), 4)
         and session <> 4 then bar_idx end as st, (epoch_us(open_time) % 86400000000) / 60000000.0 as mi from ses)
       select *, bar_idx - coalesce(max(st) over (partition by symbol order by bar_idx
         rows between unbounded preceding and current row), 0) as bars_from_session_open,
         sin(2 * pi() * (hour_of_day + minute_of_hour / 60.0) / 24) as hour_sin, cos(2 * pi() * (hour_of_day + minute_of_hour / 60.0) / 24) as hour_cos,
         case when (mi >= 0 and mi < 30) or (mi >= 480 and mi < 510) or (mi >= 780 and mi < 810) then 1 else 0 end as is_session_open,
         case when (mi >= 450 and mi < 480) or (mi >= 930 and mi < 960) or (mi >= 1230 and mi < 1260) then 1 else 0 end as is_session_close from ch""")
def _(spark, sf):
    return stream_feature_table(spark, sf)


def stream_gap_table(spark, sf):
    return run_to_table(stream_features(as_stream(gap_bars(spark, sf), "gap-stream", "bar_idx"), ONLINE_GAPS), "x3-gaps")


GAP_TREND = f"""tb as ({time_bars_sql(DAY)}), hi as (select *, start_time + interval 1 day as end_time,
    row_number() over (partition by symbol order by start_time) - 1 as bar_idx from tb), {supertrend_sql('hi')}, {st_features_sql('_15m')}"""


@query("X3_stream_gaps",
       ID + "bullish_fvg:i bearish_fvg:i active_fvg_count:i fvg_size_atr:f fvg_age_bars:i price_to_fvg_mid:f fvg_filled_pct:f "
       "nearest_fvg_distance:f fvg_event:i fvg_impulse_atr:f fvg_follow_up_3:f fvg_follow_dn_3:f fvg_follow_bars:i fvg_follow_net:f",
       f"with recursive {DET}{ACTIVE}{EVENT} select * from ev join act using (symbol, bar_idx)")
def _(spark, sf):
    return stream_gap_table(spark, sf)


@query("X3_stream_interactions",
       ID + "trend_fvg_alignment:f trend_strength_x_fvg:f trend_fvg_distance:f session_trend_interaction:f st_alignment:i "
       "fvg_location_15m:f atr_ratio_1m_15m:f",
       f"""with recursive {DET}{ACTIVE}{EVENT}, {GAP_TREND},
       jn as (select e.*, a.bullish_fvg, a.bearish_fvg, a.fvg_size_atr, a.price_to_fvg_mid, s.st_trend_15m as tr, s.st_distance_15m as di,
         (s.high + s.low) / 2 as m, case when s.high is not null then greatest(s.high - s.low, 1e-10) end as rg, hour(e.open_time) as h
         from ev e join act a using (symbol, bar_idx) asof left join sf s on s.symbol = e.symbol and s.end_time <= e.open_time)
       select *, tr * (bullish_fvg - bearish_fvg) as trend_fvg_alignment, abs(di) * fvg_size_atr as trend_strength_x_fvg,
         di * price_to_fvg_mid as trend_fvg_distance, tr * case when h between 13 and 15 then 3 when h between 13 and 20 then 2
           when h between 8 and 15 then 1 when h < 8 then 0 else 4 end as session_trend_interaction, tr * fvg_event as st_alignment,
         case when m > 0 then (close - m) / rg else 0 end as fvg_location_15m, atr / rg as atr_ratio_1m_15m from jn""")
def _(spark, sf):
    return stream_gap_table(spark, sf)


@query("X4_stream_higher", ID + "mid_15m_range:f atr_15m:f",
       f"with {DAILY} {asof_sql('end_time', 'h.mid_15m_range, h.atr_15m')}")
def _(spark, sf):
    return stream_feature_table(spark, sf)


@query("X4_stream_supertrend",
       ID + "st_trend_15m:i st_distance_15m:f st_bars_since_flip_15m:i st_slope_15m:f st_bandwidth_15m:f",
       f"with recursive {ST15} select * from sa")
def _(spark, sf):
    return stream_feature_table(spark, sf).fillna(0, ST_COLUMNS)


def decision_rows(spark, sf):
    """Bars with made-up events, trends and scores, every value a rule of the bar number."""
    i = F.col("bar_idx")
    return bars(spark, sf).select(
        "symbol", "bar_idx", F.when(i % 7 == 3, 1).when(i % 11 == 5, -1).otherwise(0).alias("fvg_event"),
        F.when(F.floor(i / 13) % 3 == 0, 1).when(F.floor(i / 13) % 3 == 1, -1).otherwise(0).alias("st_trend_15m"),
        F.when(i % 9 == 0, 1).when(i % 9 == 4, -1).otherwise(0).alias("structure_signal"),
        (((i * 7919) % 1000) / 1000.0).alias("score"),
        F.when(i % 2 == 0, "LAMINAR").otherwise("TRANSITION").alias("market_phase"),
        "close", (F.col("high") - F.col("low")).alias("atr_1m"), "open_time",
    )


def live_config():
    from tickspark.operators.signals import DecisionConfig, GateConfig

    gate = GateConfig(buffer=30, min_required=5, full_buffer=12, aligned=90, counter=97)
    return sfeat.LiveConfig(gate=gate, decision=DecisionConfig(warmup_bars=3))


X5_SQL = f"""with {BARS}, f as (select symbol, bar_idx, close, high - low as atr,
      case when bar_idx % 7 = 3 then 1 when bar_idx % 11 = 5 then -1 else 0 end as ev,
      case when (bar_idx // 13) % 3 = 0 then 1 when (bar_idx // 13) % 3 = 1 then -1 else 0 end as tr,
      case when bar_idx % 9 = 0 then 1 when bar_idx % 9 = 4 then -1 else 0 end as sg, ((bar_idx * 7919) % 1000) / 1000.0 as score,
      case when bar_idx % 2 = 0 then 'LAMINAR' else 'TRANSITION' end as ph from bars),
  e as (select *, ev <> 0 and coalesce(lag(ev) over (partition by symbol order by bar_idx), 0) = 0 as edge from f),
  g as (select *, max(case when edge then bar_idx end) over u as le,
    last_value(case when edge then case when tr <> 0 then tr else ev end end ignore nulls) over u as ld,
    last_value(nullif(sg, 0) ignore nulls) over u as ls, max(case when sg <> 0 then bar_idx end) over u as li
    from e window u as (partition by symbol order by bar_idx rows between unbounded preceding and current row)),
  h as (select *, coalesce(bar_idx - le < 3, false) as event_present from g),
  k as (select *, case when event_present then ld else 0 end as direction from h),
  m as (select *, case when tr = 0 or direction = 0 then 'UNKNOWN' when tr = direction then 'ALIGNED' else 'COUNTER' end as trend_alignment,
    case when direction = 1 then close - 3 * atr else close + 3 * atr end as stop_loss,
    coalesce(ls = direction and bar_idx - li <= 10, false) as ok from k),
  s as (select *, row_number() over (partition by symbol order by bar_idx) - 1 as si,
      case when trend_alignment = 'ALIGNED' then 90.0 when ph = 'FROZEN' then 99.0 when trend_alignment = 'COUNTER' or ph = 'LAMINAR' then 97.0
        when ph = 'TURBULENT' then 92.0 else 95.0 end as q
    from m where bar_idx + 1 >= 3 and event_present and (trend_alignment <> 'COUNTER' or ok)),
  t as (select *, least(si + 1, 30) as size, case q when 90.0 then quantile_cont(score, 0.9) over v when 92.0 then quantile_cont(score, 0.92) over v
      when 95.0 then quantile_cont(score, 0.95) over v when 97.0 then quantile_cont(score, 0.97) over v else quantile_cont(score, 0.99) over v end as picked
    from s window v as (partition by symbol order by bar_idx rows between 29 preceding and current row)),
  th as (select *, case when size < 5 then 'FROZEN' when size < 12 then 'FIXED' else 'ROLLING' end as gate_stage,
    case when size < 5 then null when size < 12 then 0.7 else greatest(0.1, least(0.9, picked)) end as threshold from t)
  select m.symbol, m.bar_idx, m.event_present, m.direction, m.trend_alignment, th.gate_stage, th.threshold, m.stop_loss,
    case when m.bar_idx + 1 < 3 then 'WARMUP' when not m.event_present then 'NO_EVENT'
      when m.trend_alignment = 'COUNTER' and not m.ok then 'COUNTER_TREND_NO_STRUCTURE' when th.gate_stage = 'FROZEN' then 'COLD_START'
      when m.score < th.threshold then 'LOW_CONFIDENCE' when m.stop_loss <= 0 then 'NO_STOP_LOSS' end as filtered_reason
  from m left join th on th.symbol = m.symbol and th.bar_idx = m.bar_idx"""

DECISION_SPEC = ID + "event_present:b direction:i trend_alignment:s gate_stage:s threshold:f stop_loss:f filtered_reason:s"


@query("X5_stream_decisions", DECISION_SPEC, X5_SQL)
def _(spark, sf):
    stream = as_stream(decision_rows(spark, sf), "decision-stream", "bar_idx")
    out = run_to_table(sfeat.stream_decisions(stream, live_config()), "x5")
    return out.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold")))


#: Bounds of the phases for bars of two ticks of this data.
LIVE_PHASES = {"frozen": 0.0008, "laminar": 0.0012, "turbulent": 0.0016}
LIVE = FeatureConfig(higher_seconds=DAY, gap_min_bps=MIN_BPS, gap_max_age=AGE, phase_limits=LIVE_PHASES)

LIVE_SQL = f"""with recursive {DET}{EVENT}, mst as (select * from (with recursive {supertrend_sql('bars')} select * from st)),
  {STRUCT[len(ST) + 2:].replace("from st", "from mst").replace("mst_", "st_")}, {GAP_TREND},
  lr as (select symbol, bar_idx, greatest(duration_ms, 1.0) as dt, coalesce(ln(close / lag(close) over (partition by symbol order by bar_idx)), 0.0) as r from bars),
  tm as (select symbol, bar_idx, case when count(*) {w(50)} = 50 then (var_pop(r) {w(50)}) / (avg(dt) {w(50)}) * 1e6 end as t from lr),
  f as (select e.symbol, e.bar_idx, e.close, e.atr, e.fvg_event as ev, coalesce(s.st_trend_15m, 0) as tr, x.structure_signal as sg,
      1 / (1 + exp(1 - e.fvg_impulse_atr - 0.1 * coalesce(e.fvg_follow_net, 0))) as score,
      case when tm.t < 0.0008 then 'FROZEN' when tm.t < 0.0012 then 'LAMINAR' when tm.t < 0.0016 then 'TRANSITION' when tm.t is not null then 'TURBULENT' end as ph
    from ev e join sx x using (symbol, bar_idx) join tm using (symbol, bar_idx)
    asof left join sf s on s.symbol = e.symbol and s.end_time <= e.open_time),
{X5_SQL[X5_SQL.index("  e as (select"):]}"""


def with_score(features):
    """A fixed logistic score of impulse and follow-through stands for the model."""
    z = F.col("fvg_impulse_atr") + 0.1 * F.coalesce("fvg_follow_net", F.lit(0.0)) - 1
    return features.withColumn("score", 1 / (1 + F.exp(-z))).fillna(0, ["st_trend_15m"])


@query("X5_live_path", DECISION_SPEC, LIVE_SQL)
def _(spark, sf):
    """Ticks to bars to features to scores to decisions: three stateful steps in one streaming query."""
    live = sbars.finished_bars(sbars.stream_bars(tick_stream(spark, sf), 2))
    out = run_to_table(sfeat.stream_decisions(with_score(stream_features(live, LIVE)), live_config()), "x5-live")
    return out.withColumn("threshold", F.when(~F.isnan("threshold"), F.col("threshold")))


@query("V15_run_signals", DECISION_SPEC, X5_SQL)
def _(spark, sf):
    """The same decisions from the batch operators."""
    from tickspark.layout import Layout
    from tickspark.operators import signals
    from tickspark.operators.index import with_row_index

    cfg = live_config()
    rows = signals.event_gate(decision_rows(spark, sf), cfg.window_bars)
    rows = signals.trend_alignment(signals.fallback_stop(rows, cfg.stop_factor, "atr_1m"))
    rows = signals.structure_confirm(rows, cfg.confirm_bars)
    asked = F.col("event_present") & ((F.col("trend_alignment") != "COUNTER") | F.col("structure_ok"))
    numbered = with_row_index(
        rows.filter(asked & (F.col("bar_idx") + 1 >= 3)), order=("open_time", "bar_idx"),
        slice_seconds=86_400, name="score_idx",
    )
    gated = signals.confidence_gate(numbered, cfg.gate, layout=Layout(idx="score_idx"))
    joined = rows.join(
        gated.select("symbol", "bar_idx", "threshold", "gate_stage"), ["symbol", "bar_idx"], "left"
    )
    return signals.decide(joined, cfg.decision, cfg.gate.mode).withColumn("direction", F.col("event_direction"))


@query("X6_bootstrap", BAR_SPEC,
       f"""with {BARS}, h as (select symbol, count(*) // 20 as done from ticks where ts < timestamp '2024-01-16 00:00:00' group by symbol)
       select b.* from bars b join h using (symbol) where b.bar_idx >= h.done""")
def _(spark, sf):
    """The first half of the month is history, the second half arrives live."""
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    t = ticks(spark, sf)
    path = scratch_path(spark, "live-ticks")
    write_in_order(t.filter(F.col("ts") >= cut), path, "ts", 2)
    stream = stream_ticks(spark, path, max_files_per_trigger=2)
    history = sbars.bar_state(t.filter(F.col("ts") < cut), 20)
    out = run_to_table(sbars.stream_bars(stream, 20, history=history), "x6")
    return sbars.finished_bars(out).select(BAR_COLUMNS)


LATE_SQL = f"""with {TICKS}, ar as (select *, ts + case when seq % 100 = 99 then interval 1 day when seq % 5 = 4 then interval 1 hour
      else interval 0 hour end as arrival from ticks),
  b as (select *, epoch_us(arrival) // (5 * 86400000000) as part from ar),
  p as (select symbol, part, max(max(ts)) over (partition by symbol order by part) as newest from b group by symbol, part),
  u as (select p.symbol, p.part, lead(p.part) over (partition by p.symbol order by p.part) as next_part,
      max(b.ts) as used from p join b on b.symbol = p.symbol and b.part <= p.part and b.ts <= p.newest - interval 2 hour group by p.symbol, p.part),
  j as (select b.*, coalesce(b.ts < u.used, false) as late from b left join u on u.symbol = b.symbol and u.next_part = b.part)
  select symbol, count(*) filter (where not late) // 20 as n_bars, count(*) filter (where late) as n_late from j group by symbol"""


@query("X7_late_policy", "symbol:s n_bars:i n_late:i", LATE_SQL)
def _(spark, sf):
    """Every fifth tick arrives an hour late, every hundredth a day late; two hours are waited for.

    Ticks arrive five days at a time.  The last ones of each symbol come out by its timer.
    """
    k = F.col("seq")
    late = F.when(k % 100 == 99, F.expr("interval 1 day")).when(k % 5 == 4, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour"))
    arriving = ticks(spark, sf).withColumn("arrival", F.col("ts") + late)
    path = scratch_path(spark, "late-ticks")
    write_parts(arriving, path, F.floor(F.unix_micros("arrival") / (5 * DAY * 1_000_000)))
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = run_to_table(sbars.stream_bars(stream, 20, delay_ms=7_200_000, clock="arrival"), "x7")
    return out.groupBy("symbol").agg(
        F.count_if(F.col("kind") == "bar").alias("n_bars"), F.count_if(F.col("kind") == "late").alias("n_late")
    )


def scored_ticks(spark, sf):
    return ticks(spark, sf).select(
        "symbol", "ts", "seq", (((F.col("seq") * 7919) % 1000) / 1000.0).alias("score"),
        (F.col("bid") - 1000).alias("latency_ms"),
    )


@query("X8_stream_alerts", "symbol:s start_time:t n:i n_low:i n_invalid:i n_slow:i max_latency_ms:f",
       f"""with {TICKS}, s as (select symbol, ts, ((seq * 7919) % 1000) / 1000.0 as score, bid - 1000 as latency_ms from ticks),
       g as (select symbol, time_bucket(interval 1 day, ts) as start_time, count(*) as n, count(*) filter (where score < 0.3) as n_low,
         0 as n_invalid, count(*) filter (where latency_ms > 200) as n_slow, max(latency_ms) as max_latency_ms from s group by all)
       select * from g where start_time + interval 1 day <= (select max(ts) from ticks) - interval 1 minute""")
def _(spark, sf):
    stream = as_stream(scored_ticks(spark, sf), "score-stream", "ts")
    return run_to_table(sfeat.stream_alerts(stream, window="1 day"), "x8")


@query("X8_stream_halts", "symbol:s seq:i low_run:i is_halted:b",
       f"""with {TICKS}, s as (select symbol, seq, row_number() over (partition by symbol order by seq) as rn,
         ((seq * 7919) % 1000) / 1000.0 < 0.3 as is_low from ticks),
       r as (select *, rn - coalesce(max(case when not is_low then rn end) over (partition by symbol order by seq
         rows between unbounded preceding and current row), 0) as low_run from s)
       select symbol, seq, low_run, max((low_run >= 4)::int) over (partition by symbol order by seq
         rows between unbounded preceding and current row) = 1 as is_halted from r""")
def _(spark, sf):
    stream = as_stream(scored_ticks(spark, sf), "halt-stream", "seq")
    return run_to_table(sfeat.stream_halts(stream, 4, 0.3), "x8-halts")


GUARD = GuardConfig(low_run=3, loss_limit=300.0, max_losses=8, cutoff_hours=17, tz="America/New_York", wait_ms=600_000)

GUARD_EVENTS = """ev0 as (select cast(user_id % 3 as varchar) as account, epoch_us(ts) as us, event_id as seq, event_id % 10 as k, value,
    epoch_ms(ts + to_minutes(cast(event_id % 5 as bigint))) as received,
    ((ts at time zone 'UTC') at time zone 'America/New_York' - interval 17 hour)::date as trading_day from events),
  ev1 as (select *, case when k < 5 then 3 when k < 9 then 2 else 1 end as rank from ev0 where k < 5 or k = 9 or seq % 7 > 0),
  due as (select (max(received) - 600000) * 1000 as due from ev1),
  ev2 as (select account, us, rank, seq, case when rank = 3 and seq % 400 = 3 then 'NAN_INF' end as alert,
      ((seq * 7919) % 1000) / 1000.0 < 0.3 as low, value > 200 as slow, value - 60 as p,
      case when k = 9 then case when seq % 20 = 9 then 'unlock' else 'resume' end end as command from ev1
    union all
    select distinct account, epoch_us(((trading_day + 1)::timestamp + interval 17 hour) at time zone 'America/New_York' at time zone 'UTC'),
      0, null::bigint, null, null, null, null::double, null from ev1 where rank = 2),
  ev as (select ev2.*, row_number() over (partition by account order by us, rank, seq) as n from ev2, due where us < due.due)"""

GUARD_STATES = """gr as (select distinct account, 0::bigint as n, null::bigint as us, 0 as rank, null::bigint as seq, 0 as low_run,
    null::varchar as model_halt, 0::double as daily_pnl, 0 as losses, 0 as trades, 0 as wins, null::varchar as risk_halt from ev
  union all
  select e.account, e.n, e.us, e.rank, e.seq,
    case when e.rank = 3 and model_halt is null and e.alert is null then case when e.low then low_run + 1 else 0 end
      when e.command = 'unlock' and model_halt is not null then 0 else low_run end,
    case when e.rank = 3 then coalesce(model_halt, e.alert, case when e.low and low_run >= 2 then 'CONFIDENCE_COLLAPSE'
        when e.slow then 'LATENCY_EXCEEDED' end)
      when e.command = 'unlock' then null else model_halt end,
    case when e.rank = 0 then 0 when e.rank = 2 then daily_pnl + e.p else daily_pnl end,
    case when e.rank = 2 then case when e.p >= 0 then 0 else losses + 1 end
      when e.command = 'resume' and risk_halt is not null then 0 else losses end,
    trades + (e.rank = 2)::int, wins + (e.rank = 2 and e.p >= 0)::int,
    case when e.rank = 2 then case when e.p < 0 and losses >= 7 then 'CONSECUTIVE_LOSSES'
        when daily_pnl + e.p < -300 then 'DAILY_LOSS_LIMIT' else risk_halt end
      when e.command = 'resume' or (e.rank = 0 and risk_halt = 'DAILY_LOSS_LIMIT') then null else risk_halt end
  from gr join ev e on e.account = gr.account and e.n = gr.n + 1)"""


@query("X8_stream_guard", "account:s us:i kind:s seq:i is_late:b low_run:i model_halt:s daily_pnl:f consecutive_losses:i "
       "total_trades:i winning_trades:i risk_halt:s may_trade:b",
       f"""with recursive {GUARD_EVENTS}, {GUARD_STATES}
       select *, case rank when 0 then 'rollover' when 1 then 'command' when 2 then 'fill' else 'score' end as kind, false as is_late,
         losses as consecutive_losses, trades as total_trades, wins as winning_trades,
         model_halt is null and risk_halt is null as may_trade from gr where n > 0""")
def _(spark, sf):
    """Events as scores, fills and commands of three accounts, received up to four minutes after their time."""
    e, seq = table(spark, sf, "events"), F.col("seq")
    rows = e.select(
        (F.col("user_id") % 3).alias("account"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value",
    ).withColumn("clock", F.col("ts") + F.make_dt_interval(mins=(seq % 5).cast("int")))
    path = scratch_path(spark, "guard-events")
    write_in_order(rows, path, "clock", 6, by=())

    def arriving():
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)

    k = seq % 10
    score = F.when(seq % 400 == 3, F.lit(float("nan"))).otherwise(((seq * 7919) % 1000) / 1000.0)
    scores = arriving().filter(k < 5).withColumns({"score": score, "latency_ms": F.col("value")})
    fills = arriving().filter((k >= 5) & (k < 9)).withColumns(
        {"status": F.when(seq % 7 > 0, F.lit("FILLED")).otherwise(F.lit("REJECTED")), "pnl": F.col("value") - 60}
    )
    commands = arriving().filter(k == 9).withColumn("command", F.when(seq % 20 == 9, F.lit("unlock")).otherwise(F.lit("resume")))
    return run_to_table(stream_guard(scores, fills, commands, GUARD), "x8-guard")
