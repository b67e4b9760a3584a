"""Price, flow, volatility and thermodynamic features, recurrences and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BARS, GAP_BARS, bars, gap_bars, query
from tickspark.layout import run_blocked
from tickspark.operators import price, trend, vpin

ID = "symbol:s bar_idx:i "

W = "over (partition by symbol order by bar_idx rows between {} preceding and current row)"


def w(n: int) -> str:
    return W.format(n - 1)


RET = f"""{BARS}, ret as (select *, coalesce(ln(close / lag(close) over (partition by symbol
  order by bar_idx)), 0.0) as log_return, greatest(duration_ms, 1.0) as dt from bars)"""


@query("F1_log_return", ID + "log_return:f", f"with {RET} select * from ret")
def _(spark, sf):
    return price.log_return(bars(spark, sf))


def zscore_sql(col: str, n: int) -> str:
    return f"""case when count(*) {w(n)} >= 3 and stddev_pop({col}) {w(n)} > 1e-10
      then ({col} - avg({col}) {w(n)}) / stddev_pop({col}) {w(n)} else 0 end"""


@query("F2_rolling_zscore", ID + "log_return_zscore:f",
       f"with {RET} select symbol, bar_idx, {zscore_sql('log_return', 100)} as log_return_zscore from ret")
def _(spark, sf):
    return run_blocked(bars(spark, sf), [price.log_return.step(), price.rolling_zscore.step("log_return", 100)])


@query("F3_spread_bps", ID + "spread_bps:f",
       f"with {BARS} select *, spread_sum / greatest(tick_count, 1) / close * 1e4 as spread_bps from bars")
def _(spark, sf):
    return price.spread_bps(bars(spark, sf))


@query("F4_delta_t_log", ID + "delta_t_log:f",
       f"with {BARS} select *, ln(greatest(duration_ms, 1.0) + 1e-10) as delta_t_log from bars")
def _(spark, sf):
    return price.delta_t_log(bars(spark, sf))


def ewma_sql(source: str, col: str, keep: float, out: str) -> str:
    """Recursive CTE of y = keep*y + (1-keep)*x with y0 = x0, to follow ``with recursive``."""
    return f"""{out}_r as (
      select symbol, bar_idx, cast({col} as double) as y from {source} where bar_idx = 0
      union all
      select s.symbol, s.bar_idx, (1 - {keep}) * s.{col} + {keep} * r.y
      from {out}_r r join {source} s on s.symbol = r.symbol and s.bar_idx = r.bar_idx + 1)"""


INV = f"""{RET}, inv as (select symbol, bar_idx, log_return,
  1.0 / greatest(ln(dt + 1e-10), 0.1) as x from ret)"""


@query("F5_tick_intensity", ID + "tick_intensity:f",
       f"with recursive {INV}, {ewma_sql('inv', 'x', 0.9, 'ti')} select symbol, bar_idx, y as tick_intensity from ti_r")
def _(spark, sf):
    return price_scans(bars(spark, sf))


def price_scans(b):
    from tickspark.plans.features import recursive_features

    return recursive_features(run_blocked(b, [price.log_return.step()]))


@query("F6_ofi_count", ID + "ofi_count:f",
       f"with {BARS} select symbol, bar_idx, sum(imbalance) {w(20)} as ofi_count from bars")
def _(spark, sf):
    return price.ofi_count(bars(spark, sf), 20)


@query("F7_ofi_weighted", ID + "ofi_weighted:f",
       f"with {BARS} select symbol, bar_idx, sum(imbalance / greatest(duration_ms, 1.0)) {w(20)} as ofi_weighted from bars")
def _(spark, sf):
    return price.ofi_weighted(bars(spark, sf), 20)


@query("F8_kyle_lambda", ID + "kyle_lambda_pct:f",
       f"""with {BARS}, k as (select *, lag(close, 50) over (partition by symbol order by bar_idx) as p,
       sum(tick_count) {w(50)} as n from bars)
       select symbol, bar_idx, abs(close - p) / p * 100 / n as kyle_lambda_pct from k""")
def _(spark, sf):
    return price.kyle_lambda(bars(spark, sf), 50)


@query("F9_pdi", ID + "pdi:f",
       f"""with recursive {INV}, {ewma_sql('inv', 'x', 0.9, 'ti')}
       select t.symbol, t.bar_idx, sign(i.log_return) * y as pdi
       from ti_r t join inv i on i.symbol = t.symbol and i.bar_idx = t.bar_idx""")
def _(spark, sf):
    return price_scans(bars(spark, sf))


@query("F10_micro_volatility", ID + "micro_volatility_pct:f",
       f"""with recursive {RET}, sq as (select symbol, bar_idx, power(log_return * 100, 2) as x from ret),
       {ewma_sql('sq', 'x', 0.94, 'mv')} select symbol, bar_idx, sqrt(y) as micro_volatility_pct from mv_r""")
def _(spark, sf):
    return price_scans(bars(spark, sf))


@query("F11_realized_vol", ID + "realized_volatility_pct:f",
       f"""with {RET} select symbol, bar_idx, case when count(*) {w(20)} = 20 then
       sqrt(sum(power(log_return * 100, 2)) {w(20)}) end as realized_volatility_pct from ret""")
def _(spark, sf):
    return run_blocked(bars(spark, sf), [price.log_return.step(), price.realized_vol.step(20)])


THERMO = f"""{RET}, th as (select *, case when count(*) {w(50)} = 50 then
    var_pop(log_return) {w(50)} / (avg(dt) {w(50)}) * 1e6 end as temp,
    count(*) filter (where log_return > 0) {w(50)} as up,
    count(*) filter (where log_return < 0) {w(50)} as dn,
    count(*) {w(50)} as cnt from ret)"""

def _thermo(b):
    return run_blocked(
        b, [price.log_return.step(), price.temperature.step(50), price.direction_entropy.step(50)]
    )


@query("F12_temperature", ID + "market_temperature:f",
       f"with {THERMO} select symbol, bar_idx, temp * 1e6 as market_temperature from th")
def _(spark, sf):
    # scaled up once more: these bars last hours, so the plain value is below the 6 digits compared
    return _thermo(bars(spark, sf)).withColumn("market_temperature", F.col("market_temperature") * 1e6)


@query("F13_direction_entropy", ID + "market_entropy:f",
       f"""with {THERMO} select symbol, bar_idx, case when cnt = 50 then
       -(case when up > 0 then up / greatest(up + dn, 1) * ln(up / greatest(up + dn, 1) + 1e-10) else 0 end
       + case when dn > 0 then dn / greatest(up + dn, 1) * ln(dn / greatest(up + dn, 1) + 1e-10) else 0 end)
       end as market_entropy from th""")
def _(spark, sf):
    return _thermo(bars(spark, sf))


@query("F14_classify_phase", ID + "ts_phase:i market_phase:s",
       f"""with {THERMO}, ph as (select symbol, bar_idx, case when temp < 0.00012 then 0 when temp < 0.00016 then 1
       when temp < 0.0002 then 3 when temp is not null then 2 end as ts_phase from th)
       select *, case ts_phase when 0 then 'FROZEN' when 1 then 'LAMINAR' when 2 then 'TURBULENT'
       when 3 then 'TRANSITION' end as market_phase from ph""")
def _(spark, sf):
    limits = {"frozen": 0.00012, "laminar": 0.00016, "turbulent": 0.0002}
    return price.classify_phase(_thermo(bars(spark, sf)), limits)


SIGMA = f"""{RET}, sg as (select *, greatest(case when count(*) {w(50)} >= 3
  then stddev_pop(log_return) {w(50)} else 1e-6 end, 1e-6) as bvc_sigma from ret)"""


@query("F15_bvc_sigma", ID + "bvc_sigma:f", f"with {SIGMA} select * from sg")
def _(spark, sf):
    return run_blocked(bars(spark, sf), [price.log_return.step(), price.bvc_sigma.step(50)])


# the normal distribution as the series of Abramowitz & Stegun 26.2.10, enough for |z| <= 8
PHI = """(case when z > 8 then 1.0 when z < -8 then 0.0 else 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (z * (1 + list_sum(list_transform(range(1, 120),
  lambda k: exp(k * ln(z * z + 1e-300) - list_sum(list_transform(range(1, k + 1), lambda j: ln(2 * j + 1)))))))) end)"""

BVC = SIGMA + f""", zz as (select *, log_return / bvc_sigma as z from sg),
  bv as (select *, tick_count * {PHI} as buy_volume from zz)"""


@query("F16_bvc", ID + "buy_volume:f sell_volume:f",
       f"with {BVC} select *, tick_count - buy_volume as sell_volume from bv")
def _(spark, sf):
    return _bvc(bars(spark, sf))


def _bvc(b):
    return vpin.bvc(run_blocked(b, [price.log_return.step(), price.bvc_sigma.step(50)]))


@query("F17_volume_buckets", ID + "bucket:i closes_bucket:b",
       f"with {BARS} select symbol, bar_idx, bar_idx // 5 as bucket, (bar_idx + 1) % 5 = 0 as closes_bucket from bars")
def _(spark, sf):
    return vpin.volume_buckets(bars(spark, sf), target=100.0)


@query("F17_volume_buckets_reset", ID + "bucket:i closes_bucket:b",
       f"""with recursive {BARS}, r as (
       select symbol, bar_idx, volume as v, 0 as bucket, volume >= 250 as done from bars where bar_idx = 0
       union all select b.symbol, b.bar_idx, case when r.done then b.volume else r.v + b.volume end,
         case when r.done then r.bucket + 1 else r.bucket end,
         case when r.done then b.volume else r.v + b.volume end >= 250
       from r join bars b on b.symbol = r.symbol and b.bar_idx = r.bar_idx + 1)
       select symbol, bar_idx, bucket, done as closes_bucket from r""")
def _(spark, sf):
    return vpin.volume_buckets(bars(spark, sf), target=250.0, volume="volume")


VPIN = BVC + f""", bk as (select symbol, bar_idx // 5 as bucket,
    abs(sum(buy_volume) - sum(tick_count - buy_volume)) as oi, sum(tick_count) as vol from bv
    group by symbol, bar_idx // 5 having count(*) = 5),
  vp as (select symbol, bucket, case when count(*) over u = 10 then sum(oi) over u / sum(vol) over u end as vpin
    from bk window u as (partition by symbol order by bucket rows between 9 preceding and current row)),
  vb as (select b.*, v.vpin from bv b left join vp v on v.symbol = b.symbol
    and v.bucket = case when (b.bar_idx + 1) % 5 = 0 then b.bar_idx // 5 else b.bar_idx // 5 - 1 end)"""


def _vpin(b):
    return vpin.vpin(vpin.volume_buckets(_bvc(b), unit_rows=5), 10)


@query("F18_vpin", ID + "vpin:f", f"with {VPIN} select * from vb")
def _(spark, sf):
    return _vpin(bars(spark, sf))


@query("F19_vpin_zscore", ID + "vpin_zscore:f",
       f"""with {VPIN}, f as (select *, coalesce(vpin, 0.0) as v from vb)
       select symbol, bar_idx, {zscore_sql('v', 100)} as vpin_zscore from f""")
def _(spark, sf):
    filled = _vpin(bars(spark, sf)).withColumn("vpin", F.coalesce("vpin", F.lit(0.0)))
    return price.rolling_zscore(filled, "vpin", 100)


TR = f"""{BARS}, tr as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as true_range from (
  select *, lag(close) over (partition by symbol order by bar_idx) as pc from bars))"""


@query("F27_true_range", ID + "true_range:f", f"with {TR} select * from tr")
def _(spark, sf):
    return price.true_range(bars(spark, sf))


@query("F28_atr", ID + "atr:f", f"with {TR} select symbol, bar_idx, avg(true_range) {w(14)} as atr from tr")
def _(spark, sf):
    return price.atr(bars(spark, sf), 14)


def pivots_sql(source: str, k: int = 2) -> str:
    """CTE ``pv`` with pivot_high, pivot_low and pivot of ``source``."""
    p = "over (partition by symbol order by bar_idx rows between {} preceding and {})"
    left = p.format(2 * k, f"{k + 1} preceding")
    right = p.format(k - 1, "current row")
    lag = f"over (partition by symbol order by bar_idx)"
    return f"""pv0 as (select *, lag(high, {k}) {lag} as ph, lag(low, {k}) {lag} as pl,
        max(high) {left} as hl, max(high) {right} as hr, min(low) {left} as ll, min(low) {right} as lr,
        count(*) {left} as nl from {source}),
      pv1 as (select *, case when nl = {k} and ph > hl and ph > hr then ph end as pivot_high,
        case when nl = {k} and pl < ll and pl < lr then pl end as pivot_low from pv0),
      pv as (select *, coalesce(pivot_low, pivot_high) as pivot_price from pv1)"""


@query("F32_pivots", ID + "pivot_high:f pivot_low:f",
       f"with {BARS}, {pivots_sql('bars')} select * from pv")
def _(spark, sf):
    return trend.pivots(bars(spark, sf), 2)


def supertrend_sql(source: str, atr_rows: int = 10, factor: float = 3.0, every_bar: bool = True) -> str:
    """CTEs ending in ``st`` with the pivot SuperTrend of ``source`` (needs ``recursive``)."""
    wn = f"over (partition by symbol order by bar_idx rows between {atr_rows - 1} preceding and current row)"
    all_ = "over (partition by symbol order by bar_idx rows between unbounded preceding and current row)"
    moved = "s.last_pivot" if every_bar else "s.pivot_price"
    return f"""tr0 as (select *, lag(close) over (partition by symbol order by bar_idx) as pc from {source}),
      tr1 as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as trv from tr0),
      tr2 as (select *, avg(trv) {wn} as st_atr from tr1),
      {pivots_sql('tr2')},
      pw as (select *, last_value(pivot_price ignore nulls) {all_} as last_pivot,
        last_value(pivot_high ignore nulls) {all_} as last_pivot_high,
        last_value(pivot_low ignore nulls) {all_} as last_pivot_low from pv),
      sr as (select symbol, bar_idx, cast(null as double) as center, cast(null as double) as tup,
          cast(null as double) as tdown, 0 as st_dir, 1 as trend_duration from pw where bar_idx = 0
        union all
        select symbol, bar_idx, center, ntup, ntdown, ndir,
          case when odir <> 0 and odir <> ndir then 1 else odur + 1 end from (
          select *, case when center is null then odir when close > otdown then 1 when close < otup then -1
              when odir = 0 then 1 else odir end as ndir,
            case when center is null then otup when otup is null then up when pc > otup then greatest(up, otup)
              else up end as ntup,
            case when center is null then otdown when otdown is null then dn when pc < otdown then least(dn, otdown)
              else dn end as ntdown from (
            select *, center - {factor} * st_atr as up, center + {factor} * st_atr as dn from (
              select s.symbol, s.bar_idx, s.close, s.pc, s.st_atr, r.tup as otup, r.tdown as otdown,
                r.st_dir as odir, r.trend_duration as odur,
                case when {moved} is null then r.center when r.center is null then {moved}
                  else (r.center * 2 + {moved}) / 3 end as center
              from sr r join pw s on s.symbol = r.symbol and s.bar_idx = r.bar_idx + 1))) as x),
      st as (select p.*, s.center, s.tup, s.tdown, s.st_dir, s.trend_duration,
        case s.st_dir when 1 then s.tup when -1 then s.tdown else coalesce(s.center, 0.0) end as st_line,
        2 * {factor} * p.st_atr as st_bandwidth
        from sr s join pw p on p.symbol = s.symbol and p.bar_idx = s.bar_idx)"""


ST = f"{BARS}, {supertrend_sql('bars')}"


def _st(spark, sf):
    return trend.pivot_supertrend(bars(spark, sf))


@query("F33_pivot_center", ID + "last_pivot:f center:f", f"with recursive {ST} select * from st")
def _(spark, sf):
    return trend.pivot_center(trend.pivots(bars(spark, sf), 2))


@query("F33_pivot_center_on_pivot", ID + "center:f",
       f"with recursive {BARS}, {supertrend_sql('bars', every_bar=False)} select * from st")
def _(spark, sf):
    return trend.pivot_center(trend.pivots(bars(spark, sf), 2), "on_pivot")


@query("F34_supertrend_bands", ID + "tup:f tdown:f", f"with recursive {ST} select * from st")
def _(spark, sf):
    return _st(spark, sf)


@query("F35_supertrend_dir", ID + "st_dir:i", f"with recursive {ST} select * from st")
def _(spark, sf):
    return _st(spark, sf)


@query("F36_pivot_supertrend",
       ID + "st_line:f trend_duration:i last_pivot_high:f last_pivot_low:f st_atr:f st_bandwidth:f",
       f"with recursive {ST} select * from st")
def _(spark, sf):
    return _st(spark, sf)


@query("F36_pivot_supertrend_short_bars", ID + "st_line:f st_dir:i trend_duration:i",
       f"with recursive {GAP_BARS}, {supertrend_sql('bars', factor=0.5)} select * from st")
def _(spark, sf):
    return trend.pivot_supertrend(gap_bars(spark, sf), trend.SuperTrend(factor=0.5))


def st_features_sql(suffix: str = "") -> str:
    """CTE ``sf`` with the five features, following ``st``."""
    return f"""sf as (select *, st_dir as st_trend{suffix},
      case when st_line > 0 then (close - st_line) / greatest(st_atr, 1e-10) else 0 end as st_distance{suffix},
      trend_duration as st_bars_since_flip{suffix},
      coalesce((st_line - lag(st_line) over (partition by symbol order by bar_idx)) / greatest(st_atr, 1e-10), 0)
        as st_slope{suffix}, st_bandwidth as st_bandwidth{suffix} from st)"""


@query("F37_supertrend_features",
       ID + "st_trend:i st_distance:f st_bars_since_flip:i st_slope:f",
       f"with recursive {ST}, {st_features_sql()} select * from sf")
def _(spark, sf):
    return trend.supertrend_features(_st(spark, sf))


@query("F20_trend_columns", ID + "trend_deviation:f trend_direction:i trend_duration:i",
       f"""with recursive {ST} select *, (close - st_line) / close * 100 as trend_deviation,
       st_dir as trend_direction from st""")
def _(spark, sf):
    return trend.trend_columns(_st(spark, sf))

