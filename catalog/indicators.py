"""Volume and imbalance bars, denoising and classic indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.bars import BAR_SPEC
from catalog.base import BARS, TICKS, bars, query, ticks
from catalog.features import ID, TR, ewma_sql, w
from tickspark.layout import Layout
from tickspark.operators import classic, denoise, fold
from tickspark.operators import bars as bar_ops

# ---------------------------------------------------------------- volume and imbalance bars

SEQ = f"""{TICKS}, sq as (select symbol, ts, seq, (bid + ask) / 2 as mid, ask - bid as spread, last_volume as volume,
  row_number() over (partition by symbol order by ts, seq) - 1 as row_idx from ticks where bid > 0 and ask > 0)"""


def bars_by_id_sql(source: str) -> str:
    """Bars of ``source`` rows that carry ``bar_idx`` and ``done``."""
    return f"""st as (select *, mid - lag(mid) over (partition by symbol, bar_idx order by row_idx) as step from {source}),
      ab as (select symbol, bar_idx, min(ts) as open_time, max(ts) as close_time, arg_min(mid, row_idx) as open,
        max(mid) as high, min(mid) as low, arg_max(mid, row_idx) as close, count(*) as tick_count, sum(volume) as volume,
        sum(spread) as spread_sum, count(*) filter (where step > 0) as buy_count,
        count(*) filter (where step < 0) as sell_count from st group by symbol, bar_idx having bool_or(done))
      select *, buy_count - sell_count as imbalance, (buy_count - sell_count) / greatest(1, buy_count + sell_count) as imbalance_ratio,
        tick_count - buy_count - sell_count as neutral_count,
        (epoch_us(close_time) - epoch_us(open_time)) / 1000.0 as duration_ms from ab"""


@query("B2_volume_bars", BAR_SPEC,
       f"""with recursive {SEQ}, r as (
       select symbol, row_idx, volume as v, 0 as bar_idx, volume >= 100 as done from sq where row_idx = 0
       union all select s.symbol, s.row_idx, case when r.done then s.volume else r.v + s.volume end,
         case when r.done then r.bar_idx + 1 else r.bar_idx end,
         case when r.done then s.volume else r.v + s.volume end >= 100
       from r join sq s on s.symbol = r.symbol and s.row_idx = r.row_idx + 1),
       rr as (select s.*, r.bar_idx, r.done from sq s join r using (symbol, row_idx)), {bars_by_id_sql('rr')}""")
def _(spark, sf):
    return bar_ops.volume_bars(ticks(spark, sf), 100.0, "real")


@query("B2_volume_bars_grid", BAR_SPEC,
       f"""with {SEQ}, cv as (select *, sum(volume) over (partition by symbol order by row_idx
         rows between unbounded preceding and current row) as total from sq),
       rr as (select *, cast(floor((total - volume) / 100) as bigint) as bar_idx,
         floor(total / 100) > floor((total - volume) / 100) as done from cv), {bars_by_id_sql('rr')}""")
def _(spark, sf):
    return bar_ops.volume_bars(ticks(spark, sf), 100.0, "real", grid=True)


@query("B4_imbalance_bars",
       "symbol:s bar_in_session:i open:f high:f low:f close:f tick_count:i imbalance:i is_complete:b",
       f"""with recursive {TICKS}, sq as (select symbol, ts, (bid + ask) / 2 as mid from ticks),
       sn as (select *, row_number() over (partition by symbol order by ts) - 1 as rn,
         coalesce(sign(mid - lag(mid) over (partition by symbol order by ts)), 0) as step from sq),
       r as (select symbol, rn, 0 as bar, 0.0::double as total, 1 as cnt, 0 >= 4 * 0.5 as done,
           4.0::double as et, 0.5::double as ei, 0.0::double as eff from sn where rn = 0
         union all select symbol, rn, nbar, ntot, ncnt, abs(ntot) >= net * nei, net, nei, neff from (
           select s.symbol, s.rn, case when r.done then r.bar + 1 else r.bar end as nbar,
             case when r.done then 0.0 else r.total + s.step end as ntot, case when r.done then 1 else r.cnt + 1 end as ncnt,
             case when r.done then 0.1 * r.cnt + 0.9 * r.et else r.et end as net,
             case when r.done then 0.1 * abs(r.total) / r.cnt + 0.9 * r.ei else r.ei end as nei,
             case when r.done then 0.0 else s.step end as neff
           from r join sn s on s.symbol = r.symbol and s.rn = r.rn + 1))
       select s.symbol, r.bar as bar_in_session, arg_min(mid, rn) as open, max(mid) as high,
         min(mid) as low, arg_max(mid, rn) as close, count(*) as tick_count, sum(r.eff) as imbalance,
         bool_or(r.done) as is_complete from r join sn s using (symbol, rn) group by s.symbol, r.bar""")
def _(spark, sf):
    # these ticks are hours apart: 4 expected ticks per bar instead of 50
    return fold.imbalance_bars(ticks(spark, sf), expected_ticks=4.0)


@query("B4_imbalance_bars_sessions",
       "symbol:s session_start:t bar_in_session:i open:f high:f low:f close:f tick_count:i imbalance:i is_complete:b",
       f"""with recursive {TICKS}, sq as (select symbol, ts, (bid + ask) / 2 as mid, date_trunc('day', ts)::timestamp as d from ticks),
       sn as (select *, row_number() over (partition by symbol, d order by ts) - 1 as rn,
         coalesce(sign(mid - lag(mid) over (partition by symbol, d order by ts)), 0) as step from sq),
       r as (select symbol, d, rn, 0 as bar, 0.0::double as total, 1 as cnt, 0 >= 4 * 0.5 as done,
           4.0::double as et, 0.5::double as ei, 0.0::double as eff from sn where rn = 0
         union all select symbol, d, rn, nbar, ntot, ncnt, abs(ntot) >= net * nei, net, nei, neff from (
           select s.symbol, s.d, s.rn, case when r.done then r.bar + 1 else r.bar end as nbar,
             case when r.done then 0.0 else r.total + s.step end as ntot, case when r.done then 1 else r.cnt + 1 end as ncnt,
             case when r.done then 0.1 * r.cnt + 0.9 * r.et else r.et end as net,
             case when r.done then 0.1 * abs(r.total) / r.cnt + 0.9 * r.ei else r.ei end as nei,
             case when r.done then 0.0 else s.step end as neff
           from r join sn s on s.symbol = r.symbol and s.d = r.d and s.rn = r.rn + 1))
       select s.symbol, s.d as session_start, r.bar as bar_in_session, arg_min(mid, rn) as open, max(mid) as high,
         min(mid) as low, arg_max(mid, rn) as close, count(*) as tick_count, sum(r.eff) as imbalance,
         bool_or(r.done) as is_complete from r join sn s using (symbol, d, rn) group by s.symbol, s.d, r.bar""")
def _(spark, sf):
    # these ticks are hours apart: 4 expected ticks per bar instead of 50
    return fold.imbalance_bars(ticks(spark, sf), expected_ticks=4.0, session_seconds=86_400)


# ---------------------------------------------------------------- denoising

KAL = f"""{BARS}, kr as (select symbol, bar_idx, close as x, 100.0::double as p, 1.0::double as k, 0.0::double as res
    from bars where bar_idx = 0
  union all select symbol, bar_idx, x + k * (close - x), (1 - k) * ahead, k, close - x from (
    select b.symbol, b.bar_idx, b.close, kr.x, kr.p + 0.1 as ahead, (kr.p + 0.1) / (kr.p + 1.1) as k
    from kr join bars b on b.symbol = kr.symbol and b.bar_idx = kr.bar_idx + 1))"""


@query("N1_kalman",
       ID + "kalman:f kalman_residual:f kalman_gain:f kalman_uncertainty:f kalman_residual_bps:f",
       f"""with recursive {KAL} select symbol, bar_idx, kr.x as kalman, res as kalman_residual, k as kalman_gain,
       p as kalman_uncertainty, res / close * 1e4 as kalman_residual_bps from kr join bars using (symbol, bar_idx)""")
def _(spark, sf):
    return denoise.kalman(bars(spark, sf))


@query("N2_adaptive_kalman", ID + "kalman:f kalman_residual:f kalman_gain:f",
       f"""with recursive {BARS}, ss as (select symbol, bar_idx, close as z, 0 as sn from bars),
       rn as (select *, row_number() over (partition by symbol, sn order by bar_idx) as k from ss),
       ak as (select symbol, sn, bar_idx, k, z as x, 100.0::double as p, 0.1::double as q, 1.0::double as r, [0.0::double] as rec,
           0.0::double as res, 1.0::double as gain from rn where k = 1
         union all select symbol, sn, bar_idx, k, nx, np,
           case when len(nrec) < 10 then q when list_min(nrec[-3:]) > 0 or list_max(nrec[-3:]) < 0 then q * 1.1 else q * 0.99 + 0.001 end,
           case when len(nrec) < 10 then r when ratio > 1.5 then r * 1.05 when ratio < 0.5 then greatest(r * 0.95, 0.01) else r end,
           nrec, nres, g from (
           select *, list_aggregate(nrec, 'var_pop') / (q + r + 1e-10) as ratio from (
             select *, x + g * nres as nx, (1 - g) * ahead as np, list_append(rec, nres)[-20:] as nrec from (
               select n.symbol, n.sn, n.bar_idx, n.k, a.x, a.q, a.r, a.rec, a.p + a.q as ahead,
                 (a.p + a.q) / (a.p + a.q + a.r) as g, n.z - a.x as nres
               from ak a join rn n on n.symbol = a.symbol and n.sn = a.sn and n.k = a.k + 1))))
       select symbol, bar_idx, x as kalman, res as kalman_residual, gain as kalman_gain from ak""")
def _(spark, sf):
    return fold.adaptive_kalman(bars(spark, sf))


@query("N2_adaptive_kalman_sessions", ID + "kalman:f kalman_residual:f kalman_gain:f",
       f"""with recursive {BARS}, ss as (select symbol, bar_idx, close as z, epoch_us(open_time) // 864000000000 as sn from bars),
       rn as (select *, row_number() over (partition by symbol, sn order by bar_idx) as k from ss),
       ak as (select symbol, sn, bar_idx, k, z as x, 100.0::double as p, 0.1::double as q, 1.0::double as r, [0.0::double] as rec,
           0.0::double as res, 1.0::double as gain from rn where k = 1
         union all select symbol, sn, bar_idx, k, nx, np,
           case when len(nrec) < 10 then q when list_min(nrec[-3:]) > 0 or list_max(nrec[-3:]) < 0 then q * 1.1 else q * 0.99 + 0.001 end,
           case when len(nrec) < 10 then r when ratio > 1.5 then r * 1.05 when ratio < 0.5 then greatest(r * 0.95, 0.01) else r end,
           nrec, nres, g from (
           select *, list_aggregate(nrec, 'var_pop') / (q + r + 1e-10) as ratio from (
             select *, x + g * nres as nx, (1 - g) * ahead as np, list_append(rec, nres)[-20:] as nrec from (
               select n.symbol, n.sn, n.bar_idx, n.k, a.x, a.q, a.r, a.rec, a.p + a.q as ahead,
                 (a.p + a.q) / (a.p + a.q + a.r) as g, n.z - a.x as nres
               from ak a join rn n on n.symbol = a.symbol and n.sn = a.sn and n.k = a.k + 1))))
       select symbol, bar_idx, x as kalman, res as kalman_residual, gain as kalman_gain from ak""")
def _(spark, sf):
    return fold.adaptive_kalman(bars(spark, sf), session_seconds=10 * 86_400)


P = "over (partition by symbol order by bar_idx)"
HAAR = f"""h1 as (select *, 0.5 * close + 0.5 * coalesce(lag(close) {P}, close) as a1 from bars),
  h2 as (select *, 0.5 * a1 + 0.5 * coalesce(lag(a1, 2) {P}, a1) as a2 from h1),
  haar as (select *, close - a1 as detail_1, a1 - a2 as detail_2, a2 as wavelet_trend from h2)"""


@query("N4_wavelet_decompose", ID + "detail_1:f detail_2:f wavelet_trend:f",
       f"with {BARS}, {HAAR} select * from haar")
def _(spark, sf):
    return denoise.wavelet_decompose(bars(spark, sf), "close", 2)


def filter_sql(level: int, taps) -> str:
    """CTEs ``w1`` .. of the backward-looking transform with the given filter."""
    parts, source, value = [], "bars", "close"
    for j in range(1, level + 1):
        gap = 2 ** (j - 1)
        terms = [f"{h / sum(taps)} * " + (value if k == 0 else f"coalesce(lag({value}, {gap * k}) {P}, {value})")
                 for k, h in enumerate(taps)]
        parts.append(f"w{j} as (select *, {' + '.join(terms)} as s{j} from {source})")
        source, value = f"w{j}", f"s{j}"
    return ", ".join(parts)


@query("N4_wavelet_decompose_db4", ID + "detail_1:f detail_2:f detail_3:f wavelet_trend:f close:f",
       f"""with {BARS}, {filter_sql(3, denoise.FILTERS['db4'])} select *, close - s1 as detail_1, s1 - s2 as detail_2,
       s2 - s3 as detail_3, s3 as wavelet_trend from w3""")
def _(spark, sf):
    return denoise.wavelet_decompose(bars(spark, sf), "close", 3, "db4")


SHRINK = f"""{HAAR}, pe as (select *, epoch_us(open_time) // 864000000000 as pd from haar),
  md as (select symbol, pd, quantile_cont(detail_1, 0.5) as med, count(*) as n from pe group by symbol, pd),
  sg as (select symbol, pd, quantile_cont(abs(detail_1 - med), 0.5) / 0.6745 as sigma, max(n) as n
    from pe join md using (symbol, pd) group by symbol, pd)"""


@query("N3_wavelet_denoise", ID + "denoised:f",
       f"""with {BARS}, {SHRINK}, th as (select *, sigma * sqrt(2 * ln(n)) as lim from sg)
       select symbol, bar_idx, wavelet_trend + sign(detail_1) * greatest(abs(detail_1) - lim, 0)
         + sign(detail_2) * greatest(abs(detail_2) - lim, 0) as denoised from pe join th using (symbol, pd)""")
def _(spark, sf):
    return denoise.wavelet_denoise(bars(spark, sf), level=2, period_seconds=10 * 86_400, causal=False)


@query("N3_wavelet_denoise_hard_minimax", ID + "denoised:f",
       f"""with {BARS}, {SHRINK}, th as (select *, case when n <= 32 then 0 else
         sigma * (0.3936 + 0.1829 * ln(n) / ln(2)) end as lim from sg)
       select symbol, bar_idx, wavelet_trend + case when abs(detail_1) > lim then detail_1 else 0 end
         + case when abs(detail_2) > lim then detail_2 else 0 end as denoised from pe join th using (symbol, pd)""")
def _(spark, sf):
    return denoise.wavelet_denoise(
        bars(spark, sf), level=2, mode="hard", rule="minimax", period_seconds=10 * 86_400, causal=False
    )


SO_FAR = f"""{HAAR}, pe as (select *, epoch_us(open_time) // 864000000000 as pd from haar),
  md as (select *, quantile_cont(detail_1, 0.5) over r as med, row_number() over r as n from pe
    window r as (partition by symbol, pd order by bar_idx)),
  sg as (select a.symbol, a.bar_idx, quantile_cont(abs(b.detail_1 - a.med), 0.5) / 0.6745 as sigma
    from md a join md b on b.symbol = a.symbol and b.pd = a.pd and b.bar_idx <= a.bar_idx group by all)"""


@query("N3_wavelet_denoise_causal", ID + "denoised:f",
       f"""with {BARS}, {SO_FAR}, th as (select *, sigma * sqrt(2 * ln(n)) as lim from md join sg using (symbol, bar_idx))
       select symbol, bar_idx, wavelet_trend + sign(detail_1) * greatest(abs(detail_1) - lim, 0)
         + sign(detail_2) * greatest(abs(detail_2) - lim, 0) as denoised from th""")
def _(spark, sf):
    return denoise.wavelet_denoise(bars(spark, sf), level=2, period_seconds=10 * 86_400)


@query("N3_wavelet_denoise_causal_hard_minimax", ID + "denoised:f",
       f"""with {BARS}, {SO_FAR}, th as (select *, case when n <= 32 then 0 else
         sigma * (0.3936 + 0.1829 * ln(n) / ln(2)) end as lim from md join sg using (symbol, bar_idx))
       select symbol, bar_idx, wavelet_trend + case when abs(detail_1) > lim then detail_1 else 0 end
         + case when abs(detail_2) > lim then detail_2 else 0 end as denoised from th""")
def _(spark, sf):
    return denoise.wavelet_denoise(
        bars(spark, sf), level=2, mode="hard", rule="minimax", period_seconds=10 * 86_400
    )


@query("N5_wavelet_features",
       ID + "wavelet_energy_1:f wavelet_energy_2:f wavelet_volatility_1:f wavelet_trend_ratio:f",
       f"""with {BARS}, {HAAR} select symbol, bar_idx, detail_1 * detail_1 as wavelet_energy_1,
       detail_2 * detail_2 as wavelet_energy_2, case when count(*) over p20 = 20 then stddev_pop(detail_1) over p20 end
         as wavelet_volatility_1,
       (var_pop(wavelet_trend) {w(100)}) / ((var_pop(close) {w(100)}) + 1e-10) as wavelet_trend_ratio from haar
       window p20 as (partition by symbol order by bar_idx rows between 20 preceding and 1 preceding)""")
def _(spark, sf):
    return denoise.wavelet_features(denoise.wavelet_decompose(bars(spark, sf), "close", 2), 2)


@query("N6_many_signals", "symbol:s signal:s bar_idx:i detail_1:f",
       f"""with {BARS}, lg as (select symbol, bar_idx, unnest(['high', 'low', 'close']) as signal,
         unnest([high, low, close]) as v from bars)
       select symbol, signal, bar_idx, v - (0.5 * v + 0.5 * coalesce(lag(v) over (partition by symbol, signal
         order by bar_idx), v)) as detail_1 from lg""")
def _(spark, sf):
    rows = denoise.as_signals(bars(spark, sf), ["high", "low", "close"])
    return denoise.wavelet_decompose(rows, "value", 1, layout=Layout(("symbol", "signal")))


@query("N7_denoise_combined", ID + "denoised:f",
       f"""with recursive {BARS}, {SHRINK}, th as (select *, sigma * sqrt(2 * ln(n)) as lim from sg),
       dn as (select symbol, bar_idx, wavelet_trend + sign(detail_1) * greatest(abs(detail_1) - lim, 0)
         + sign(detail_2) * greatest(abs(detail_2) - lim, 0) as z from pe join th using (symbol, pd)),
       kr as (select symbol, bar_idx, z as x, 100.0::double as p from dn where bar_idx = 0 union all
         select symbol, bar_idx, x + k * (z - x), (1 - k) * ahead from (
         select d.symbol, d.bar_idx, d.z, kr.x, kr.p + 0.1 as ahead, (kr.p + 0.1) / (kr.p + 1.1) as k
         from kr join dn d on d.symbol = kr.symbol and d.bar_idx = kr.bar_idx + 1))
       select symbol, bar_idx, x as denoised from kr""")
def _(spark, sf):
    rows = bars(spark, sf)
    smooth = denoise.wavelet_denoise(rows, level=2, period_seconds=10 * 86_400, causal=False)
    return denoise.kalman(smooth, "denoised").withColumn("denoised", F.col("kalman"))


@query("N7_denoise_modes", "mode:s n:i total:f",
       f"""with recursive {KAL} select 'none' as mode, count(*) as n, sum(close) as total from bars
       union all select 'kalman', count(*), sum(x) from kr""")
def _(spark, sf):
    out = None
    for mode in ("none", "kalman"):
        part = denoise.denoise(bars(spark, sf), mode).agg(
            F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"), F.sum("denoised").alias("total")
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- classic indicators

def rma_sql(source: str, col: str, n: int, out: str, lead: int = 0) -> str:
    """Wilder's smoothing of ``col``; ``lead`` rows at the start have no value."""
    return f"""{out}_r as (select symbol, max(bar_idx) as bar_idx, avg({col}) as y from {source}
      where bar_idx between {lead} and {lead + n - 1} group by symbol having count(*) = {n}
      union all select s.symbol, s.bar_idx, s.{col} / {n} + r.y * (1 - 1.0 / {n}) from {out}_r r
      join {source} s on s.symbol = r.symbol and s.bar_idx = r.bar_idx + 1)"""


def classic_st_sql(mult: float, out: str) -> str:
    """Classic SuperTrend as CTE ``out`` (needs ``tr`` and ``at_r``)."""
    return f"""{out}_b as (select t.symbol, t.bar_idx, t.close, t.pc, (high + low) / 2 - {mult} * y as lo,
        (high + low) / 2 + {mult} * y as hi from tr t join at_r a on a.symbol = t.symbol and a.bar_idx = t.bar_idx),
      {out} as (select symbol, bar_idx, lo as up, hi as dn, -1 as dir from {out}_b where bar_idx = 13
        union all select symbol, bar_idx, nup, ndn, case when dir = -1 then case when close > ndn then 1 else -1 end
          else case when close < nup then -1 else 1 end end from (
          select b.symbol, b.bar_idx, b.close, s.dir, case when b.lo > s.up or b.pc < s.up then b.lo else s.up end as nup,
            case when b.hi < s.dn or b.pc > s.dn then b.hi else s.dn end as ndn
          from {out} s join {out}_b b on b.symbol = s.symbol and b.bar_idx = s.bar_idx + 1))"""


DUAL = f"""{TR}, {rma_sql('tr', 'true_range', 14, 'at')}, {classic_st_sql(0.5, 's1')}, {classic_st_sql(1.0, 's2')},
  du as (select b.symbol, b.bar_idx, b.close, s1.dir as st_dir_a, case s1.dir when 1 then s1.up when -1 then s1.dn end as st_line_a,
    s2.dir as st_dir_b, case s2.dir when 1 then s2.up when -1 then s2.dn end as st_line_b
    from bars b left join s1 on s1.symbol = b.symbol and s1.bar_idx = b.bar_idx
    left join s2 on s2.symbol = b.symbol and s2.bar_idx = b.bar_idx)"""


def dual(spark, sf):
    one = classic.supertrend(bars(spark, sf), 0.5, 14, "_a")
    return classic.supertrend(one, 1.0, 14, "_b")


@query("I1_supertrend", ID + "st_dir_a:i st_line_a:f st_dir_b:i st_line_b:f",
       f"""with recursive {DUAL} select symbol, bar_idx, coalesce(st_dir_a, 0) as st_dir_a, st_line_a,
       coalesce(st_dir_b, 0) as st_dir_b, st_line_b from du""")
def _(spark, sf):
    return dual(spark, sf)


DM = f"""{BARS}, dm as (select *, high - lag(high) {P} as up, lag(low) {P} - low as dn, lag(close) {P} as pc from bars),
  dx as (select *, case when up > dn and up > 0 then up when up is not null then 0 end as plus,
    case when dn > up and dn > 0 then dn when up is not null then 0 end as minus,
    case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as trr from dm),
  {rma_sql('dx', 'plus', 14, 'pl', 1)}, {rma_sql('dx', 'minus', 14, 'mi', 1)}, {rma_sql('dx', 'trr', 14, 'ta', 1)},
  di as (select symbol, bar_idx, 100 * p.y / t.y as di_plus, 100 * m.y / t.y as di_minus,
    abs(p.y - m.y) / case when p.y + m.y = 0 then 1 else p.y + m.y end as d
    from pl_r p join mi_r m using (symbol, bar_idx) join ta_r t using (symbol, bar_idx)),
  {rma_sql('di', 'd', 14, 'ad', 14)},
  dmi as (select b.symbol, b.bar_idx, di_plus, di_minus, 100 * a.y as adx from bars b
    left join di on di.symbol = b.symbol and di.bar_idx = b.bar_idx
    left join ad_r a on a.symbol = b.symbol and a.bar_idx = b.bar_idx),
  dms as (select *, case when di_plus >= di_minus and adx >= 25 then 'bull' when di_plus < di_minus and adx >= 25 then 'bear'
    when adx > 17 then 'weak' when adx is not null then 'none' end as dmi_state from dmi)"""


@query("I2_dmi", ID + "di_plus:f di_minus:f adx:f dmi_state:s", f"with recursive {DM} select * from dms")
def _(spark, sf):
    return classic.dmi(bars(spark, sf))


def donchian(n: int) -> str:
    return f"case when count(*) {w(n)} = {n} then ((max(high) {w(n)}) + (min(low) {w(n)})) / 2 end"


ICHI = f"""{BARS}, ic as (select *, {donchian(9)} as conversion_line, {donchian(26)} as base_line,
    {donchian(52)} as lead_line_2 from bars),
  ich as (select *, (conversion_line + base_line) / 2 as lead_line_1 from ic),
  cl as (select *, lag(lead_line_1, 25) {P} as a, lag(lead_line_2, 25) {P} as b from ich),
  cls as (select *, case when close > a and close > b then 'above' when close < a and close < b then 'below'
    when (close > a and close < b) or (close < a and close > b) then 'in' end as cloud_state from cl)"""


@query("I3_ichimoku", ID + "conversion_line:f base_line:f lead_line_1:f lead_line_2:f", f"with {ICHI} select * from ich")
def _(spark, sf):
    return classic.ichimoku(bars(spark, sf))


@query("I4_cloud_state", ID + "cloud_state:s", f"with {ICHI} select * from cls")
def _(spark, sf):
    return classic.cloud_state(classic.ichimoku(bars(spark, sf)))


VOL = f"""{BARS}, vs as (select *, case when count(*) {w(21)} = 21 then avg(volume) {w(21)} end as volume_sma from bars),
  vst as (select *, case when volume > volume_sma * 1.618 then 'high' when volume >= volume_sma * 0.618 then 'average'
    when volume_sma is not null then 'low' end as volume_state from vs)"""


@query("I5_volume_state", ID + "volume_sma:f volume_state:s", f"with {VOL} select * from vst")
def _(spark, sf):
    return classic.volume_state(bars(spark, sf))


RSI = f"""{BARS}, cg as (select *, close - lag(close) {P} as ch from bars),
  gl as (select *, greatest(ch, 0) as gain, greatest(-ch, 0) as loss from cg where ch is not null),
  {rma_sql('gl', 'gain', 14, 'gu', 1)}, {rma_sql('gl', 'loss', 14, 'gd', 1)},
  rs as (select u.symbol, u.bar_idx, case when d.y = 0 then 100 when u.y = 0 then 0 else 100 - 100 / (1 + u.y / d.y) end as rsi
    from gu_r u join gd_r d using (symbol, bar_idx)),
  rsi as (select b.symbol, b.bar_idx, rsi, rsi - lag(rsi) over (partition by b.symbol order by b.bar_idx) > 0 as rsi_rising,
    case when rsi > 70 then 'overbought' when rsi < 30 then 'oversold' when rsi >= 50 then 'bullish'
      when rsi is not null then 'bearish' end as rsi_zone
    from bars b left join rs r on r.symbol = b.symbol and r.bar_idx = b.bar_idx)"""


@query("I6_rsi", ID + "rsi:f rsi_rising:b rsi_zone:s", f"with recursive {RSI} select * from rsi")
def _(spark, sf):
    return classic.rsi(bars(spark, sf))


STO = f"""{BARS}, s0 as (select *, 100 * (close - (min(low) {w(14)})) / nullif((max(high) {w(14)}) - (min(low) {w(14)}), 0) as raw from bars),
  s1 as (select *, case when bar_idx >= 15 then avg(raw) {w(3)} end as stoch_k from s0),
  s2 as (select *, case when bar_idx >= 17 then avg(stoch_k) {w(3)} end as stoch_d from s1),
  sto as (select *, case when stoch_k > 80 then 'overbought' when stoch_k < 20 then 'oversold'
    when stoch_k is not null then 'neutral' end as stoch_zone from s2)"""


@query("I7_stoch", ID + "stoch_k:f stoch_d:f stoch_zone:s", f"with {STO} select * from sto")
def _(spark, sf):
    return classic.stoch(bars(spark, sf))


@query("I8_macd", ID + "macd:f macd_signal:f macd_hist:f",
       f"""with recursive {BARS}, {ewma_sql('bars', 'close', 11 / 13, 'fa')}, {ewma_sql('bars', 'close', 25 / 27, 'sl')},
       mc as (select f.symbol, f.bar_idx, f.y - s.y as m from fa_r f join sl_r s using (symbol, bar_idx)),
       {ewma_sql('mc', 'm', 0.8, 'sg')}
       select symbol, bar_idx, m as macd, y as macd_signal, m - y as macd_hist from mc join sg_r using (symbol, bar_idx)""")
def _(spark, sf):
    return classic.macd(bars(spark, sf))


@query("I9_crosses", ID + "cross_sign:i",
       f"""with {ICHI}, x as (select *, conversion_line - base_line as d, lag(conversion_line) {P} - lag(base_line) {P} as pd from ich)
       select *, case when d > 0 and pd <= 0 then 1 when d < 0 and pd >= 0 then -1 else 0 end as cross_sign from x""")
def _(spark, sf):
    return classic.crosses(classic.ichimoku(bars(spark, sf)), "conversion_line", "base_line", "cross_sign")


@query("I10_dual_trend", ID + "dual_bull:b dual_bear:b dual_bull_onset:b dual_bear_onset:b",
       f"""with recursive {DUAL}, bb as (select *, coalesce(close > st_line_a and close > st_line_b, false) as dual_bull,
         coalesce(close < st_line_a and close < st_line_b, false) as dual_bear from du)
       select *, dual_bull and dual_bull <> lag(dual_bull) {P} as dual_bull_onset,
         dual_bear and dual_bear <> lag(dual_bear) {P} as dual_bear_onset from bb""")
def _(spark, sf):
    return classic.dual_trend(dual(spark, sf))


@query("I11_status_panel", "symbol:s bar_idx:i cloud_state:s volume_state:s stoch_zone:s",
       f"""with {ICHI}, {VOL[len(BARS) + 2:]}, {STO[len(BARS) + 2:]}
       select c.symbol, max(c.bar_idx) as bar_idx, arg_max(cloud_state, c.bar_idx) as cloud_state,
         arg_max(volume_state, c.bar_idx) as volume_state, arg_max(stoch_zone, c.bar_idx) as stoch_zone
       from cls c join vst v using (symbol, bar_idx) join sto s using (symbol, bar_idx) group by c.symbol""")
def _(spark, sf):
    from tickspark.layout import run_blocked

    steps = [classic.ichimoku.step(), classic.cloud_state.step(), classic.volume_state.step(), classic.stoch.step()]
    return classic.status_panel(run_blocked(bars(spark, sf), steps))
