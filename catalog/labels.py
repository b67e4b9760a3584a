"""Labels, weights, training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BARS, TICKS, bars, query, ticks
from catalog.features import ID, ewma_sql, w
from tickspark.operators import labels as lab
from tickspark.operators.bars import indexed_ticks
from tickspark.operators.index import SLICE

CFG = lab.Barriers(upper=2.0, lower=1.5, vertical=20, min_pct=0.1)


def vol_sql(ret: str) -> str:
    return f"""vr as (select *, coalesce({ret}, 0.0) as r from (select *, lag(close) over (partition by symbol order by bar_idx) as pc from bars)),
      vs as (select *, case when count(*) {w(20)} = 20 then stddev_pop(r) {w(20)} end as s from vr),
      vol as (select *, greatest(coalesce(first_value(s ignore nulls) over (partition by symbol order by bar_idx
        rows between current row and 19 following), 0.0), 1e-6) as sigma from vs)"""


SIG = f"{BARS}, {vol_sql('ln(close / pc)')}"


@query("L2_barrier_vol", ID + "sigma:f", f"with {SIG} select * from vol")
def _(spark, sf):
    return lab.barrier_vol(bars(spark, sf), 20)


@query("L2_barrier_vol_simple", ID + "sigma:f", f"with {BARS}, {vol_sql('close / pc - 1')} select * from vol")
def _(spark, sf):
    return lab.barrier_vol(bars(spark, sf), 20, log_returns=False)


@query("L2_barrier_vol_ewma", ID + "sigma:f",
       f"""with recursive {BARS}, lr as (select symbol, bar_idx, power(coalesce(ln(close / lag(close) over (partition by symbol
         order by bar_idx)), 0.0), 2) as x from bars), {ewma_sql('lr', 'x', 0.94, 'ev')}
       select symbol, bar_idx, greatest(sqrt(y), 1e-6) as sigma from ev_r""")
def _(spark, sf):
    return lab.barrier_vol(bars(spark, sf), kind="ewma")


TB = f"""{SIG}, evt as (select *, case when imbalance > 0 then 1 when imbalance < 0 then -1 end as direction,
    close * (1 + greatest(sigma * 100, 0.1) * 2.0 / 100) as upper_barrier,
    close * (1 - greatest(sigma * 100, 0.1) * 1.5 / 100) as lower_barrier from vol where imbalance <> 0),
  pth as (select e.symbol, e.bar_idx, b.bar_idx - e.bar_idx as off, b.close as c,
    b.close >= upper_barrier or b.close <= lower_barrier as touched
    from evt e join bars b on b.symbol = e.symbol and b.bar_idx between e.bar_idx + 1 and e.bar_idx + 20),
  fst as (select symbol, bar_idx, min(off) filter (where touched) as t, arg_min(c, off) filter (where touched) as tc,
    max(off) as l, arg_max(c, off) as lc from pth group by symbol, bar_idx),
  tb0 as (select e.*, coalesce(t, l, 0) as holding_bars, coalesce(tc, lc, e.close) as exit_price,
    case when t is null then 0 when tc >= upper_barrier then 1 else -1 end as barrier_hit
    from evt e left join fst f on f.symbol = e.symbol and f.bar_idx = e.bar_idx),
  tb as (select *, bar_idx + holding_bars as exit_idx, (exit_price - close) / close * 100 as return_pct,
    case when barrier_hit = direction then 1 else 0 end as meta_label from tb0)"""


def directed(spark, sf):
    """Bars whose flow leans to one side are the events."""
    side = F.when(F.col("imbalance") > 0, 1).when(F.col("imbalance") < 0, -1)
    return lab.barrier_vol(bars(spark, sf), 20).withColumn("direction", side)


def labelled(spark, sf, sparse: bool = False):
    return lab.meta_label(lab.triple_barrier(directed(spark, sf), CFG, sparse))


TB_SPEC = ID + "barrier_hit:i exit_idx:i exit_price:f return_pct:f holding_bars:i upper_barrier:f lower_barrier:f"


@query("L1_triple_barrier", TB_SPEC, f"with {TB} select * from tb")
def _(spark, sf):
    return labelled(spark, sf)


@query("L1_triple_barrier_sparse", TB_SPEC, f"with {TB} select * from tb")
def _(spark, sf):
    return labelled(spark, sf, sparse=True)


@query("L3_meta_label", ID + "direction:i meta_label:i", f"with {TB} select * from tb")
def _(spark, sf):
    return labelled(spark, sf)


@query("L4_label_table",
       ID + "primary_direction:i barrier_hit:i return_pct:f meta_label:i holding_bars:i entry_price:f "
       "exit_price:f stop_loss:f take_profit:f",
       f"""with {TB} select *, direction as primary_direction, close as entry_price, lower_barrier as stop_loss,
       upper_barrier as take_profit from tb""")
def _(spark, sf):
    return lab.label_table(lab.triple_barrier(directed(spark, sf), CFG))


@query("L5_label_stats",
       "symbol:s total:i upper:i upper_pct:f lower:i vertical:i vertical_pct:f success:i success_rate:f "
       "long_signals:i short_signals:i avg_return_pct:f avg_holding_bars:f",
       f"""with {TB} select symbol, count(*) as total, count(*) filter (where barrier_hit = 1) as upper,
       avg((barrier_hit = 1)::int) * 100 as upper_pct, count(*) filter (where barrier_hit = -1) as lower,
       count(*) filter (where barrier_hit = 0) as vertical, avg((barrier_hit = 0)::int) * 100 as vertical_pct,
       sum(meta_label) as success, avg(meta_label) * 100 as success_rate,
       count(*) filter (where direction = 1) as long_signals, count(*) filter (where direction = -1) as short_signals,
       avg(return_pct) as avg_return_pct, avg(holding_bars) as avg_holding_bars from tb group by symbol""")
def _(spark, sf):
    return lab.label_stats(labelled(spark, sf))


NORM = """, tot as (select symbol, sum(wt) as sw, count(*) as n from wts group by symbol)
  select symbol, bar_idx, wt / (sw + 1e-6) * n as sample_weight from wts join tot using (symbol)"""


@query("L6_weights_uniform", ID + "sample_weight:f",
       f"with {TB}, wts as (select symbol, bar_idx, 1.0 as wt from tb){NORM}")
def _(spark, sf):
    return lab.sample_weights(labelled(spark, sf))


@query("L6_weights_return", ID + "sample_weight:f",
       f"""with {TB}, m as (select symbol, avg(abs(return_pct)) as m from tb group by symbol),
       wts as (select symbol, bar_idx, least(greatest(abs(return_pct) / (m + 1e-6), 0.1), 10.0) as wt from tb join m using (symbol)){NORM}""")
def _(spark, sf):
    return lab.sample_weights(labelled(spark, sf), "return_based")


@query("L6_weights_decay", ID + "sample_weight:f",
       f"""with {TB}, m as (select symbol, max(bar_idx) as m from bars group by symbol),
       wts as (select symbol, bar_idx, exp(-ln(2) / 50 * (m - bar_idx)) as wt from tb join m using (symbol)){NORM}""")
def _(spark, sf):
    last = bars(spark, sf).groupBy("symbol").agg(F.max("bar_idx").alias("last_idx"))
    return lab.sample_weights(labelled(spark, sf), "time_decay", 50.0, last)


@query("L7_class_weights", "symbol:s weight_pos:f weight_neg:f",
       f"""with {TB}, c as (select symbol, count(*) as n, sum(meta_label) as p from tb group by symbol)
       select symbol, case when p > 0 and n > p then n / (2 * p) else 1 end as weight_pos,
       case when p > 0 and n > p then n / (2 * (n - p)) else 1 end as weight_neg from c""")
def _(spark, sf):
    return lab.class_weights(labelled(spark, sf))


MH = ", ".join(
    f"coalesce(r{h} * 1e4, 0) as return_{h}, coalesce((r{h} > 0.0003)::int, 0) as label_{h}_long, "
    f"coalesce((r{h} < -0.0003)::int, 0) as label_{h}_short" for h in (5, 10, 20)
)


@query("L8_multi_horizon",
       ID + " ".join(f"return_{h}:f label_{h}_long:i label_{h}_short:i" for h in (5, 10, 20)) + " label_direction:i",
       f"""with {BARS}, f as (select symbol, bar_idx, {', '.join(f"ln(lead(close, {h}) over (partition by symbol order by bar_idx) / close) as r{h}" for h in (5, 10, 20))} from bars)
       select symbol, bar_idx, {MH}, coalesce((r10 > 0.0003)::int, 0) - coalesce((r10 < -0.0003)::int, 0) as label_direction from f""")
def _(spark, sf):
    return lab.multi_horizon(bars(spark, sf))


@query("L9_simple_label", ID + "label:i",
       f"""with {BARS}, f as (select symbol, bar_idx, ln(lead(close, 10) over (partition by symbol order by bar_idx) / close) as r from bars)
       select symbol, bar_idx, case when r > 0.0003 then 1 when r < -0.0003 then -1 else 0 end as label from f""")
def _(spark, sf):
    return lab.simple_label(bars(spark, sf))


@query("L10_training_set", ID + "range_pct:f meta_label:i sample_weight:f",
       f"""with {TB}, n as (select symbol, count(*) as n from tb group by symbol)
       select symbol, bar_idx, (high - low) / open * 100 as range_pct, meta_label, 1.0 / (n + 1e-6) * n as sample_weight
       from tb join n using (symbol)""")
def _(spark, sf):
    rows = lab.sample_weights(labelled(spark, sf))
    feats = bars(spark, sf).select(
        "symbol", "bar_idx", ((F.col("high") - F.col("low")) / F.col("open") * 100).alias("range_pct")
    )
    return lab.training_set(rows, feats, rows)


@query("L11_funnel_audit",
       "symbol:s n_bars:i n_signals:i n_labels:i n_positive:i positive_rate:f duplicated:i orphan_labels:i",
       f"""with {TB}, nb as (select symbol, count(*) as n_bars from bars group by symbol)
       select symbol, any_value(n_bars) as n_bars, count(*) as n_signals, count(*) as n_labels, sum(meta_label) as n_positive,
       avg(meta_label) as positive_rate, 0 as duplicated, 0 as orphan_labels from tb join nb using (symbol) group by symbol""")
def _(spark, sf):
    rows = labelled(spark, sf)
    return lab.funnel_audit(rows.select("symbol", "bar_idx", "direction"), rows, bars(spark, sf))


@query("L12_sequences", ID + "pos:i close_value:f imbalance_value:f dt:f",
       f"""with {BARS}, ps as (select b.symbol, b.bar_idx, p.pos, b.bar_idx - 9 + p.pos as src from bars b, range(0, 10) p(pos))
       select p.symbol, p.bar_idx, p.pos, coalesce(b.close, 0) as close_value, coalesce(b.imbalance, 0) as imbalance_value,
       case when b.symbol is null then 1 else least(greatest(b.duration_ms / 1000, 0.001), 100) end as dt
       from ps p left join bars b on b.symbol = p.symbol and b.bar_idx = p.src""")
def _(spark, sf):
    seq = lab.sequences(bars(spark, sf), ["close", "imbalance"], 10)
    flat = seq.select("symbol", "bar_idx", "sequence_dt", F.posexplode("sequence").alias("pos", "row"))
    return flat.select(
        "symbol", "bar_idx", "pos", F.get("row", F.lit(0)).alias("close_value"),
        F.get("row", F.lit(1)).alias("imbalance_value"), F.get("sequence_dt", F.col("pos")).alias("dt"),
    )


@query("L13_balance_segments", "symbol:s segment:i trend:s n_ticks:i",
       f"""with {TICKS}, r as (select symbol, (bid + ask) / 2 as mid, row_number() over (partition by symbol order by ts, seq) - 1 as i from ticks),
       s as (select symbol, i // 50 as segment, (arg_max(mid, i) / arg_min(mid, i) - 1) * 100 as ret, count(*) as n_ticks
         from r group by symbol, i // 50),
       c as (select *, case when ret > 1 then 'up' when ret < -1 then 'down' else 'flat' end as trend from s),
       k as (select *, row_number() over (partition by trend order by substr(md5('42|' || symbol || '|' || segment), 1, 13), symbol, segment) as k from c),
       m as (select min(n) as m from (select count(*) as n from c group by trend))
       select symbol, segment, trend, n_ticks from k, m where k <= m""")
def _(spark, sf):
    return lab.balance_segments(indexed_ticks(ticks(spark, sf)).drop(SLICE), 50, 1.0)
