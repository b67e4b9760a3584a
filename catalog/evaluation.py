"""Cross-validation, metrics, aggregates and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import BARS, TICKS, bars, query, table, ticks
from catalog.features import ID
from catalog.labels import TB, labelled
from catalog.signals import DECIDE, SCORED, decided, scored
from tickspark.operators import cv, metrics, risk
from tickspark.operators.bars import with_mid_spread
from tickspark.operators.index import exact_quantiles

# ---------------------------------------------------------------- folds

SAMPLE = f"""{TB}, sm as (select symbol, bar_idx, row_number() over (partition by symbol order by bar_idx) - 1 as pos,
    holding_bars, count(*) over (partition by symbol) as n from tb),
  fd as (select *, ntile(5) over (partition by symbol order by pos) - 1 as fold_of,
    greatest(1, least(floor(n * 0.01)::bigint, 100)) as embargo from sm)"""


def samples(spark, sf):
    """Labelled events with a dense position per symbol."""
    from tickspark.operators.index import with_row_index

    rows = labelled(spark, sf).select("symbol", "bar_idx", "open_time", "holding_bars")
    return with_row_index(rows, order=("open_time", "bar_idx"), slice_seconds=86_400, name="pos")


@query("V1_assign_folds", ID + "pos:i fold_of:i", f"with {SAMPLE} select * from fd")
def _(spark, sf):
    return cv.assign_folds(samples(spark, sf), 5)


@query("V2_embargo_size", "symbol:s embargo:i", f"with {SAMPLE} select distinct symbol, embargo from fd")
def _(spark, sf):
    n = samples(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("embargo", cv.embargo_size(F.col("n"), high=100))


FOLDS = f"""{SAMPLE}, bd as (select symbol, fold_of as fold, min(pos) as a, max(pos) as b, min(bar_idx) as ta,
    max(bar_idx + holding_bars) as tb from fd group by symbol, fold_of),
  pr as (select f.*, b.fold, case when f.fold_of = b.fold then 'test' when f.pos < b.a - f.embargo or f.pos > b.b + f.embargo
      then 'train' end as role, case when f.fold_of = b.fold then 'test'
      when f.bar_idx > b.tb + f.embargo or f.bar_idx + f.holding_bars < b.ta then 'train' end as role_t
    from fd f join bd b on b.symbol = f.symbol)"""


@query("V5_validation_tail", ID + "pos:i role:s",
       f"""with {SAMPLE}, ct as (select symbol, max(pos) - greatest((max(pos) - min(pos) + 1) // 5, 1) + 1 as cut from fd group by symbol),
       tl as (select fd.symbol, any_value(cut) as cut, min(bar_idx) as first from fd join ct using (symbol) where pos >= cut group by fd.symbol)
       select symbol, bar_idx, pos, case when pos >= cut then 'validation' else 'train' end as role from fd join tl using (symbol)
       where pos >= cut or bar_idx + holding_bars < first""")
def _(spark, sf):
    """What a model is trained on and what stops its training."""
    return cv.purged_tail(samples(spark, sf), 5)


@query("V3_purged_kfold", ID + "fold:i role:s", f"with {FOLDS} select * from pr where role is not null")
def _(spark, sf):
    return cv.purged_kfold(samples(spark, sf), 5)


@query("V3_purged_kfold_times", ID + "fold:i role:s",
       f"with {FOLDS} select symbol, bar_idx, fold, role_t as role from pr where role_t is not null")
def _(spark, sf):
    return cv.purged_kfold(samples(spark, sf), 5, start="bar_idx", holding="holding_bars")


CP = f"""{SAMPLE.replace('ntile(5)', 'ntile(6)')}, bd as (select symbol, fold_of as fold, min(pos) as a, max(pos) as b,
    min(bar_idx) as ta, max(bar_idx + holding_bars) as tb from fd group by symbol, fold_of),
  cb as (select row_number() over (order by i, j) - 1 as combo, i, j from range(0, 6) x(i), range(0, 6) y(j) where i < j),
  cr as (select f.symbol, f.bar_idx, combo, bool_or(f.fold_of = b.fold) as is_test,
      bool_or(f.pos >= b.a - f.embargo and f.pos <= b.b + f.embargo) as near,
      bool_or(f.bar_idx <= b.tb + f.embargo and f.bar_idx + f.holding_bars >= b.ta) as near_t
    from fd f cross join cb join bd b on b.symbol = f.symbol and (b.fold = cb.i or b.fold = cb.j)
    group by f.symbol, f.bar_idx, combo)"""


@query("V4_cpcv", ID + "combo:i role:s",
       f"""with {CP} select symbol, bar_idx, combo, case when is_test then 'test' else 'train' end as role from cr
       where is_test or not near""")
def _(spark, sf):
    return cv.cpcv(samples(spark, sf), 6, 2)


@query("V4_cpcv_times", ID + "combo:i role:s",
       f"""with {CP} select symbol, bar_idx, combo, case when is_test then 'test' else 'train' end as role from cr
       where is_test or not near_t""")
def _(spark, sf):
    return cv.cpcv(samples(spark, sf), 6, 2, start="bar_idx", holding="holding_bars")


@query("V4_cpcv_roles", ID + "test_bits:i train_bits:i",
       f"""with {CP} select symbol, bar_idx, sum(case when is_test then 1 << combo else 0 end) as test_bits,
       sum(case when not is_test and not near_t then 1 << combo else 0 end) as train_bits
       from (select * replace (cast(combo as bigint) as combo) from cr) group by symbol, bar_idx""")
def _(spark, sf):
    roles = cv.cpcv_roles(samples(spark, sf), 6, 2, start="bar_idx", holding="holding_bars")
    return roles.withColumns({c: F.element_at(c, 1) for c in ("test_bits", "train_bits")})


@query("J6_folds_disjoint", "n_shared:i",
       f"""with {FOLDS} select count(*) as n_shared from pr a join pr b on a.symbol = b.symbol and a.bar_idx = b.bar_idx
       and a.fold = b.fold where a.role = 'train' and b.role = 'test'""")
def _(spark, sf):
    folds = cv.purged_kfold(samples(spark, sf), 5)
    keys = ["symbol", "bar_idx", "fold"]
    train, test = (folds.filter(F.col("role") == r).select(*keys) for r in ("train", "test"))
    return train.join(test, keys, "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))


# ---------------------------------------------------------------- metrics

EVAL = f"""{SCORED}, ey as (select s.symbol, s.bar_idx, s.score, s.market_phase, t.meta_label as y,
    0.5 + (s.bar_idx % 4) * 0.5 as weight, s.bar_idx % 3 as fold
    from scored s join ({'select * from tb'}) t on t.symbol = s.symbol and t.bar_idx = s.bar_idx)"""
EVAL = f"{TB}, {EVAL[len(BARS) + 2:]}"


def evaluated(spark, sf):
    """Scores with the triple-barrier outcome as truth."""
    truth = labelled(spark, sf).select("symbol", "bar_idx", F.col("meta_label").alias("y"))
    rows = scored(spark, sf).select("symbol", "bar_idx", "score", "market_phase", "score_idx")
    i = F.col("bar_idx")
    return rows.join(truth, ["symbol", "bar_idx"]).withColumns({"weight": 0.5 + (i % 4) * 0.5, "fold": i % 3})


def ranking_sql(keys: str, source: str = "ey") -> str:
    """CTE ``rm``: AUC and average precision by ``keys``."""
    return f"""mg as (select {keys}, score, sum(y)::double as p, sum(1 - y)::double as n, sum(y * weight) as wp,
        sum((1 - y) * weight) as wn from {source} group by {keys}, score),
      cu as (select *, sum(p) over u as cp, sum(n) over u as cn, sum(wp) over u as cwp, sum(wn) over u as cwn,
        sum(p) over v as tp, sum(n) over v as tn, sum(wp) over v as twp, sum(wn) over v as twn from mg
        window u as (partition by {keys} order by score desc rows between unbounded preceding and current row), v as (partition by {keys})),
      rm as (select {keys}, case when any_value(tp) > 0 and any_value(tn) > 0 then sum(n * (cp - p + p / 2)) / any_value(tp * tn) else 0.5 end as roc_auc,
        case when any_value(tp) > 0 and any_value(tn) > 0 then sum(p * cp / (cp + cn)) / any_value(tp) else any_value(tp / (tp + tn)) end as pr_auc,
        case when any_value(tp) > 0 and any_value(tn) > 0 then sum(wn * (cwp - wp + wp / 2)) / any_value(twp * twn) else 0.5 end as weighted_roc_auc,
        case when any_value(tp) > 0 and any_value(tn) > 0 then sum(wp * cwp / (cwp + cwn)) / any_value(twp) else any_value(twp / (twp + twn)) end as weighted_pr_auc
        from cu group by {keys})"""


@query("V7_ranking_metrics", "symbol:s roc_auc:f pr_auc:f weighted_roc_auc:f weighted_pr_auc:f",
       f"with {EVAL}, {ranking_sql('symbol')} select * from rm")
def _(spark, sf):
    return metrics.ranking_metrics(evaluated(spark, sf), ["symbol"])


@query("V8_score_profile", "symbol:s p50:f p75:f p90:f p95:f p99:f mean:f std:f min:f max:f",
       f"""with {SCORED} select symbol, quantile_cont(score, 0.5) as p50, quantile_cont(score, 0.75) as p75,
       quantile_cont(score, 0.9) as p90, quantile_cont(score, 0.95) as p95, quantile_cont(score, 0.99) as p99,
       avg(score) as mean, stddev_pop(score) as std, min(score) as min, max(score) as max from scored group by symbol""")
def _(spark, sf):
    return metrics.score_profile(scored(spark, sf), ["symbol"])


CONFUSION = """coalesce(sum(c * y) / nullif(sum(c), 0), 0) as precision, coalesce(sum(c * y) / nullif(sum(y), 0), 0) as recall,
    sum(c) as n_selected, coalesce(sum(c * y * weight) / nullif(sum(c * weight), 0), 0) as weighted_precision,
    coalesce(sum(c * y * weight) / nullif(sum(y * weight), 0), 0) as weighted_recall, coalesce(sum(c * weight), 0) as weight_selected"""


def at_quantile_sql(keys: str, quantiles=(99, 95, 90, 85)) -> str:
    """CTE ``aq``: metrics at percentiles by ``keys``."""
    limits = " union all ".join(
        f"select {keys}, {q} as quantile, quantile_cont(score, {q / 100}) as threshold from ey group by {keys}" for q in quantiles
    )
    on = " and ".join(f"e.{k} = l.{k}" for k in keys.split(", "))
    picked = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f"""li as ({limits}), jq as (select {picked}, quantile, threshold, y, weight, (score >= threshold)::int as c
        from ey e join li l on {on}), aq as (select {keys}, quantile, threshold, {CONFUSION} from jq group by {keys}, quantile, threshold)"""


CONF_SPEC = " precision:f recall:f n_selected:i weighted_precision:f weighted_recall:f weight_selected:f"


@query("V9_metrics_at_quantile", "symbol:s quantile:i threshold:f" + CONF_SPEC,
       f"with {EVAL}, {at_quantile_sql('symbol')} select * from aq")
def _(spark, sf):
    return metrics.metrics_at_quantile(evaluated(spark, sf), ["symbol"])


@query("V10_metrics_at", "symbol:s" + CONF_SPEC,
       f"with {EVAL}, c0 as (select *, (score > 0.5)::int as c from ey) select symbol, {CONFUSION} from c0 group by symbol")
def _(spark, sf):
    return metrics.metrics_at(evaluated(spark, sf), ["symbol"], 0.5)


@query("V11_metrics_by_phase",
       "fold:i market_phase:s n_samples:i n_positive:i positive_rate:f pr_auc:f weighted_pr_auc:f recall_p99:f "
       "recall_p95:f weighted_recall_p90:f",
       f"""with {EVAL}, {ranking_sql('fold, market_phase')}, {at_quantile_sql('fold, market_phase')},
       ct as (select fold, market_phase, count(*) as n_samples, sum(y) as n_positive, avg(y) as positive_rate from ey group by all),
       rc as (select fold, market_phase, max(recall) filter (where quantile = 99) as r99, max(recall) filter (where quantile = 95) as r95,
         max(weighted_recall) filter (where quantile = 90) as w90 from aq group by all)
       select ct.fold, ct.market_phase, n_samples, case when n_samples >= 10 then n_positive end as n_positive,
         case when n_samples >= 10 then positive_rate end as positive_rate, case when n_samples >= 10 then pr_auc end as pr_auc,
         case when n_samples >= 10 then weighted_pr_auc end as weighted_pr_auc, case when n_samples >= 100 then r99 end as recall_p99,
         case when n_samples >= 10 then r95 end as recall_p95, case when n_samples >= 10 then w90 end as weighted_recall_p90
       from ct join rm using (fold, market_phase) join rc using (fold, market_phase)""")
def _(spark, sf):
    return metrics.metrics_by_phase(evaluated(spark, sf), min_rows=10, min_rows_p99=100, by=["fold"])


@query("V12_classification_metrics", "symbol:s accuracy:f precision:f recall:f",
       f"""with {EVAL}, c0 as (select *, (score > 0.5)::int as c from ey) select symbol, avg((c = y)::int) as accuracy,
       coalesce(sum(c * y) / nullif(sum(c), 0), 0) as precision, coalesce(sum(c * y) / nullif(sum(y), 0), 0) as recall
       from c0 group by symbol""")
def _(spark, sf):
    rows = evaluated(spark, sf).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    return metrics.classification_metrics(rows, ["symbol"])


@query("V13_temporal_recall",
       "quantile:i n_bars:i temporal_recall:f temporal_precision:f n_selected:i",
       f"""with {EVAL}, li as (select 95 as quantile, quantile_cont(score, 0.95) as threshold from ey union all
         select 90, quantile_cont(score, 0.9) from ey),
       mx as (select e.symbol, e.bar_idx, e.y, k.k as n_bars, max(s.score) as best from ey e cross join range(0, 3) k(k)
         join scored s on s.symbol = e.symbol and s.bar_idx between e.bar_idx and e.bar_idx + k.k group by all),
       jn as (select *, (best >= threshold)::int as h from mx cross join li)
       select quantile, n_bars, sum(h * y) / sum(y) as temporal_recall, coalesce(sum(h * y) / nullif(sum(h), 0), 0) as temporal_precision,
         sum(h) as n_selected from jn group by quantile, n_bars""")
def _(spark, sf):
    rows = evaluated(spark, sf)
    limits = exact_quantiles(rows, [], "score", [0.95, 0.90]).select(
        F.round(F.col("q") * 100).alias("quantile"), F.col("value").alias("threshold")
    )
    truth = rows.select("symbol", "bar_idx", "y", F.lit(True).alias("is_event"))
    every = scored(spark, sf).select("symbol", "bar_idx", "score").join(truth, ["symbol", "bar_idx"], "left")
    return metrics.temporal_recall(every.fillna(False, ["is_event"]), limits, 2)


def per_fold(spark, sf):
    rows = evaluated(spark, sf)
    ranked = metrics.ranking_metrics(rows, ["fold"])
    return ranked.join(metrics.metrics_at(rows, ["fold"], 0.5), "fold")


PER_FOLD = f"""{EVAL}, {ranking_sql('fold')}, c0 as (select *, (score > 0.5)::int as c from ey),
  ca as (select fold, {CONFUSION} from c0 group by fold), pf as (select * from rm join ca using (fold))"""
LONG = " union all ".join(
    f"select '{m}' as metric, avg({m}) as mean, stddev_pop({m}) as std from pf" for m in ("roc_auc", "pr_auc", "precision", "recall")
)


@query("V14_cv_summary", "metric:s mean:f std:f best_fold:i",
       f"with {PER_FOLD}, lg as ({LONG}) select *, (select fold from pf order by roc_auc desc, fold limit 1) as best_fold from lg")
def _(spark, sf):
    return metrics.cv_summary(per_fold(spark, sf), ["roc_auc", "pr_auc", "precision", "recall"])


@query("A9_fold_summary", "metric:s mean:f std:f", f"with {PER_FOLD} {LONG}")
def _(spark, sf):
    return metrics.fold_summary(per_fold(spark, sf), ["roc_auc", "pr_auc", "precision", "recall"])


# ---------------------------------------------------------------- aggregates

@query("A2_duplicate_events", "symbol:s n_rows:i n_distinct:i n_duplicates:i",
       """select event_type as symbol, count(*) as n_rows, count(distinct user_id) as n_distinct,
       count(*) - count(distinct user_id) as n_duplicates from events group by event_type""")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("symbol", F.col("event_type"))
    return metrics.duplicate_events(rows, ["symbol", "user_id"])


@query("A3_exact_percentiles", "symbol:s q:f value:f",
       f"""with {TICKS}, m as (select symbol, (bid + ask) / 2 as mid from ticks)
       """ + " union all ".join(f"select symbol, {q} as q, quantile_cont(mid, {q}) as value from m group by symbol"
                                for q in (0.5, 0.75, 0.9, 0.95, 0.99)))
def _(spark, sf):
    return exact_quantiles(with_mid_spread(ticks(spark, sf)), ["symbol"], "mid", [0.5, 0.75, 0.9, 0.95, 0.99])


@query("A4_variances", "symbol:s var_pop:f std_pop:f std_sample:f",
       f"""with {BARS} select symbol, var_pop(close) as var_pop, stddev_pop(close) as std_pop, stddev_samp(close) as std_sample
       from bars group by symbol""")
def _(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(
        F.var_pop("close").alias("var_pop"), F.stddev_pop("close").alias("std_pop"),
        F.stddev_samp("close").alias("std_sample"),
    )


@query("A5_conditional_counts", "symbol:s n_buy:i n_sell:i n_flat:i buy_share:f",
       f"""with {BARS} select symbol, count(*) filter (where imbalance > 0) as n_buy, count(*) filter (where imbalance < 0) as n_sell,
       count(*) filter (where imbalance = 0) as n_flat, avg((imbalance > 0)::int) as buy_share from bars group by symbol""")
def _(spark, sf):
    i = F.col("imbalance")
    return bars(spark, sf).groupBy("symbol").agg(
        F.count_if(i > 0).alias("n_buy"), F.count_if(i < 0).alias("n_sell"), F.count_if(i == 0).alias("n_flat"),
        F.avg((i > 0).cast("int")).alias("buy_share"),
    )


@query("A6_counters", "o_orderpriority:s o_orderstatus:s n:i",
       "select o_orderpriority, o_orderstatus, count(*) as n from orders group by all")
def _(spark, sf):
    return metrics.counters(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("A6_counters_totals", "o_orderpriority:s o_orderstatus:s n:i",
       "select o_orderpriority, o_orderstatus, count(*) as n from orders group by rollup (o_orderpriority, o_orderstatus)")
def _(spark, sf):
    return metrics.counters(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], totals=True)


@query("A7_latency_histogram", "symbol:s le:s n:i n_total:i latency_sum:f",
       """with l as (select event_type as symbol, value / 500 as x from events) """
       + " union all ".join(f"select symbol, '{b}' as le, count(*) filter (where x <= {b}) as n, count(*) as n_total, sum(x) as latency_sum from l group by symbol"
                            for b in metrics.LATENCY_BUCKETS)
       + " union all select symbol, '+Inf', count(*), count(*), sum(x) from l group by symbol")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), (F.col("value") / 500).alias("latency"))
    return metrics.latency_histogram(rows, "latency")


@query("A8_filter_reasons", "symbol:s reason_class:s n:i",
       f"""with {DECIDE} select symbol, case when filtered_reason is null then 'PASSED' when filtered_reason = 'COUNTER_TREND_NO_STRUCTURE'
       then 'OTHER' else filtered_reason end as reason_class, count(*) as n from dec group by all""")
def _(spark, sf):
    return metrics.filter_reason_counts(decided(spark, sf))


@query("A8_alignment_counts", "symbol:s ALIGNED:i COUNTER:i UNKNOWN:i",
       f"""with {DECIDE} select symbol, count(*) filter (where trend_alignment = 'ALIGNED') as ALIGNED,
       count(*) filter (where trend_alignment = 'COUNTER') as COUNTER, count(*) filter (where trend_alignment = 'UNKNOWN') as UNKNOWN
       from dec where event_present group by symbol""")
def _(spark, sf):
    return metrics.alignment_counts(decided(spark, sf))


@query("A10_backtest_summary", "symbol:s n_signals:i n_long:i n_short:i avg_score:f",
       f"""with {DECIDE} select symbol, count(*) as n_signals, count(*) filter (where direction = 1) as n_long,
       count(*) filter (where direction = -1) as n_short, avg(score) as avg_score from dec where filtered_reason is null group by symbol""")
def _(spark, sf):
    return metrics.backtest_summary(decided(spark, sf))


# ---------------------------------------------------------------- risk

def vectors(spark, sf):
    """Hidden vectors with a few NaN, infinite and overlong ones."""
    e = table(spark, sf, "embeddings")
    k = F.col("vec_id") % 50
    scale = F.when(k == 7, F.lit(float("nan"))).when(k == 8, F.lit(float("inf"))).when(k == 9, F.lit(1000.0)).otherwise(F.lit(1.0))
    vec = F.transform("embedding", lambda x: x.cast("double") * scale)
    score = F.when(k == 10, F.lit(float("nan"))).otherwise(F.col("label") / 10.0)
    return e.select("vec_id", vec.alias("vector"), score.alias("score"))


@query("R1_nan_inf_alerts", "vec_id:i alert:s",
       """select vec_id, case when vec_id % 50 = 10 then 'SCORE_NAN_INF' else 'VECTOR_NAN_INF' end as alert from embeddings
       where vec_id % 50 in (7, 8, 10)""")
def _(spark, sf):
    return risk.nan_inf_alerts(vectors(spark, sf))


@query("R2_saturation_alerts", "vec_id:i norm:f",
       """with n as (select vec_id, case when vec_id % 50 = 8 and list_min(list_transform(embedding, lambda x: abs(x))) > 0
         then 'inf'::double when vec_id % 50 in (7, 8) then null
         else sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double * case when vec_id % 50 = 9 then 1e6 else 1 end)))
         end as norm from embeddings) select * from n where norm > 100""")
def _(spark, sf):
    return risk.saturation_alerts(vectors(spark, sf))


SCORE_LOW = f"""{SCORED}, lo as (select *, (bar_idx // 15) % 2 = 0 and score < 0.95 as is_low from scored),
  lr as (select *, bar_idx - coalesce(max(case when not is_low then bar_idx end) over (partition by symbol order by bar_idx
    rows between unbounded preceding and current row), -1) as low_run from lo)"""


@query("R3_low_confidence_runs", ID + "low_run:i collapsed:b",
       f"with {SCORE_LOW} select *, low_run >= 10 as collapsed from lr")
def _(spark, sf):
    low = (F.floor(F.col("bar_idx") / 15) % 2 == 0) & (F.col("score") < 0.95)
    rows = scored(spark, sf).withColumn("score", F.when(low, F.lit(0.1)).otherwise(F.lit(0.9)))
    return risk.low_confidence_runs(rows, 10, 0.3)


@query("R4_latency_alerts", "event_id:i latency_ms:f",
       "select event_id, value as latency_ms from events where value > 200")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumn("latency_ms", F.col("value"))
    return risk.latency_alerts(rows)


@query("R5_halt_state", ID + "is_halted:b",
       f"""with {SCORED}, ev as (select *, case when bar_idx % 37 = 36 then 0 when score > 0.93 then 1 end as e from scored)
       select symbol, bar_idx, coalesce(last_value(e ignore nulls) over (partition by symbol order by bar_idx
         rows between unbounded preceding and current row) = 1, false) as is_halted from ev""")
def _(spark, sf):
    rows = scored(spark, sf).withColumns(
        {"is_alert": F.col("score") > 0.93, "is_unlock": F.col("bar_idx") % 37 == 36}
    )
    return risk.halt_state(rows)


FILLS = """fills as (select o_orderdate as ts, o_orderkey as ticket,
    case o_orderstatus when 'F' then 'FILLED' when 'O' then 'PENDING' else 'REJECTED' end as status,
    (o_totalprice - 150000) / 1000 as pnl from orders),
  fl as (select *, (ts - interval 5 hour - interval 17 hour)::date as trading_day from fills where status = 'FILLED'),
  dp as (select *, sum(pnl) over (partition by trading_day order by ts, ticket rows between unbounded preceding and current row) as daily_pnl,
    row_number() over (order by ts, ticket) as total_trades,
    sum((pnl >= 0)::int) over (order by ts, ticket rows between unbounded preceding and current row) as winning_trades,
    150000.0 + sum(pnl) over (order by ts, ticket rows between unbounded preceding and current row) as equity from fl),
  ls as (select *, total_trades - coalesce(max(case when pnl >= 0 then total_trades end) over (order by ts, ticket
    rows between unbounded preceding and current row), 0) as consecutive_losses from dp)"""


def fills(spark, sf):
    """Orders as fills of one account."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED")
    return o.select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("ticket"),
        status.alias("status"), ((F.col("o_totalprice") - 150_000) / 1000).alias("pnl"),
    )


TZ = {"tz": "Etc/GMT+5", "cutoff_hours": 17}


@query("R6_daily_pnl", "ticket:i trading_day:s daily_pnl:f",
       f"with {FILLS} select ticket, trading_day, daily_pnl from ls")
def _(spark, sf):
    return risk.daily_pnl(fills(spark, sf), **TZ)


@query("R7_loss_streaks", "ticket:i consecutive_losses:i total_trades:i winning_trades:i win_rate:f",
       f"with {FILLS} select *, winning_trades / total_trades as win_rate from ls")
def _(spark, sf):
    return risk.loss_streaks(fills(spark, sf))


DAY_FILLS = """fills as (select ts, (event_id * 7919) % 1000003 as ticket, user_id % 3 as account,
    value - 10 as pnl, ts::date as trading_day from events)"""


def day_fills(spark, sf):
    """Events as fills of three accounts with times of day and tickets that do not rise with time."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") * 7919) % 1_000_003).alias("ticket"), (F.col("user_id") % 3).alias("account"),
        F.lit("FILLED").alias("status"), (F.col("value") - 10).alias("pnl"),
    )


@query("R6_daily_pnl_accounts", "account:i ticket:i trading_day:s daily_pnl:f",
       f"""with {DAY_FILLS} select *, sum(pnl) over (partition by account, trading_day order by ts, ticket
         rows between unbounded preceding and current row) as daily_pnl from fills""")
def _(spark, sf):
    return risk.daily_pnl(day_fills(spark, sf), by=("account",))


@query("R7_loss_streaks_accounts", "account:i ticket:i consecutive_losses:i total_trades:i winning_trades:i",
       f"""with {DAY_FILLS}, n as (select *, row_number() over (partition by account order by ts, ticket) as total_trades,
         sum((pnl >= 0)::int) over (partition by account order by ts, ticket rows between unbounded preceding and current row)
         as winning_trades from fills)
       select *, total_trades - coalesce(max(case when pnl >= 0 then total_trades end) over (partition by account
         order by ts, ticket rows between unbounded preceding and current row), 0) as consecutive_losses from n""")
def _(spark, sf):
    return risk.loss_streaks(day_fills(spark, sf), by=("account",))


@query("R10_drawdown_accounts", "account:i ticket:i peak_equity:f day_start:f daily_loss_pct:f drawdown_pct:f",
       f"""with {DAY_FILLS}, e as (select *, 1000000 + sum(pnl) over (partition by account order by ts, ticket
         rows between unbounded preceding and current row) as equity from fills),
       d as (select *, max(equity) over (partition by account order by ts, ticket rows between unbounded preceding and current row) as peak_equity,
         first_value(equity) over (partition by account, trading_day order by ts, ticket) as day_start from e)
       select *, (day_start - equity) / day_start * 100 as daily_loss_pct, (peak_equity - equity) / peak_equity * 100 as drawdown_pct from d""")
def _(spark, sf):
    rows = risk.account_equity(risk.with_trading_day(day_fills(spark, sf)), 1_000_000.0, by=("account",))
    return risk.drawdown(rows, by=("account",))


@query("R8_risk_breaches", "trading_day:s ticket:i reason:s daily_pnl:f consecutive_losses:i",
       f"""with {FILLS}, hb as (select *, case when daily_pnl < -100 then 'DAILY_LOSS_LIMIT'
         when consecutive_losses >= 5 then 'CONSECUTIVE_LOSSES' end as reason from ls),
       rn as (select *, row_number() over (partition by trading_day order by ts, ticket) as r from hb where reason is not null)
       select * from rn where r = 1""")
def _(spark, sf):
    return risk.risk_breaches(fills(spark, sf), 100.0, 5, **TZ)


@query("R9_exposure_alerts", "o_orderkey:i o_totalprice:f",
       "select o_orderkey, o_totalprice from orders where o_totalprice > 400000")
def _(spark, sf):
    return risk.exposure_alerts(table(spark, sf, "orders"), 400_000, "o_totalprice")


@query("R10_drawdown", "ticket:i peak_equity:f day_start:f daily_loss_pct:f drawdown_pct:f",
       f"""with {FILLS}, dd as (select *, max(equity) over (order by ts, ticket rows between unbounded preceding and current row) as peak_equity,
         first_value(equity) over (partition by trading_day order by ts, ticket) as day_start from ls)
       select *, case when day_start > 0 then (day_start - equity) / day_start * 100 else 0 end as daily_loss_pct,
         case when peak_equity > 0 then (peak_equity - equity) / peak_equity * 100 else 0 end as drawdown_pct from dd""")
def _(spark, sf):
    equity = risk.account_equity(risk.with_trading_day(fills(spark, sf), **TZ), 150_000.0)
    return risk.drawdown(equity)


HEALTH = f"""{TICKS}, nw as (select max(ts) as now from ticks),
  hl as (select symbol, (epoch_us(any_value(now)) - epoch_us(max(ts))) / 1e6 as age_seconds from ticks, nw group by symbol),
  hs as (select *, case when age_seconds > 3600 then 'unhealthy' when age_seconds > 600 then 'degraded' else 'healthy' end as status from hl)"""


def health(spark, sf):
    t = ticks(spark, sf)
    return risk.feed_health(t, t.agg(F.max("ts").alias("now")), 600, 3600)


@query("R11_feed_health", "symbol:s age_seconds:f status:s", f"with {HEALTH} select * from hs")
def _(spark, sf):
    return health(spark, sf)


@query("R11_overall_status", "n:i overall:s",
       f"""with {HEALTH} select count(*) as n, case when bool_and(status = 'healthy') then 'healthy'
       when bool_or(status = 'unhealthy') then 'unhealthy' else 'degraded' end as overall from hs""")
def _(spark, sf):
    return risk.overall_status(health(spark, sf))


@query("R12_warmup_progress", "symbol:s n_bars:i progress:f is_warm:b",
       f"""with {BARS} select symbol, count(*) as n_bars, least(1.0, count(*) / 100.0) as progress, count(*) >= 100 as is_warm
       from bars group by symbol""")
def _(spark, sf):
    return risk.warmup_progress(bars(spark, sf), 100)


