"""Evaluation of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.layout import BARS, Layout, windowed
from tickspark.operators.index import SLICE, exact_quantiles, mass_slices, running
from tickspark.operators.joins import with_key_row


def _div(a: Column, b: Column, default: float | Column = 0.0) -> Column:
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(b > 0, a / b).otherwise(other)


def ranking_metrics(
    scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "y", weight: str = "weight",
) -> DataFrame:
    """ROC-AUC and average precision, plain and weighted.

    Rows with equal scores are merged, and the running counts from the highest score down are
    taken over score slices with about equally many scores, so a key with most of the rows is spread over many tasks.  With one
    class only the results are 0.5 and the base rate.
    """
    y, wt = F.col(label), F.col(weight).cast("double")
    merged = scored.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(y.cast("double")).alias("pos"), F.sum(1.0 - y).alias("neg"),
        F.sum(y * wt).alias("wpos"), F.sum((1 - y) * wt).alias("wneg"),
    )
    sides = ("pos", "neg", "wpos", "wneg")
    sliced = mass_slices(merged.withColumn("_d", -F.col("_s")), by, "_d")
    ranked = running(sliced, by, [SLICE], ["_d"], {f"c_{c}": ("sum", c) for c in sides})

    def area(p: str, n: str) -> Column:
        """Pairs of a negative and a higher positive, ties half."""
        return F.sum(F.col(n) * (F.col(f"c_{p}") - F.col(p) / 2))

    def precision_sum(p: str, n: str) -> Column:
        return F.sum(F.col(p) * _div(F.col(f"c_{p}"), F.col(f"c_{p}") + F.col(f"c_{n}")))

    sums = ranked.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in sides], area("pos", "neg").alias("area"),
        area("wpos", "wneg").alias("warea"), precision_sum("pos", "neg").alias("ap"),
        precision_sum("wpos", "wneg").alias("wap"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)

    def auc(value: str, p: str, n: str) -> Column:
        return F.when(both, _div(F.col(value), F.col(p) * F.col(n))).otherwise(F.lit(0.5))

    def average_precision(value: str, p: str, n: str) -> Column:
        rate = _div(F.col(p), F.col(p) + F.col(n))
        return F.when(both, _div(F.col(value), F.col(p))).otherwise(rate)

    return sums.select(
        *by, auc("area", "pos", "neg").alias("roc_auc"), average_precision("ap", "pos", "neg").alias("pr_auc"),
        auc("warea", "wpos", "wneg").alias("weighted_roc_auc"),
        average_precision("wap", "wpos", "wneg").alias("weighted_pr_auc"),
    )


def score_profile(scored: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """P50, P75, P90, P95, P99, mean, deviation, minimum and maximum of the scores."""
    qs = (0.50, 0.75, 0.90, 0.95, 0.99)
    quantiles = exact_quantiles(scored, by, score, qs)
    picked = quantiles.groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"p{int(q * 100)}") for q in qs]
    )
    stats = scored.groupBy(*by).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )
    return picked.join(stats, list(by)) if by else picked.crossJoin(stats)


def metrics_at_quantile(
    scored: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (99, 95, 90, 85),
    score: str = "score", label: str = "y", weight: str = "weight",
) -> DataFrame:
    """Precision, recall and count of the scores at or above each percentile, plain and weighted."""
    limits = exact_quantiles(scored, by, score, [q / 100 for q in quantiles]).withColumnRenamed(
        "value", "threshold"
    )
    limits = limits.withColumn("quantile", F.round(F.col("q") * 100, 6)).drop("q")
    per_key = limits.groupBy(*by).agg(F.collect_list(F.struct("quantile", "threshold")).alias("_t"))
    rows = with_key_row(scored, per_key, by, [score, label, weight])
    wide = rows.withColumn("_q", F.explode("_t")).select("*", "_q.quantile", "_q.threshold")
    return _confusion(wide, [*by, "quantile", "threshold"], F.col(score) >= F.col("threshold"), label, weight)


def metrics_at(
    scored: DataFrame, by: Sequence[str], threshold: float = 0.5, score: str = "score",
    label: str = "y", weight: str = "weight",
) -> DataFrame:
    """The same above a fixed threshold."""
    return _confusion(scored, list(by), F.col(score) > threshold, label, weight)


def _confusion(rows: DataFrame, keys: list[str], chosen: Column, label: str, weight: str) -> DataFrame:
    pos, wt = F.col(label) == 1, F.col(weight).cast("double")
    zero = F.lit(0.0)

    def total(cond: Column, value: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(zero))

    one = F.lit(1.0)
    return rows.groupBy(*keys).agg(
        _div(total(chosen & pos, one), total(chosen, one)).alias("precision"),
        _div(total(chosen & pos, one), total(pos, one)).alias("recall"),
        F.count_if(chosen).alias("n_selected"),
        _div(total(chosen & pos, wt), total(chosen, wt)).alias("weighted_precision"),
        _div(total(chosen & pos, wt), total(pos, wt)).alias("weighted_recall"),
        total(chosen, wt).alias("weight_selected"),
    )


def metrics_by_phase(
    scored: DataFrame, quantiles: Sequence[float] = (99, 95, 90, 85), phase: str = "market_phase",
    min_rows: int = 1, min_rows_p99: int = 1, by: Sequence[str] = (),
) -> DataFrame:
    """Counts, average precision and recall per phase; NULL where a phase has fewer rows than asked for."""
    keys = [*by, phase]
    counts = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("y").alias("n_positive"),
        F.avg("y").alias("positive_rate"),
    )
    ranked = ranking_metrics(scored, keys).select(*keys, "pr_auc", "weighted_pr_auc")
    at = metrics_at_quantile(scored, keys, quantiles)
    recalls = at.groupBy(*keys).agg(
        *[F.max(F.when(F.col("quantile") == q, F.col(c))).alias(f"{c}_p{int(q)}")
          for q in quantiles for c in ("recall", "weighted_recall")]
    )
    out = counts.join(ranked, keys).join(recalls, keys)
    enough = F.col("n_samples") >= min_rows
    hidden = ["positive_rate", "n_positive", "pr_auc", "weighted_pr_auc"]
    hidden += [f"{c}_p{int(q)}" for q in quantiles for c in ("recall", "weighted_recall")]
    p99 = {f"{c}_p99" for c in ("recall", "weighted_recall")}
    return out.withColumns(
        {c: F.when(enough & ((F.col("n_samples") >= min_rows_p99) | F.lit(c not in p99)), F.col(c)) for c in hidden}
    )


def classification_metrics(predicted: DataFrame, by: Sequence[str], prediction: str = "prediction", label: str = "y") -> DataFrame:
    """Accuracy, precision and recall of hard predictions."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    tp = F.count_if(p & y)
    return predicted.groupBy(*by).agg(
        F.avg((p == y).cast("double")).alias("accuracy"),
        _div(tp, F.count_if(p)).alias("precision"), _div(tp, F.count_if(y)).alias("recall"),
    )


@windowed(lookahead=lambda n, score="score": n)
def window_max(df: DataFrame, w, n: int, score: str = "score") -> DataFrame:
    """Highest score in the row and up to ``n`` rows after it, one column per length."""
    return df.withColumns({f"_m{k}": F.max(score).over(w.rowsBetween(0, k)) for k in range(n + 1)})


def temporal_recall(
    scored: DataFrame, thresholds: DataFrame, n: int = 2, event: str = "is_event", label: str = "y",
    layout: Layout = BARS,
) -> DataFrame:
    """Recall and precision when a hit may come up to ``n`` bars after the event.

    ``scored`` holds every bar; ``thresholds`` has (quantile, threshold) rows, a handful.
    """
    rows = window_max(scored, n, layout=layout).filter(F.col(event))
    lengths = F.array(*[F.struct(F.lit(k).alias("n_bars"), F.col(f"_m{k}").alias("best")) for k in range(n + 1)])
    wide = rows.withColumn("_l", F.explode(lengths)).select(label, "_l.n_bars", "_l.best")
    joined = wide.crossJoin(F.broadcast(thresholds))
    hit, pos = F.col("best") >= F.col("threshold"), F.col(label) == 1
    return joined.groupBy("quantile", "n_bars").agg(
        _div(F.count_if(hit & pos), F.count_if(pos)).alias("temporal_recall"),
        _div(F.count_if(hit & pos), F.count_if(hit)).alias("temporal_precision"),
        F.count_if(hit).alias("n_selected"),
    )


def fold_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds, one row per metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = per_fold.select(F.explode(pairs).alias("p")).select("p.metric", "p.v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def cv_summary(per_fold: DataFrame, metrics: Sequence[str], best_by: str = "roc_auc") -> DataFrame:
    """:func:`fold_summary` with the fold that did best."""
    best = per_fold.agg(F.max_by("fold", F.struct(F.col(best_by), -F.col("fold"))).alias("best_fold"))
    return fold_summary(per_fold, metrics).crossJoin(F.broadcast(best))


# ---------------------------------------------------------------- counters

# Upper bounds of the latency histograms in seconds.
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
ORDER_LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)


def counters(df: DataFrame, labels: Sequence[str], totals: bool = False) -> DataFrame:
    """Rows per combination of labels; ``totals`` adds the levels of a rollup."""
    grouped = df.rollup(*labels) if totals else df.groupBy(*labels)
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(
    df: DataFrame, latency: str, by: Sequence[str] = ("symbol",), buckets: Sequence[float] = LATENCY_BUCKETS
) -> DataFrame:
    """Cumulative counts at each upper bound, plus the total and sum of the latencies."""
    x = F.col(latency)
    counts = df.groupBy(*by).agg(
        *[F.count_if(x <= b).alias(f"_b{k}") for k, b in enumerate(buckets)],
        F.count(x).alias("n_total"), F.sum(x).alias("latency_sum"),
    )
    rows = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(buckets)],
        F.struct(F.lit("+Inf").alias("le"), F.col("n_total").alias("n")),
    )
    return counts.withColumn("_r", F.explode(rows)).select(*by, "_r.le", "_r.n", "n_total", "latency_sum")


# Reason classes, first match wins.
REASON_CLASSES = ("NO_EVENT", "WARMUP", "COLD_START", "LOW_CONFIDENCE", "NO_STOP_LOSS")


def filter_reason_counts(decisions: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars per class of filter reason."""
    reason = F.col("filtered_reason")
    klass = F.when(reason.isNull(), F.lit("PASSED"))
    for name in REASON_CLASSES:
        klass = klass.when(reason.contains(name), F.lit(name))
    rows = decisions.withColumn("reason_class", klass.otherwise(F.lit("OTHER")))
    return rows.groupBy(*by, "reason_class").agg(F.count(F.lit(1)).alias("n"))


def alignment_counts(decisions: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Events by trend alignment, one column each."""
    kinds = ["ALIGNED", "COUNTER", "UNKNOWN"]
    return (
        decisions.filter("event_present").groupBy(*by).pivot("trend_alignment", kinds)
        .agg(F.count(F.lit(1))).fillna(0, kinds)
    )


def backtest_summary(decisions: DataFrame, score: str = "score") -> DataFrame:
    """Signals taken, by side, and their average score."""
    taken = decisions.filter("should_trade")
    return taken.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("direction") == 1).alias("n_long"),
        F.count_if(F.col("direction") == -1).alias("n_short"), F.avg(score).alias("avg_score"),
    )


def duplicate_events(events: DataFrame, keys: Sequence[str] = ("symbol", "bar_idx"), approximate: bool = False) -> DataFrame:
    """Rows, distinct keys and surplus rows per symbol."""
    if approximate:
        distinct = events.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct(F.struct(*keys)).alias("n_distinct")
        )
    else:
        per_key = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
        distinct = per_key.groupBy("symbol").agg(
            F.sum("_k").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")
        )
    return distinct.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))
