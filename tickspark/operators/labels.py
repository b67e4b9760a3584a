"""Labels, weights and training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.hashing import BITS, portable_hash
from tickspark.layout import BARS, Layout, run_blocked, windowed
from tickspark.operators import price
from tickspark.operators.index import with_row_index
from tickspark.operators.joins import event_window, with_key_row
from tickspark.operators.scan import Decay, decaying_scan


@dataclass(frozen=True)
class Barriers:
    """Parameters of the triple barrier."""

    upper: float = 2.0
    lower: float = 2.0
    vertical: int = 20
    min_pct: float = 0.1
    vol_rows: int = 20


@windowed(lookback=lambda n=20, **_: n, lookahead=lambda n=20, **_: n)
def _realized(df: DataFrame, w, n: int, log_returns: bool) -> DataFrame:
    prev = F.lag("close").over(w)
    # NULL next to a close of 0, which counts as no return.
    ratio = F.try_divide(F.col("close"), prev)
    r = F.log(ratio) if log_returns else ratio - 1
    out = df.withColumn("_r", F.coalesce(r, F.lit(0.0)))
    frame = w.rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(frame) == n
    out = out.withColumn("_s", F.when(full, F.stddev_pop("_r").over(frame)))
    ahead = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, n - 1))
    sigma = F.greatest(F.coalesce(ahead, F.lit(0.0)), F.lit(1e-6))
    return out.withColumn("sigma", sigma).drop("_r", "_s")


def barrier_vol(
    bars: DataFrame, n: int = 20, kind: str = "realized", log_returns: bool = True,
    decay: float = 0.94, layout: Layout = BARS,
) -> DataFrame:
    """Volatility per bar, at least 1e-6.

    ``realized``: deviation over a full window; the rows before take the first full value.
    ``ewma``: exponential average of squared returns.
    """
    if kind == "realized":
        return run_blocked(bars, [_realized.step(n=n, log_returns=log_returns)], layout)
    rows = price.log_return(bars, layout=layout)
    r = F.col("log_return") if log_returns else F.exp("log_return") - 1
    out = decaying_scan(rows.withColumn("_sq", r * r), [Decay("_var", "_sq", decay)], layout)
    return out.withColumn("sigma", F.greatest(F.sqrt("_var"), F.lit(1e-6))).drop("_sq", "_var")


def _with_barriers(df: DataFrame, cfg: Barriers) -> DataFrame:
    width = F.greatest(F.col("sigma") * 100, F.lit(cfg.min_pct)) / 100
    return df.withColumns(
        {
            "upper_barrier": F.col("close") * (1 + width * cfg.upper),
            "lower_barrier": F.col("close") * (1 - width * cfg.lower),
        }
    )


def _finish(df: DataFrame) -> DataFrame:
    """From ``_offset`` (rows held), ``exit_price`` and ``_touched`` to the label columns."""
    hit = F.when(~F.col("_touched"), 0).when(F.col("exit_price") >= F.col("upper_barrier"), 1).otherwise(-1)
    return df.withColumns(
        {
            "barrier_hit": hit,
            "return_pct": F.try_divide(F.col("exit_price") - F.col("close"), F.col("close")) * 100,
            "holding_bars": F.col("_offset").cast("long"),
            "exit_idx": (F.col("bar_idx") + F.col("_offset")).cast("long"),
        }
    ).drop("_offset", "_touched")


@windowed(lookahead=lambda cfg: cfg.vertical)
def _path_labels(df: DataFrame, w, cfg: Barriers) -> DataFrame:
    rows = _with_barriers(df, cfg).withColumn(
        "_path", F.collect_list("close").over(w.rowsBetween(1, cfg.vertical))
    )
    touch = F.transform(
        F.col("_path"), lambda c: (c >= F.col("upper_barrier")) | (c <= F.col("lower_barrier"))
    )
    rows = rows.withColumn("_at", F.array_position(touch, True))
    rows = rows.withColumn(
        "_offset", F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.size("_path").cast("long"))
    )
    exit_price = F.when(F.col("_offset") == 0, F.col("close")).otherwise(
        F.get("_path", F.col("_offset").cast("int") - 1)
    )
    return _finish(
        rows.withColumns({"exit_price": exit_price, "_touched": F.col("_at") > 0}).drop("_path", "_at")
    )


def triple_barrier(
    bars: DataFrame, cfg: Barriers = Barriers(), sparse: bool = False, layout: Layout = BARS
) -> DataFrame:
    """Label the rows with ``direction`` 1 or -1 by the first barrier the close touches.

    Needs ``sigma`` (:func:`barrier_vol`).  Dense events look ahead in the block windows, one
    shuffle of the bars; with ``sparse`` only the events are expanded and joined.
    """
    is_event = F.col("direction").isin(1, -1)
    if not sparse:
        return _path_labels(bars, cfg, layout=layout).filter(is_event)
    events = _with_barriers(bars.filter(is_event), cfg)
    ahead = bars.select("symbol", "bar_idx", F.col("close").alias("_c"))
    pairs = event_window(events.select("symbol", "bar_idx", "upper_barrier", "lower_barrier"), ahead, 1, cfg.vertical)
    touched = (F.col("_c") >= F.col("upper_barrier")) | (F.col("_c") <= F.col("lower_barrier"))
    first = pairs.groupBy("symbol", "bar_idx").agg(
        F.min(F.when(touched, F.col("offset"))).alias("_t"),
        F.min_by("_c", F.when(touched, F.col("offset"))).alias("_tc"),
        F.max("offset").alias("_last"), F.max_by("_c", "offset").alias("_lc"),
    )
    rows = events.join(first, ["symbol", "bar_idx"], "left").withColumns(
        {
            "_touched": F.col("_t").isNotNull(),
            "_offset": F.coalesce("_t", "_last", F.lit(0)),
            "exit_price": F.coalesce("_tc", "_lc", "close"),
        }
    )
    return _finish(rows.drop("_t", "_tc", "_last", "_lc"))


def meta_label(labels: DataFrame) -> DataFrame:
    """1 when the barrier on the side of the direction was hit."""
    return labels.withColumn("meta_label", (F.col("barrier_hit") == F.col("direction")).cast("int"))


def label_table(labels: DataFrame) -> DataFrame:
    """Stored label columns; the barriers serve as stop and target."""
    return meta_label(labels).select(
        "symbol", "bar_idx", F.col("direction").alias("primary_direction"), "barrier_hit",
        "return_pct", "meta_label", "holding_bars", F.col("close").alias("entry_price"), "exit_price",
        F.col("lower_barrier").alias("stop_loss"), F.col("upper_barrier").alias("take_profit"),
    )


def label_stats(labels: DataFrame) -> DataFrame:
    """Distribution of labels per symbol."""
    def share(cond: Column) -> Column:
        return F.avg(cond.cast("int")) * 100

    hit = F.col("barrier_hit")
    return labels.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit == 1).alias("upper"), share(hit == 1).alias("upper_pct"),
        F.count_if(hit == -1).alias("lower"), share(hit == -1).alias("lower_pct"),
        F.count_if(hit == 0).alias("vertical"), share(hit == 0).alias("vertical_pct"),
        F.sum("meta_label").alias("success"), share(F.col("meta_label") == 1).alias("success_rate"),
        F.count_if(F.col("direction") == 1).alias("long_signals"),
        F.count_if(F.col("direction") == -1).alias("short_signals"),
        F.avg("return_pct").alias("avg_return_pct"), F.avg("holding_bars").alias("avg_holding_bars"),
    )


def sample_weights(
    labels: DataFrame, method: str = "uniform", half_life: float = 500.0, last_idx: DataFrame | None = None
) -> DataFrame:
    """Weights per symbol that sum to the number of labels.

    ``return_based``: |return| over its mean, clipped to 0.1..10.  ``time_decay``: halved every
    ``half_life`` bars before ``last_idx`` (symbol, last_idx), by default the last label.
    """
    if method == "return_based":
        size = F.abs("return_pct")
        scale = labels.groupBy("symbol").agg(F.avg(size).alias("_m"), F.max(size).alias("_x"))
        raw = F.when(F.col("_x") > 0, size / (F.col("_m") + 1e-6)).otherwise(F.lit(1.0))
        weighted = with_key_row(labels, scale, ["symbol"], ["bar_idx"]).withColumn(
            "_w", F.least(F.greatest(raw, F.lit(0.1)), F.lit(10.0))
        ).drop("_m", "_x")
    elif method == "time_decay":
        if last_idx is None:
            last_idx = labels.groupBy("symbol").agg(F.max("bar_idx").alias("last_idx"))
        age = F.col("last_idx") - F.col("bar_idx")
        weighted = with_key_row(labels, last_idx, ["symbol"], ["bar_idx"]).withColumn(
            "_w", F.exp(-F.log(F.lit(2.0)) / half_life * age)
        ).drop("last_idx")
    elif method == "uniform":
        weighted = labels.withColumn("_w", F.lit(1.0))
    else:
        raise ValueError(f"unknown weight method {method}")
    totals = weighted.groupBy("symbol").agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return with_key_row(weighted, totals, ["symbol"], ["bar_idx"]).withColumn(
        "sample_weight", F.col("_w") / (F.col("_s") + 1e-6) * F.col("_n")
    ).drop("_w", "_s", "_n")


def class_weights(labels: DataFrame) -> DataFrame:
    """n / (2 * n_c) per class; 1 when a class is missing."""
    counts = labels.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("meta_label").alias("pos")
    )
    neg = F.col("n") - F.col("pos")
    both = (F.col("pos") > 0) & (neg > 0)
    return counts.select(
        "symbol", F.when(both, F.col("n") / (2 * F.col("pos"))).otherwise(F.lit(1.0)).alias("weight_pos"),
        F.when(both, F.col("n") / (2 * neg)).otherwise(F.lit(1.0)).alias("weight_neg"),
    )


@windowed(lookahead=lambda horizons=(5, 10, 20), **_: max(horizons))
def multi_horizon(
    df: DataFrame, w, horizons: Sequence[int] = (5, 10, 20), threshold_bps: float = 3.0,
    log_returns: bool = True, direction_from: int = 10,
) -> DataFrame:
    """Forward returns in bps and long/short flags for every horizon; 0 where the future is short."""
    limit = threshold_bps / 1e4
    for h in horizons:
        ratio = F.try_divide(F.lead("close", h).over(w), F.col("close"))
        ret = F.log(ratio) if log_returns else ratio - 1
        df = df.withColumn("_ret", ret).withColumns(
            {
                f"return_{h}": F.coalesce(F.col("_ret") * 1e4, F.lit(0.0)),
                f"label_{h}_long": F.coalesce((F.col("_ret") > limit).cast("int"), F.lit(0)),
                f"label_{h}_short": F.coalesce((F.col("_ret") < -limit).cast("int"), F.lit(0)),
            }
        )
    h = direction_from
    direction = F.col(f"label_{h}_long") - F.col(f"label_{h}_short") if h in horizons else F.lit(0)
    return df.withColumn("label_direction", direction).drop("_ret")


@windowed(lookahead=lambda h=10, bps=3.0: h)
def simple_label(df: DataFrame, w, h: int = 10, bps: float = 3.0) -> DataFrame:
    """1, -1 or 0 by the log return over ``h`` bars."""
    ret = F.log(F.try_divide(F.lead("close", h).over(w), F.col("close")))
    return df.withColumn(
        "label", F.when(ret > bps / 1e4, 1).when(ret < -bps / 1e4, -1).otherwise(0)
    )


def training_set(events: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with their feature row, label and weight."""
    keys = ["symbol", "bar_idx"]
    return events.select(*keys).join(features, keys).join(
        labels.select(*keys, "meta_label", "sample_weight", "holding_bars", "direction"), keys
    )


def funnel_counts(signals: DataFrame, labels: DataFrame, bars: DataFrame) -> DataFrame:
    """Counts and faults of the step from signals to labels, per symbol."""
    keys = ["symbol", "bar_idx"]
    size = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n_bars"))
    per_bar = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), F.count_if(~F.col("direction").isin(1, -1)).alias("_bad")
    )
    per_bar = with_key_row(per_bar, size, ["symbol"], ["bar_idx"])
    outside = (F.col("bar_idx") < 0) | (F.col("bar_idx") >= F.col("n_bars"))
    totals = per_bar.groupBy("symbol").agg(
        F.max("n_bars").alias("n_bars"), F.sum("_k").alias("n_signals"),
        F.count(F.lit(1)).alias("n_distinct"), F.sum("_bad").alias("bad_direction"),
        F.sum(F.when(outside, F.col("_k")).otherwise(F.lit(0))).alias("out_of_range"),
        F.count_if(F.col("_k") > 1).alias("duplicated"),
    )
    made = labels.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("meta_label").alias("n_positive")
    )
    orphans = labels.join(signals.select(*keys), keys, "left_anti").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("orphan_labels")
    )
    out = totals.join(made, "symbol", "left").join(orphans, "symbol", "left")
    filled = out.fillna(0, ["n_labels", "n_positive", "orphan_labels"])
    return filled.withColumn(
        "positive_rate",
        F.when(F.col("n_labels") > 0, F.col("n_positive") / F.col("n_labels")).otherwise(F.lit(0.0)),
    )


def funnel_audit(signals: DataFrame, labels: DataFrame, bars: DataFrame) -> DataFrame:
    """:func:`funnel_counts`, raising on the first symbol with a fault."""
    counts = funnel_counts(signals, labels, bars)
    faults = ("bad_direction", "out_of_range", "duplicated", "orphan_labels")
    broken = counts.filter(" or ".join(f"{c} > 0" for c in faults)).limit(1).collect()
    if broken:
        raise ValueError(f"signals and labels do not line up: {broken[0].asDict()}")
    return counts


@windowed(lookback=lambda features, length=10, **_: length - 1)
def sequences(df: DataFrame, w, features: Sequence[str], length: int = 10, dt_ms: str = "duration_ms") -> DataFrame:
    """The last ``length`` feature rows and time steps of each bar, zero-padded on the left.

    Time steps are seconds clipped to 0.001..100 and padded with 1.
    """
    frame = w.rowsBetween(1 - length, 0)
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    dt = F.least(F.greatest(F.col(dt_ms) / 1000, F.lit(0.001)), F.lit(100.0))
    out = df.withColumns({"_row": row, "_dt": dt}).withColumns(
        {"_rows": F.collect_list("_row").over(frame), "_dts": F.collect_list("_dt").over(frame)}
    )
    missing = F.lit(length) - F.size("_rows")
    zero = F.array(*[F.lit(0.0) for _ in features])
    return out.withColumns(
        {
            "sequence": F.concat(F.array_repeat(zero, missing), F.col("_rows")),
            "sequence_dt": F.concat(F.array_repeat(F.lit(1.0), missing), F.col("_dts")),
        }
    ).drop("_row", "_dt", "_rows", "_dts")


def balance_segments(
    rows: DataFrame, segment_rows: int = 5000, threshold_pct: float = 0.3, seed: int = 42
) -> DataFrame:
    """Equally many rising, falling and flat segments of ``segment_rows`` ticks.

    ``rows`` carry ``row_idx`` and ``mid``.  The segments of a class are numbered in the order of
    a seeded hash, cut by hash value so that no task holds a class.
    """
    segments = rows.groupBy("symbol", F.floor(F.col("row_idx") / segment_rows).cast("long").alias("segment")).agg(
        F.min_by("mid", "row_idx").alias("first_mid"), F.max_by("mid", "row_idx").alias("last_mid"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    ret = (F.try_divide(F.col("last_mid"), F.col("first_mid")) - 1) * 100
    classed = segments.withColumns(
        {
            "trend": F.when(ret > threshold_pct, F.lit("up")).when(ret < -threshold_pct, F.lit("down"))
            .otherwise(F.lit("flat")),
            "_h": portable_hash(["symbol", "segment"], seed),
        }
    )
    numbered = with_row_index(
        classed, by=["trend"], order=["_h", "symbol", "segment"], name="_rank",
        slices=F.shiftright("_h", BITS - 16),
    )
    sizes = classed.groupBy("trend").agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_keep"))
    kept = numbered.crossJoin(F.broadcast(sizes)).filter(F.col("_rank") < F.col("_keep"))
    return kept.drop("_h", "_rank", "_keep")


