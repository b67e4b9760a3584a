"""Data-quality profiles of ticks: one aggregation pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.bars import with_mid_spread
from tickspark.operators.clean import tick_returns
from tickspark.operators.index import with_row_index
from tickspark.operators.joins import with_key_row


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls and their share, one output row per column, counted in a single pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns
    ])
    return counts.select(F.explode(pairs).alias("p"), "_n").select(
        "p.column_name", "p.null_count", _pct(F.col("p.null_count"), F.col("_n")).alias("null_pct")
    )


def zero_profile(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(
        F.count_if(F.col("bid") == 0).alias("zero_bid"),
        F.count_if(F.col("ask") == 0).alias("zero_ask"),
    )


def price_profile(ticks: DataFrame) -> DataFrame:
    mids = with_mid_spread(ticks)
    return mids.groupBy("symbol").agg(
        F.min("mid").alias("price_min"), F.max("mid").alias("price_max"),
        F.avg("mid").alias("price_mean"), F.stddev_samp("mid").alias("price_std"),
        (F.max("mid") - F.min("mid")).alias("price_range"),
        F.min("bid").alias("bid_min"), F.max("ask").alias("ask_max"),
    )


def spread_profile(ticks: DataFrame, pip: float = 0.01, wide_sigma: float = 5.0) -> DataFrame:
    """Spread statistics; the second pass counts spreads wider than mean + 5 deviations, over distinct spreads."""
    rows = with_mid_spread(ticks)
    stats = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("spread").alias("spread_min"),
        F.max("spread").alias("spread_max"), F.avg("spread").alias("spread_mean"),
        F.stddev_samp("spread").alias("spread_std"),
        F.count_if(F.col("spread") < 0).alias("negative_count"),
    )
    limits = stats.select(
        "symbol", (F.col("spread_mean") + wide_sigma * F.col("spread_std")).alias("_limit")
    )
    distinct = rows.groupBy("symbol", "spread").agg(F.count(F.lit(1)).alias("_n"))
    is_wide = F.col("spread") > F.col("_limit")
    wide = with_key_row(distinct, limits, ["symbol"], ["spread"]).groupBy("symbol").agg(
        F.sum(F.when(is_wide, F.col("_n")).otherwise(F.lit(0))).alias("wide_count")
    )
    return stats.join(wide, "symbol").withColumns(
        {
            "spread_pips": F.col("spread_mean") / pip,
            "negative_pct": _pct(F.col("negative_count"), F.col("n")),
            "wide_pct": _pct(F.col("wide_count"), F.col("n")),
        }
    )


def return_profile(ticks: DataFrame, sigma: float = 10.0) -> DataFrame:
    """Tick-return statistics, share of zero returns and number of moves beyond 10 deviations.

    A single return has no deviation (NULL) and no large move.

    The deviation is needed before the large moves can be counted; returns are first reduced to
    counts per distinct (symbol, return), so the second look reads the reduced table.
    """
    distinct = (
        tick_returns(ticks).filter(F.col("tick_return").isNotNull())
        .groupBy("symbol", "tick_return").agg(F.count(F.lit(1)).alias("n"))
    )
    r, n = F.col("tick_return"), F.col("n")
    stats = distinct.groupBy("symbol").agg(
        F.sum("n").alias("n_returns"), (F.sum(r * n) / F.sum("n")).alias("return_mean"),
        F.min(r).alias("return_min"), F.max(r).alias("return_max"),
        F.sum(F.when(r == 0, n).otherwise(F.lit(0))).alias("zero_count"),
    )
    centre = stats.select("symbol", "return_mean", "n_returns")
    centred = with_key_row(distinct, centre, ["symbol"], ["tick_return"])
    spread = centred.groupBy("symbol").agg(
        F.sqrt(F.try_divide(
            F.sum(n * (r - F.col("return_mean")) * (r - F.col("return_mean"))), F.max("n_returns") - 1
        )).alias("return_std")
    )
    large = (
        with_key_row(distinct, spread, ["symbol"], ["tick_return"]).groupBy("symbol").agg(
            F.sum(F.when(F.abs(r) > sigma * F.col("return_std"), n).otherwise(F.lit(0)))
            .alias("large_moves"))
    )
    return stats.join(spread, "symbol").join(large, "symbol").withColumn(
        "zero_pct", _pct(F.col("zero_count"), F.col("n_returns"))
    )


def volume_profile(ticks: DataFrame, volume: str = "last_volume") -> DataFrame:
    v = F.col(volume).cast("double")
    out = ticks.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("volume_min"), F.max(v).alias("volume_max"),
        F.avg(v).alias("volume_mean"), F.stddev_samp(v).alias("volume_std"),
        F.count_if(v == 0).alias("zero_volume"),
    )
    zero = _pct(F.col("zero_volume"), F.col("n"))
    return out.withColumns(
        {
            "zero_volume_pct": zero,
            "volume_note": F.when(zero > 90, F.lit("mostly zero"))
            .when(F.col("volume_std") < 0.0001, F.lit("low variance")).otherwise(F.lit("ok")),
        }
    )


def rate_profile(ticks: DataFrame) -> DataFrame:
    """Time covered and ticks per second and minute."""
    out = ticks.filter(F.col("ts").isNotNull()).groupBy("symbol").agg(
        F.min("ts").alias("first_time"), F.max("ts").alias("last_time"),
        F.count(F.lit(1)).alias("n"),
    )
    seconds = (F.unix_micros("last_time") - F.unix_micros("first_time")) / 1e6
    rate = F.when(seconds > 0, F.col("n") / seconds).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "span_seconds": seconds, "span_days": seconds / 86400,
            "ticks_per_second": rate, "ticks_per_minute": rate * 60,
        }
    )


def feed_errors(
    ticks: DataFrame, gap_ms: float = 30_000, tolerance_ms: float = 1_000,
    arrival: str = "seq", arrivals_per_slice: int = 100_000,
) -> DataFrame:
    """Gaps and steps back in time between neighbours in order of arrival.

    Rows are sliced by arrival number, so the order of a long feed is checked in parallel.
    """
    timed = ticks.filter(F.col("ts").isNotNull()).select(
        "symbol", arrival, "ts",
        F.timestamp_micros((F.col(arrival) * F.lit(1_000_000)).cast("long")).alias("_arrived"),
        (F.unix_micros("ts") / 1000.0).alias("ms"),
    )
    rows = with_row_index(
        timed, order=("_arrived", arrival), slice_seconds=arrivals_per_slice, carry=["ms"]
    )
    step = F.col("ms") - F.col("prev_ms")
    kind = F.when(step < -tolerance_ms, F.lit("NON_MONOTONIC")).when(step > gap_ms, F.lit("GAP"))
    return rows.select("symbol", arrival, "ts", step.alias("step_ms"), kind.alias("error")).filter(
        F.col("error").isNotNull()
    )


def feed_integrity(
    ticks: DataFrame, gap_ms: float = 30_000, tolerance_ms: float = 1_000,
    max_time_errors: int = 10,
) -> DataFrame:
    """Errors per symbol and whether the feed must be given up.

    Any error may be the one that exceeds the limit, but only a step back in time stops the feed;
    the flag is set when there are more than ``max_time_errors`` errors up to such a step.
    """
    errors = feed_errors(ticks, gap_ms, tolerance_ms)
    totals = errors.groupBy("symbol").agg(
        F.count_if(F.col("error") == "GAP").alias("gaps"),
        F.count_if(F.col("error") == "NON_MONOTONIC").alias("non_monotonic"),
        F.count(F.lit(1)).alias("errors"),
        F.max(F.when(F.col("error") == "NON_MONOTONIC", F.col("seq"))).alias("_last_step"),
    )
    until = (
        with_key_row(errors, totals.select("symbol", "_last_step"), ["symbol"], ["seq"])
        .groupBy("symbol").agg(F.count_if(F.col("seq") <= F.col("_last_step")).alias("_upto"))
    )
    return totals.join(until, "symbol").withColumn(
        "aborted", F.col("_upto") > max_time_errors
    ).drop("_last_step", "_upto")


def quality_report(ticks: DataFrame) -> DataFrame:
    """List of issues and a size class per symbol."""
    moves = return_profile(ticks.filter(F.col("ts").isNotNull()))
    base = ticks.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ts").isNull() | F.col("bid").isNull() | F.col("ask").isNull()).alias("nulls"),
        F.count_if(F.col("ask") < F.col("bid")).alias("negative"),
    )
    joined = base.join(moves.select("symbol", "zero_pct", "large_moves"), "symbol", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("nulls") > 0, F.lit("missing values")),
        F.when(F.col("negative") > 0, F.lit("negative spreads")),
        F.when(F.col("zero_pct") > 50, F.lit("many zero returns")),
        F.when(F.col("large_moves") > 100, F.lit("many large moves")),
    ))
    size = (
        F.when(F.col("n") < 100_000, F.lit("small")).when(F.col("n") < 1_000_000, F.lit("medium"))
        .otherwise(F.lit("large"))
    )
    return joined.select(
        "symbol", "n", F.array_join(issues, "; ").alias("issues"),
        (F.size(issues) == 0).alias("is_good"), size.alias("size_class"),
    )
