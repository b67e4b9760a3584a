"""Bulk volume classification, volume buckets and VPIN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.functions.math import normal_cdf
from tickspark.layout import BARS, Layout, windowed
from tickspark.operators.scan import volume_resets


def bvc(df: DataFrame, volume: str = "tick_count") -> DataFrame:
    """Split volume into buys V*Phi(return / sigma) and sells."""
    v = F.col(volume).cast("double")
    share = normal_cdf(F.col("log_return") / F.col("bvc_sigma"))
    return df.withColumns({"buy_volume": v * share, "sell_volume": v - v * share})


def volume_buckets(
    df: DataFrame, target: float = 1000.0, volume: str = "tick_count",
    unit_rows: int | None = None, layout: Layout = BARS,
) -> DataFrame:
    """Number buckets that close at ``target`` volume and then start from zero.

    Adds ``bucket`` and ``closes_bucket``.  With ``unit_rows`` (every row carries the same
    volume, ``unit_rows`` rows fill a bucket) this is arithmetic on the row index; otherwise the
    reset points are found by the block scan of :func:`volume_resets`.
    """
    if unit_rows is not None:
        idx = F.col(layout.idx)
        return df.withColumns(
            {
                "bucket": F.floor(idx / unit_rows).cast("long"),
                "closes_bucket": (idx + 1) % unit_rows == 0,
            }
        )
    return volume_resets(df, volume, target, layout)


@windowed(lookback=lambda n: n - 1)
def _bucket_ratio(df: DataFrame, w, n: int) -> DataFrame:
    frame = w.rowsBetween(1 - n, 0)
    ratio = F.try_divide(F.sum("_oi").over(frame), F.sum("_vol").over(frame))
    full = F.count(F.lit(1)).over(frame) == n
    return df.withColumn("vpin", F.when(full, F.coalesce(ratio, F.lit(0.0))))


def vpin(df: DataFrame, n_buckets: int = 50, volume: str = "tick_count", layout: Layout = BARS) -> DataFrame:
    """Order imbalance over the last ``n_buckets`` finished buckets, per bar.

    The value of a bucket holds from the bar that closes it; bars in an unfinished bucket keep
    the value of the bucket before, so nothing is known early.
    """
    by = list(layout.by)
    buckets = df.groupBy(*by, "bucket").agg(
        F.abs(F.sum("buy_volume") - F.sum("sell_volume")).alias("_oi"),
        F.sum(F.col(volume).cast("double")).alias("_vol"),
        F.bool_or("closes_bucket").alias("_done"),
    ).filter("_done")
    rated = _bucket_ratio(
        buckets, n_buckets, layout=Layout(layout.by, "bucket", layout.block_rows)
    ).select(*by, F.col("bucket").alias("_known"), "vpin")
    known = F.when(F.col("closes_bucket"), F.col("bucket")).otherwise(F.col("bucket") - 1)
    return df.withColumn("_known", known).join(rated, [*by, "_known"], "left").drop("_known")


