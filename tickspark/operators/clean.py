"""Cleaning rules for ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.hashing import BITS, portable_hash
from tickspark.operators.bars import with_mid_spread
from tickspark.operators.index import with_row_index
from tickspark.operators.joins import with_key_row


def valid_quotes(ticks: DataFrame) -> DataFrame:
    """Both sides positive; a plain filter, so it reaches the file scan."""
    return ticks.filter((F.col("bid") > 0) & (F.col("ask") > 0))


def positive_spread(ticks: DataFrame) -> DataFrame:
    return ticks.filter(F.col("ask") - F.col("bid") > 0)


def tick_returns(ticks: DataFrame, slice_seconds: int = 900) -> DataFrame:
    """Change of the mid against the tick before; NULL on the first."""
    rows = ticks if "mid" in ticks.columns else with_mid_spread(ticks)
    indexed = with_row_index(rows, slice_seconds=slice_seconds, carry=["mid"])
    return indexed.withColumn("tick_return", F.col("mid") - F.col("prev_mid"))


def drop_outliers(ticks: DataFrame, k: float = 10.0, slice_seconds: int = 900) -> DataFrame:
    """Keep rows whose \\|mid change\\| is at most ``k`` sample deviations; the first row stays.

    One deviation per series: a table of one row per symbol joined back by key.
    """
    moved = tick_returns(ticks, slice_seconds)
    limits = moved.groupBy("symbol").agg((F.stddev_samp("tick_return") * k).alias("_limit"))
    keep = F.col("tick_return").isNull() | (F.abs("tick_return") <= F.col("_limit"))
    return with_key_row(moved, limits, ["symbol"], ["row_idx"]).filter(keep).drop("_limit", "prev_mid", "row_idx")


def sample(
    df: DataFrame, n: int, seed: int = 42, total: int | None = None, on: Sequence[str] = (),
) -> DataFrame:
    """About ``n`` rows, repeatable for the same input and seed.

    With ``on`` a row is chosen by the hash of these columns alone, so the same rows are chosen however the
    table is stored or split; rows equal in them go together.
    """
    rows = total if total is not None else df.count()
    fraction = min(1.0, n / rows) if rows else 1.0
    if not on:
        return df.sample(fraction=fraction, seed=seed)
    return df.filter(portable_hash(on, seed) < F.lit(int(fraction * 2 ** BITS)))


def with_is_valid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """True when no listed column is NaN or infinite."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(False))

    flag = F.lit(False)
    for c in columns:
        flag = flag | bad(c)
    return df.withColumn("is_valid", ~flag)
