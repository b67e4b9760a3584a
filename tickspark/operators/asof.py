"""As-of alignment of series in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.operators.index import SLICE, time_slice


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: Sequence[str],
    by: Sequence[str] = ("symbol",), slice_seconds: int = 86_400, strict: bool = False,
) -> DataFrame:
    """For each left row the ``columns`` of the latest right row with time <= its own.

    Both sides are stacked and ordered inside (key, time slice).  The last right row of a slice
    is put in front of the following slices up to the next one that has right rows of its own;
    the last right row of the key is put in front of every later slice that has left rows.  So the left
    side is shuffled once, by (key, slice), and no task holds a whole series.  ``strict`` asks
    for an earlier time instead of an equal one.
    """
    keys = [*by, SLICE]
    payload = F.struct(*[F.col(c) for c in columns])
    r_slim = right.select(*by, F.col(right_time).alias("_t"), payload.alias("_right")).withColumn(
        SLICE, time_slice("_t", slice_seconds)
    )
    right_type = r_slim.schema["_right"].dataType
    l_rows = left.select(
        *by, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
        F.struct(*left.columns).alias("_left"), F.lit(None).cast(right_type).alias("_right"),
    ).withColumn(SLICE, time_slice("_t", slice_seconds))
    left_type = l_rows.schema["_left"].dataType

    def as_rows(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            *by, "_t", F.lit(side).alias("_side"), F.lit(None).cast(left_type).alias("_left"), "_right", SLICE
        )

    ends = r_slim.groupBy(*keys).agg(F.max_by("_right", "_t").alias("_right"), F.max("_t").alias("_t"))
    later = F.lead(SLICE).over(Window.partitionBy(*by).orderBy(SLICE))
    carried = ends.withColumn("_next", later).filter(F.col("_next").isNotNull()).select(
        *by, "_right", F.explode(F.sequence(F.col(SLICE) + 1, F.col("_next"))).alias(SLICE)
    ).withColumn("_t", F.timestamp_micros(F.col(SLICE) * (slice_seconds * 1_000_000)))
    final = ends.groupBy(*by).agg(F.max_by("_right", "_t").alias("_right"), F.max(SLICE).alias("_last"))
    tail = l_rows.select(*keys).distinct().join(final, list(by)).filter(F.col(SLICE) > F.col("_last")).withColumn(
        "_t", F.timestamp_micros(F.col(SLICE) * (slice_seconds * 1_000_000))
    )
    stacked = l_rows.unionByName(as_rows(r_slim, 1 if strict else 0))
    for carry in (carried, tail):
        stacked = stacked.unionByName(as_rows(carry, -1))
    in_slice = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = stacked.withColumn("_hit", F.last("_right", ignorenulls=True).over(in_slice)).filter(
        F.col("_left").isNotNull()
    )
    return found.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])


def align_features(
    lower: DataFrame, higher: DataFrame, columns: Sequence[str], causal: bool = True,
    default: float | None = 0.0, slice_seconds: int = 86_400,
) -> DataFrame:
    """Columns of the higher timeframe on lower bars, ``default`` where there is none yet.

    Causal: the higher bar must have ended by the time the lower bar opens.  ``causal=False``
    takes the higher bar that has started, which may still be in progress.
    """
    time = "end_time" if causal else "start_time"
    out = asof_join(lower, higher, "open_time", time, columns, slice_seconds=slice_seconds)
    if default is None:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})
