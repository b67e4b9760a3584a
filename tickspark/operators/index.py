"""Dense row numbers per series without sorting a whole series in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.operators.joins import with_key_row

SLICE = "_slice"


def time_slice(ts: str | Column, seconds: int) -> Column:
    """Number of the time slice a timestamp falls into."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / (seconds * 1_000_000)).cast("long")


def _order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value for ``order``.

    A (timestamp, whole number) pair becomes one decimal: unlike a struct it fits the fixed-width
    buffers of hash aggregation, so finding the last row needs no sort.
    """
    types = [df.schema[c].dataType for c in order]
    whole = (T.LongType, T.IntegerType)
    if len(order) == 2 and isinstance(types[0], T.TimestampType) and isinstance(types[1], whole):
        micros, seq = F.unix_micros(order[0]), F.col(order[1])
        shifted = micros.cast("decimal(18,0)") * F.lit(str(10 ** 19)).cast("decimal(20,0)")
        return (shifted + seq.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*order)


def with_row_index(
    df: DataFrame,
    by: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "seq"),
    slice_seconds: int = 900,
    name: str = "row_idx",
    carry: Sequence[str] = (),
    keep_slice: bool = False,
    slices: Column | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by ``order``.

    Rows are counted per (series, time slice); a running sum over this small table gives each
    slice its first position, and the position inside the slice is a ``row_number``.  Rows move
    once, hashed by (series, slice), so one series with most of the data is spread over as many
    tasks as it has slices.  For each column in ``carry`` the value of the row before is added
    as ``prev_<column>``, also across slice edges.  ``slices`` replaces the time slice by another
    number that never falls along ``order``.  A NULL in the first order column is an error: such a
    row has no place in the series.
    """
    if slices is None:
        missing = F.raise_error(F.lit(f"NULL in {order[0]}: rows without a place in the series")).cast("long")
        slices = F.coalesce(time_slice(order[0], slice_seconds), missing)
    sliced = df.withColumn(SLICE, slices)
    keys = [*by, SLICE]
    aggs = [F.count(F.lit(1)).alias("_n")]
    if carry:
        key = _order_key(df, order)
        aggs += [F.max_by(c, key).alias(f"_last_{c}") for c in carry]
    over_slices = Window.partitionBy(*by).orderBy(SLICE)
    before = over_slices.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys).agg(*aggs).select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *[F.lag(f"_last_{c}").over(over_slices).alias(f"_edge_{c}") for c in carry],
    )
    in_slice = Window.partitionBy(*keys).orderBy(*order)
    out = sliced.join(offsets, keys).withColumns(
        {
            name: F.col("_offset") + F.row_number().over(in_slice) - 1,
            **{f"prev_{c}": F.lag(c).over(in_slice) for c in carry},
        }
    )
    first = F.col(name) == F.col("_offset")
    out = out.withColumns(
        {f"prev_{c}": F.when(first, F.col(f"_edge_{c}")).otherwise(F.col(f"prev_{c}")) for c in carry}
    ) if carry else out
    drop = ["_offset", *[f"_edge_{c}" for c in carry]]
    return out.drop(*drop, *([] if keep_slice else [SLICE]))


def row_counts(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows per series."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def running(
    df: DataFrame, by: Sequence[str], slices: Sequence[str], order: Sequence[str],
    values: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Running ``sum``, ``max``, ``min``, ``first`` or ``last`` (non-null) along each key.

    ``values`` maps an output column to (function, source).  ``slices`` are columns that sort
    before ``order`` and cut each key into parts; parts are reduced first, so no task holds a
    whole key.
    """
    keys = [*by, *slices]
    reduce = {
        "sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "min": lambda c: F.min(c),
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))),
    }
    over = {
        "sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w),
        "min": lambda c, w: F.min(c).over(w),
        "first": lambda c, w: F.first(c, ignorenulls=True).over(w),
        "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
    }
    combine = {
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": F.greatest, "min": F.least,
        "first": lambda a, b: F.coalesce(a, b), "last": lambda a, b: F.coalesce(b, a),
    }
    before = Window.partitionBy(*by).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys).agg(*[reduce[f](c).alias(f"_p_{o}") for o, (f, c) in values.items()])
    carried = parts.select(
        *keys, *[over[f](f"_p_{o}", before).alias(f"_c_{o}") for o, (f, _) in values.items()]
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carried, keys).withColumns(
        {o: combine[f](F.col(f"_c_{o}"), over[f](c, inside)) for o, (f, c) in values.items()}
    )
    return out.drop(*[f"_c_{o}" for o in values])


def mass_slices(df: DataFrame, by: Sequence[str], col: str, width: int = 64) -> DataFrame:
    """Add ``SLICE``, rising with ``col``: up to ``width ** 2`` parts per key with about equally many rows each.

    The cuts are sketched percentiles, so values crowded together are still spread over all parts; equal values
    share one.  A row's part is found in two steps of ``width`` comparisons.  NULL has no part.
    """
    points = width * width
    cuts = F.percentile_approx(col, [(k + 1) / points for k in range(points)], 10 * points).alias("_cuts")
    per_key = df.groupBy(*by).agg(cuts).withColumn(
        "_coarse", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.element_at("_cuts", k * width))
    )
    rows = with_key_row(df, per_key, by, [col])
    v = F.col(col)
    rows = rows.withColumn("_at", F.least(F.size(F.filter("_coarse", lambda b: b < v)), F.lit(width - 1)))
    inside = F.slice("_cuts", F.col("_at") * width + 1, width)
    part = (F.col("_at") * width + F.size(F.filter(inside, lambda b: b < v))).cast("long")
    return rows.withColumn(SLICE, F.when(v.isNotNull(), part)).drop("_cuts", "_coarse", "_at")


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per (key, q).

    Equal values are counted first.  The distinct values are cut into parts of similar size at
    sketched percentiles, numbered by running counts, and the two neighbours of each position
    are picked; no task holds all values of a key.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    parts = mass_slices(counts, by, "_v")
    ranked = with_key_row(running(parts, by, [SLICE], ["_v"], {"_upto": ("sum", "_n")}), totals, by, ["_v"])
    wanted = ranked.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    pos = (F.col("_total") - 1) * F.col("q")
    low, start = F.floor(pos), F.col("_upto") - F.col("_n")

    def holds(rank: Column) -> Column:
        return (rank >= start) & (rank < F.col("_upto"))

    hit = wanted.filter(holds(low) | holds(low + 1))
    picked = hit.groupBy(*by, "q").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(low + 1), F.col("_v"))).alias("_hi"),
        F.max(pos - low).alias("_f"),
    )
    value = F.col("_lo") + F.col("_f") * (F.coalesce("_hi", "_lo") - F.col("_lo"))
    return picked.select(*by, "q", value.alias("value"))
