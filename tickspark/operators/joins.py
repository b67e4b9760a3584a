"""Joins of events, bars, features and positions, always on equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("symbol", "bar_idx")


def features_at(events: DataFrame, features: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Feature row of each event."""
    return events.join(features, list(on))


def event_window(
    events: DataFrame, bars: DataFrame, first: int, last: int, left: bool = False,
    on: str = "bar_idx", by: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Each event with the bars ``first`` .. ``last`` rows after it (``offset``, ``other_idx``).

    The offsets are expanded first and joined on the exact bar index, so the work is
    events x window length and every join key is distinct.
    """
    offsets = F.explode(F.sequence(F.lit(first), F.lit(last)))
    wide = events.withColumn("offset", offsets).withColumn(
        "other_idx", F.col(on) + F.col("offset")
    )
    taken = set(events.columns) - set(by)
    other = bars.select(
        *by, F.col(on).alias("other_idx"),
        *[F.col(c).alias(f"other_{c}" if c in taken else c) for c in bars.columns if c not in (*by, on)],
    )
    return wide.join(other, [*by, "other_idx"], "left" if left else "inner")


def with_key_row(
    df: DataFrame, per_key: DataFrame, by: Sequence[str], deal: Sequence[str], how: str = "inner", places: int = 64,
) -> DataFrame:
    """Join a table of one row per key (its statistics) so that a key with most of the rows uses many tasks.

    The small table is repeated for ``places`` places, to which rows are dealt by the hash of the ``deal`` columns.
    Without ``by`` it is one row.  Rows whose key is null or has no partner go, unless ``how`` is ``left``.
    """
    if not by:
        return df.crossJoin(F.broadcast(per_key))
    copies = per_key.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    dealt = df.withColumn("_place", F.pmod(F.xxhash64(*deal), F.lit(places)).cast("int"))
    return dealt.join(copies, [*by, "_place"], how).drop("_place")


def missing_keys(part: DataFrame, whole: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``part`` without a partner in ``whole``."""
    return part.join(whole.select(*on).distinct(), list(on), "left_anti")


def assert_subset(part: DataFrame, whole: DataFrame, on: Sequence[str] = KEY) -> None:
    """Raise when ``part`` has keys that ``whole`` lacks."""
    lost = missing_keys(part, whole, on).limit(1).collect()
    if lost:
        raise ValueError(f"keys outside the reference set, e.g. {lost[0].asDict()}")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a one-row table of aggregates to every row."""
    return df.crossJoin(F.broadcast(scalars))


def with_features(base: DataFrame, blocks: Sequence[DataFrame], on: Sequence[str] = KEY) -> DataFrame:
    """Put feature tables side by side."""
    out = base
    for block in blocks:
        out = out.join(block, list(on))
    return out


#: Ticks in one block of the join of positions with ticks.
LIFE_BLOCK = 4096
#: Tasks of that join.  Its inputs are small beside its rows, so their bytes say nothing of the work.
LIFE_TASKS = 192


def positions_on_ticks(
    positions: DataFrame, ticks: DataFrame, start: str = "start_row", close: str = "close_row", best: bool = False,
) -> DataFrame:
    """Each position with the ticks after its opening row up to its closing row.

    A position without a closing row is open until the series ends.  Positions are laid out on the
    tick blocks of their life and joined by (symbol, block), so neither a long life nor a symbol with
    most ticks meets in one task; the output holds what was asked for and nothing else.  Rows come out tick by tick,
    the positions of a block in the same order at each, so what is written of them repeats and takes less room.

    ``best`` adds ``best_price``, the highest bid since the opening for longs (``direction`` 1) and the lowest ask
    for others.  It needs a ``ticket`` that names a position of its symbol and ticks without gaps in ``row_idx``.
    In the block of its opening a position walks its ticks; later ones start from the best price carried
    into the block and the extremes of the block so far, so the joined rows are neither moved nor sorted.
    """
    def block(row: Column) -> Column:
        return F.floor(row / LIFE_BLOCK).cast("long")

    last = ticks.groupBy("symbol").agg(F.max("row_idx").alias("_last"))
    lives = positions.join(last, "symbol").withColumn(
        "_until", F.least(F.coalesce(close, F.col("_last")), F.col("_last"))
    ).where(F.col("_until") > F.col(start)).drop("_last")
    opened = block(F.col(start) + 1)
    quotes = ticks.select("symbol", "row_idx", "ts", "bid", "ask", block(F.col("row_idx")).alias("_block"))

    quotes = quotes.repartition(LIFE_TASKS, "symbol", "_block")

    def met(laid: DataFrame, rows: DataFrame, by_tick: bool = True) -> DataFrame:
        laid, on = laid.repartition(LIFE_TASKS, "symbol", "_block"), ["symbol", "_block"]
        pairs = rows.join(laid.hint("merge"), on) if by_tick else laid.join(rows.hint("merge"), on)
        columns = [*on, *[c for c in (*laid.columns, *rows.columns) if c not in on]]
        return pairs.where((F.col("row_idx") > F.col(start)) & (F.col("row_idx") <= F.col("_until"))).select(*columns)

    if not best:
        laid = lives.withColumn("_block", F.explode(F.sequence(opened, block(F.col("_until")))))
        return met(laid, quotes).drop("_block", "_until")

    is_long = F.col("direction") == 1
    walk = Window.partitionBy("symbol", "_block", "ticket").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    # The walk sorts by position, so here each position meets its ticks in turn.
    first = met(lives.withColumn("_block", opened), quotes, by_tick=False).withColumn(
        "best_price", F.when(is_long, F.max("bid").over(walk)).otherwise(F.min("ask").over(walk))
    )

    inside = Window.partitionBy("symbol", "_block").orderBy("row_idx")
    so_far, on = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    rest = quotes.select(
        "symbol", F.col("row_idx").alias("_next"), F.max("bid").over(on).alias("_high"), F.min("ask").over(on).alias("_low"),
    )
    ends = quotes.groupBy("symbol", "_block").agg(F.max("bid").alias("_high"), F.min("ask").alias("_low"))
    longer = lives.where(block(F.col("_until")) > opened)
    # The best price of each block of a life: from the opening to the end of the first one, then whole blocks.
    head = longer.select("symbol", "ticket", "direction", (F.col(start) + 1).alias("_next")).join(rest, ["symbol", "_next"]).select(
        "symbol", "ticket", "direction", block(F.col("_next")).alias("_block"), "_high", "_low",
    )
    whole = longer.select(
        "symbol", "ticket", "direction", F.explode(F.sequence(opened + 1, block(F.col("_until")))).alias("_block")
    ).join(ends, ["symbol", "_block"]).select(*head.columns)
    before = Window.partitionBy("symbol", "ticket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = head.unionByName(whole).select(
        "symbol", "ticket", "_block",
        F.when(is_long, F.max("_high").over(before)).otherwise(F.min("_low").over(before)).alias("_carried"),
    )
    laid = longer.withColumn("_block", F.explode(F.sequence(opened + 1, block(F.col("_until"))))).join(
        carried, ["symbol", "ticket", "_block"]
    )
    extremes = quotes.withColumns({"_high": F.max("bid").over(so_far), "_low": F.min("ask").over(so_far)})
    later = met(laid, extremes).withColumn(
        "best_price", F.when(is_long, F.greatest("_carried", "_high")).otherwise(F.least("_carried", "_low"))
    )
    return first.unionByName(later.drop("_carried", "_high", "_low")).drop("_block", "_until")
