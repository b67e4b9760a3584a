"""Fair-value gaps (three-bar patterns) and market structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.layout import BARS, Layout, windowed
from tickspark.operators.scan import (
    Cooldown, FollowThrough, LastKnown, Walk, block_scan, last_known, walk_blocks,
)
from tickspark.operators.touch import first_touch

EPSILON = 1e-10


@windowed(lookback=2)
def detect_fvg(df: DataFrame, w, min_bps: float = 0.0) -> DataFrame:
    """Gap between the bar two back and this bar, on the row where it becomes known.

    ``fvg_type`` is 1 for a gap up, -1 for a gap down, 0 for none; size in bps of the middle
    bar's mid price must reach ``min_bps``.
    """
    high2, low2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    middle = (F.lag("high", 1).over(w) + F.lag("low", 1).over(w)) / 2
    found = df.withColumns({"_high2": high2, "_low2": low2, "_middle": middle})
    kind = (
        F.when(F.col("_high2") < F.col("low"), 1).when(F.col("_low2") > F.col("high"), -1).otherwise(0)
    )
    up = F.col("fvg_type") == 1
    sized = found.withColumn("fvg_type", kind).withColumns(
        {
            "gap_top": F.when(up, F.col("low")).when(F.col("fvg_type") == -1, F.col("_low2")),
            "gap_bottom": F.when(up, F.col("_high2")).when(F.col("fvg_type") == -1, F.col("high")),
        }
    )
    sized = sized.withColumn("gap_size", F.col("gap_top") - F.col("gap_bottom"))
    sized = sized.withColumn("gap_size_bps", F.try_divide(F.col("gap_size"), F.col("_middle")) * 1e4)
    keep = F.col("gap_size_bps") >= min_bps
    named = ("gap_top", "gap_bottom", "gap_size")
    return sized.withColumns(
        {
            **{c: F.when(keep, F.col(c)) for c in named},
            "fvg_type": F.when(keep, F.col("fvg_type")).otherwise(0),
            "gap_size_bps": F.when(keep, F.col("gap_size_bps")),
        }
    ).drop("_high2", "_low2", "_middle")


def gap_zones(detected: DataFrame) -> DataFrame:
    """One row per gap."""
    return detected.filter(F.col("fvg_type") != 0).select(
        "symbol", F.col("bar_idx").alias("gap_idx"), F.col("fvg_type"), "gap_top", "gap_bottom",
        ((F.col("gap_top") + F.col("gap_bottom")) / 2).alias("gap_mid"), "gap_size_bps",
    )


def fvg_fill(detected: DataFrame, max_age: int | None = 100) -> DataFrame:
    """Per gap the first bar that passes its midpoint, the first that fills it, and its end.

    Only the ``max_age - 1`` bars after a gap count.  With None they all do; a gap that is never filled is then
    ``OPEN`` and has no end.  Gaps find their bars over a tree of block extremes (:func:`first_touch`).
    """
    if max_age is not None and max_age < 1:
        raise ValueError("max_age must be at least 1")
    zones = gap_zones(detected)
    far = F.when(F.col("fvg_type") == 1, F.col("gap_bottom")).otherwise(F.col("gap_top"))
    goals = zones.withColumn(
        "_goal",
        F.explode(F.array(
            F.struct(F.lit("mid").alias("kind"), F.col("gap_mid").alias("level")),
            F.struct(F.lit("far").alias("kind"), far.alias("level")),
        )),
    ).select("*", F.col("_goal.kind").alias("_kind"), F.col("_goal.level").alias("_level")).drop("_goal")
    touched = first_touch(
        goals, detected, side="fvg_type", level="_level", name="_touch",
        max_age=None if max_age is None else max_age - 1,
    )
    keys = ["symbol", "gap_idx", "fvg_type", "gap_top", "gap_bottom", "gap_mid", "gap_size_bps"]
    out = touched.groupBy(*keys).agg(
        F.min(F.when(F.col("_kind") == "mid", F.col("_touch"))).alias("partial_idx"),
        F.min(F.when(F.col("_kind") == "far", F.col("_touch"))).alias("fill_idx"),
    )
    last = F.lit(None).cast("long") if max_age is None else F.col("gap_idx") + max_age
    return out.withColumns(
        {
            "end_idx": F.coalesce(F.col("fill_idx"), last),
            "end_reason": F.when(F.col("fill_idx").isNotNull(), F.lit("FILLED")).otherwise(
                F.lit("OPEN" if max_age is None else "EXPIRED")
            ),
        }
    )


ACTIVE_FIELDS = T.StructType(
    [
        T.StructField("bullish_fvg", T.IntegerType()),
        T.StructField("bearish_fvg", T.IntegerType()),
        T.StructField("active_fvg_count", T.IntegerType()),
        T.StructField("_size", T.DoubleType()),
        T.StructField("fvg_age_bars", T.LongType()),
        T.StructField("_mid", T.DoubleType()),
        T.StructField("fvg_filled_pct", T.DoubleType()),
        T.StructField("ce_bull_idx", T.LongType()),
        T.StructField("ce_bull_edge", T.DoubleType()),
        T.StructField("ce_bear_idx", T.LongType()),
        T.StructField("ce_bear_edge", T.DoubleType()),
        T.StructField("ce_bull_mid", T.DoubleType()),
        T.StructField("ce_bear_mid", T.DoubleType()),
    ]
)


def active_rows(
    pdf: pd.DataFrame, idx: str, max_age: int, max_active: int, ce_bps: float, alive: list[list],
) -> list[tuple]:
    """Walk consecutive rows keeping the gaps that are neither filled nor too old.

    ``alive`` holds the live gaps (side, top, bottom, middle, birth, filled part) before the rows and is
    left as they are after them.
    """
    columns = [idx, "high", "low", "close", "fvg_type", "gap_top", "gap_bottom"]
    out = []
    for i, high, low, close, kind, top, bottom in zip(*(pdf[c].tolist() for c in columns)):
        kept = []
        for gap in alive:
            side, g_top, g_bottom, mid, born, _ = gap
            if i - born >= max_age or (low <= g_bottom if side == 1 else high >= g_top):
                continue
            if (low <= mid) if side == 1 else (high >= mid):
                depth = (g_top - low) if side == 1 else (high - g_bottom)
                gap[5] = min(1.0, depth / (g_top - g_bottom))
            kept.append(gap)
        alive[:] = kept
        if kind:
            alive.append([kind, top, bottom, (top + bottom) / 2, i, 0.0])
        newest = alive[-max_active:]
        if not newest:
            out.append((0, 0, 0, np.nan, None, np.nan, np.nan, None, np.nan, None, np.nan, np.nan, np.nan))
            continue
        near = min(newest, key=lambda g: abs(close - g[3]))
        ce = {1: (None, np.nan, np.nan), -1: (None, np.nan, np.nan)}
        for gap in reversed(newest):
            if abs(close - gap[3]) / gap[3] * 1e4 <= ce_bps:
                ce[gap[0]] = (gap[4], gap[2] if gap[0] == 1 else gap[1], gap[3])
        sides = {g[0] for g in newest}
        out.append((
            int(1 in sides), int(-1 in sides), len(newest), near[1] - near[2], i - near[4], near[3], near[5],
            ce[1][0], ce[1][1], ce[-1][0], ce[-1][1], ce[1][2], ce[-1][2],
        ))
    return out


def fvg_state_features(
    detected: DataFrame, max_age: int = 100, max_active: int = 10, ce_bps: float = 5.0,
    layout: Layout = BARS,
) -> DataFrame:
    """State of the newest ``max_active`` gaps that are unfilled and younger than ``max_age``.

    A gap lives at most ``max_age`` bars, so a block that also sees the ``max_age`` rows before
    it knows every live gap: one pass, exact, no pairs are written out.  Needs :func:`detect_fvg`
    columns and ``atr``.  ``ce_*`` is the oldest live gap of a side whose midpoint lies within
    ``ce_bps`` of the close, with the edge that would protect an entry.
    """
    idx, names = layout.idx, ACTIVE_FIELDS.fieldNames()

    def fn(pdf: pd.DataFrame) -> dict:
        rows = pd.DataFrame(active_rows(pdf, idx, max_age, max_active, ce_bps, []), columns=names)
        whole = {c: rows[c].astype("Int64") for c in ("fvg_age_bars", "ce_bull_idx", "ce_bear_idx")}
        return {c: whole.get(c, rows[c]) for c in names}

    return active_columns(walk_blocks(detected, [Walk(fn, ACTIVE_FIELDS.fields, max_age)], layout))


def active_columns(walked: DataFrame) -> DataFrame:
    """Feature columns from the outputs of :func:`active_rows`; needs ``atr``."""
    unit = F.greatest(F.col("atr"), F.lit(EPSILON))
    offset = F.col("close") - F.col("_mid")
    return walked.withColumns(
        {
            "fvg_size_atr": F.col("_size") / unit,
            "price_to_fvg_mid": offset / unit,
            "nearest_fvg_distance": F.abs(offset) / unit,
        }
    ).drop("_size", "_mid")


def event_stages(cooldown_bars: int = 2, window: int = 3, idx: str = "bar_idx") -> list:
    """Block-scan stages for pulse events and their follow-through."""
    def candidate(rows):
        return {"_candidate": rows["fvg_type"] != 0}

    def event(rows):
        return {"_event": rows["fvg_type"].where(rows["_kept"], 0)}

    return [
        candidate, Cooldown("_candidate", "_kept", cooldown_bars + 1, idx), event,
        FollowThrough("_event", "close", idx, window, ["_ev_idx", "_ev_close", "_ev_up", "_ev_dn"]),
    ]


def event_columns(scanned: DataFrame) -> DataFrame:
    """Feature columns from the outputs of :func:`event_stages`; needs ``atr``; 0 where that is 0."""
    event = F.when(F.col("_kept"), F.col("fvg_type")).otherwise(0)

    def in_atr(move: Column) -> Column:
        return F.when(F.col("atr") == 0, move * 0).otherwise(F.try_divide(move, F.col("atr")))

    return scanned.withColumns(
        {
            "fvg_event": event,
            "fvg_impulse_atr": F.when(F.col("_kept"), in_atr(F.col("gap_size"))).otherwise(F.lit(0.0)),
            "fvg_follow_up_3": in_atr(F.col("_ev_up")),
            "fvg_follow_dn_3": in_atr(F.col("_ev_dn")),
            "fvg_follow_bars": (F.col("bar_idx") - F.col("_ev_idx")).cast("long"),
            "fvg_follow_net": in_atr(F.col("close") - F.col("_ev_close")),
        }
    ).drop("_kept", "_ev_idx", "_ev_close", "_ev_up", "_ev_dn")


def fvg_event(detected: DataFrame, cooldown_bars: int = 2, window: int = 3, layout: Layout = BARS) -> DataFrame:
    """Pulse events with cooldown, impulse, and what the price did since the last event."""
    stages = event_stages(cooldown_bars, window, layout.idx)
    return event_columns(block_scan(detected, *stages, layout=layout))


def fvg_location(df: DataFrame) -> DataFrame:
    """Distance of the close from the middle of the 15m range in units of that range."""
    unit = F.greatest(F.col("atr_15m"), F.lit(EPSILON))
    value = F.when(F.col("mid_15m_range") > 0, (F.col("close") - F.col("mid_15m_range")) / unit)
    return df.withColumn("fvg_location_15m", F.coalesce(value, F.lit(0.0)))


def st_alignment(df: DataFrame) -> DataFrame:
    return df.withColumn("st_alignment", F.col("st_trend_15m") * F.col("fvg_event"))


@windowed(lookback=1)
def event_anchors(df: DataFrame, w, event: str = "fvg_event") -> DataFrame:
    """Flag event rows and rising edges (event now, none on the row before)."""
    is_event = F.col(event) != 0
    before = F.coalesce(F.lag(event).over(w), F.lit(0))
    return df.withColumns({"is_anchor": is_event, "is_rising_edge": is_event & (before == 0)})


def anchor_audit(anchors: DataFrame, switch_at: float = 0.05) -> DataFrame:
    """Are events pulses?  Counts, their difference, and which kind of anchor to use."""
    out = anchors.groupBy("symbol").agg(
        F.count_if("is_anchor").alias("anchor_count"),
        F.count_if("is_rising_edge").alias("rising_edge_count"),
    )
    diff = F.when(
        F.col("anchor_count") > 0,
        F.abs(F.col("rising_edge_count") - F.col("anchor_count")) / F.col("anchor_count"),
    ).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "ratio_diff": diff, "is_pulse": diff < 0.01,
            "used": F.when(diff > switch_at, F.lit("rising_edge")).otherwise(F.lit("anchor")),
        }
    )


@windowed(lookback=lambda n=20: n)
def range_breaks(df: DataFrame, w, n: int = 20) -> DataFrame:
    """1 when the close leaves the range of the ``n`` bars before upwards, -1 downwards."""
    prior = w.rowsBetween(-n, -1)
    up = F.col("close") > F.max("high").over(prior)
    down = F.col("close") < F.min("low").over(prior)
    return df.withColumn("range_break", F.when(up, 1).when(down, -1))


def structure_columns(df: DataFrame) -> DataFrame:
    """BOS or CHOCH from ``range_break`` and the break before, and trend-line breaks."""
    b, before = F.col("range_break"), F.col("_break_before")
    changes = b.isNotNull() & (F.coalesce(before, F.lit(0.0)) == -b)
    choch = F.when(changes, b).otherwise(0)
    bos = F.when(b.isNotNull() & ~changes, b).otherwise(0)
    line_ok = F.col("st_line") > 0
    tl = (
        F.when(line_ok & (F.col("st_dir") == -1) & (F.col("close") > F.col("st_line")), 1)
        .when(line_ok & (F.col("st_dir") == 1) & (F.col("close") < F.col("st_line")), -1).otherwise(0)
    )
    return df.withColumns({"bos": bos, "choch": choch, "tl_break": tl}).withColumn(
        "structure_signal",
        F.when(F.col("choch") != 0, F.col("choch")).when(F.col("bos") != 0, F.col("bos"))
        .otherwise(F.col("tl_break")),
    ).drop("_break_before")


def structure_stage() -> LastKnown:
    return LastKnown({"range_break": "_break_before"}, before=True)


def structure_breaks(df: DataFrame, n: int = 20, layout: Layout = BARS) -> DataFrame:
    """Structure breaks of bars that carry the SuperTrend columns."""
    broken = range_breaks(df, n, layout=layout)
    return structure_columns(last_known(broken, {"range_break": "_break_before"}, layout, before=True))
