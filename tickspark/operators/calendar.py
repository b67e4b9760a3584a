"""Calendar and trading-session features, all in UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.layout import BARS, Layout, windowed
from tickspark.operators.scan import LastKnown, last_known

# Sessions by code, and the hours (UTC) of the three markets.
SESSIONS = ("Asia", "London", "NewYork", "Overlap", "Closed")
MARKET_HOURS = {"Asia": (0, 8), "London": (8, 16), "NewYork": (13, 21)}
CLOSED = 4


def calendar(df: DataFrame, ts: str = "open_time", tz: str | None = None) -> DataFrame:
    """Hour, minute and weekday (Monday 0); ``tz`` names the zone of a local ``ts``."""
    time = F.to_utc_timestamp(F.col(ts), tz) if tz else F.col(ts)
    return df.withColumns(
        {
            "hour_of_day": F.hour(time), "minute_of_hour": F.minute(time),
            "day_of_week": F.weekday(time),
        }
    )


def cyclic_hour(df: DataFrame) -> DataFrame:
    """Sine and cosine of the time of day."""
    angle = (F.col("hour_of_day") + F.col("minute_of_hour") / 60) / 24 * (2 * math.pi)
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def _in_market(hour: Column, market: str) -> Column:
    start, end = MARKET_HOURS[market]
    return (hour >= start) & (hour < end)


def session(df: DataFrame) -> DataFrame:
    """Session code; New York wins over London, both together are the overlap."""
    h = F.col("hour_of_day")
    code = (
        F.when(_in_market(h, "NewYork") & _in_market(h, "London"), 3)
        .when(_in_market(h, "NewYork"), 2).when(_in_market(h, "London"), 1)
        .when(_in_market(h, "Asia"), 0).otherwise(CLOSED)
    )
    return df.withColumn("session", code)


def session_name(df: DataFrame) -> DataFrame:
    names = F.coalesce(*[F.when(F.col("session") == k, F.lit(n)) for k, n in enumerate(SESSIONS)])
    return df.withColumn("session_name", F.coalesce(names, F.lit("Unknown")))


def session_edges(df: DataFrame, minutes: int = 30, ts: str = "open_time") -> DataFrame:
    """Within ``minutes`` after an opening or before a closing of any market."""
    micros = F.unix_micros(F.col(ts)) % F.lit(86_400_000_000)
    hour, span = 3_600_000_000, minutes * 60_000_000
    opening = closing = F.lit(False)
    for start, end in MARKET_HOURS.values():
        s, e = start * hour, end * hour
        opening = opening | ((micros >= s) & (micros < s + span))
        closing = closing | ((micros >= e - span) & (micros < e))
    return df.withColumns(
        {"is_session_open": opening.cast("int"), "is_session_close": closing.cast("int")}
    )


@windowed(lookback=1)
def session_starts(df: DataFrame, w, idx: str = "bar_idx") -> DataFrame:
    """Index of rows on which another session than Closed begins."""
    before = F.coalesce(F.lag("session").over(w), F.lit(CLOSED))
    begins = (F.col("session") != before) & (F.col("session") != CLOSED)
    return df.withColumn("_session_start", F.when(begins, F.col(idx)))


def session_stage() -> LastKnown:
    return LastKnown({"_session_start": "_since"})


def session_age(df: DataFrame, idx: str = "bar_idx") -> DataFrame:
    """Rows since the last session start, or since the series start before any."""
    age = F.col(idx) - F.coalesce(F.col("_since"), F.lit(0.0))
    return df.withColumn("bars_from_session_open", age.cast("long")).drop("_session_start", "_since")


def bars_from_session_open(df: DataFrame, layout: Layout = BARS) -> DataFrame:
    """Needs the ``session`` column."""
    marked = session_starts(df, idx=layout.idx, layout=layout)
    return session_age(last_known(marked, {"_session_start": "_since"}, layout), layout.idx)


def interactions(df: DataFrame, suffix: str = "_15m", vol: str = "micro_volatility_pct") -> DataFrame:
    """Products of trend, gap, volatility and session columns."""
    trend, dist = F.col(f"st_trend{suffix}"), F.col(f"st_distance{suffix}")
    return df.withColumns(
        {
            "trend_fvg_alignment": trend * (F.col("bullish_fvg") - F.col("bearish_fvg")),
            "trend_strength_x_fvg": F.abs(dist) * F.col("fvg_size_atr"),
            "trend_duration_x_vol": F.col(f"st_bars_since_flip{suffix}") * F.col(vol),
            "trend_fvg_distance": dist * F.col("price_to_fvg_mid"),
            "session_trend_interaction": F.col("session") * trend,
        }
    )
