"""Registry of queries and the shared SQL building blocks of their checks.

A query declares its result columns as ``name:kind`` with kinds ``s`` string, ``i`` long,
``f`` double rounded to 6 digits, ``t`` timestamp as microseconds since 1970, ``b`` boolean.
The same list shapes the Spark result and the SQL result, so both sides agree on names and types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.session import configure

DIGITS = 6
REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    columns: list[tuple[str, str]]
    sql: str | None


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _spark_column(name: str, kind: str):
    col = F.col(name)
    shaped = {
        "s": lambda: col.cast("string"),
        "i": lambda: col.cast("long"),
        "f": lambda: F.round(col.cast("double"), DIGITS) + F.lit(0.0),
        "t": lambda: F.unix_micros(col.cast("timestamp")),
        "b": lambda: col.cast("boolean"),
    }[kind]()
    return shaped.alias(name)


def _sql_column(name: str, kind: str) -> str:
    shaped = {
        "s": f"cast({name} as varchar)",
        "i": f"cast({name} as bigint)",
        "f": f"round(cast({name} as double), {DIGITS}) + 0.0",
        "t": f"epoch_us({name})",
        "b": f"cast({name} as boolean)",
    }[kind]
    return f"{shaped} as {name}"


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the body of the check."""

    def decorate(fn):
        cols = _columns(columns)

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir).select(*[_spark_column(*c) for c in cols])

        text = None
        if sql is not None:
            text = f"select {', '.join(_sql_column(*c) for c in cols)} from (\n{sql.strip()}\n) as q"
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(build, cols, text)
        return fn

    return decorate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- ticks

def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes derived from ``events``: one symbol per event type."""
    e = table(spark, sf_dir, "events")
    half = (F.lit(1) + F.col("event_id") % 5) * F.lit(0.005)
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.round(F.lit(1000) + F.col("value") - half, 4).alias("bid"),
        F.round(F.lit(1000) + F.col("value") + half, 4).alias("ask"),
        (F.lit(1) + F.col("user_id") % 7).cast("double").alias("last_volume"),
    )


TICKS = """ticks as (
  select event_type as symbol, ts, event_id as seq,
         round(1000 + value - (1 + event_id % 5) * 0.005, 4) as bid,
         round(1000 + value + (1 + event_id % 5) * 0.005, 4) as ask,
         cast(1 + user_id % 7 as double) as last_volume
  from events)"""


def dirty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quotes with faults planted by ``event_id``."""
    kind = F.col("seq") % 97
    t = ticks(spark, sf_dir)
    bid, ask, ts = F.col("bid"), F.col("ask"), F.col("ts")
    return t.select(
        "symbol",
        F.when(kind == 3, F.lit(None)).when(kind == 4, ts - F.expr("interval 5 minutes"))
        .otherwise(ts).alias("ts"),
        "seq",
        F.when(kind == 0, F.lit(0.0)).when(kind == 2, bid * 3).otherwise(bid).alias("bid"),
        F.when(kind == 1, bid - 0.01).when(kind == 2, ask * 3).otherwise(ask).alias("ask"),
        F.when(kind == 5, F.lit(0.0)).otherwise(F.col("last_volume")).alias("last_volume"),
    )


DIRTY = TICKS + """, dirty as (
  select symbol,
         case when seq % 97 = 3 then null when seq % 97 = 4 then ts - interval 5 minutes else ts end as ts,
         seq,
         case when seq % 97 = 0 then 0.0 when seq % 97 = 2 then bid * 3 else bid end as bid,
         case when seq % 97 = 1 then bid - 0.01 when seq % 97 = 2 then ask * 3 else ask end as ask,
         case when seq % 97 = 5 then 0.0 else last_volume end as last_volume
  from ticks)"""


# ---------------------------------------------------------------- bars

BAR_TICKS = 20      #: ticks per bar for the price and flow queries
GAP_BAR_TICKS = 2   #: short bars, so three-bar gaps occur in this data


def bars_sql(n: int = BAR_TICKS, name: str = "bars") -> str:
    """CTEs for ``n``-tick bars, to follow :data:`TICKS`."""
    return f"""q_{name} as (
  select symbol, ts, seq, (bid + ask) / 2 as mid, ask - bid as spread, last_volume as volume,
         row_number() over (partition by symbol order by ts, seq) - 1 as row_idx
  from ticks where bid > 0 and ask > 0),
d_{name} as (
  select *, row_idx // {n} as bar_idx,
         mid - lag(mid) over (partition by symbol, row_idx // {n} order by row_idx) as step
  from q_{name}),
a_{name} as (
  select symbol, bar_idx, min(ts) as open_time, max(ts) as close_time,
         arg_min(mid, row_idx) as open, max(mid) as high, min(mid) as low,
         arg_max(mid, row_idx) as close, count(*) as tick_count, sum(volume) as volume,
         sum(spread) as spread_sum,
         count(*) filter (where step > 0) as buy_count,
         count(*) filter (where step < 0) as sell_count
  from d_{name} group by symbol, bar_idx having count(*) = {n}),
{name} as (
  select *, buy_count - sell_count as imbalance,
         (buy_count - sell_count) / greatest(1, buy_count + sell_count) as imbalance_ratio,
         tick_count - buy_count - sell_count as neutral_count,
         (epoch_us(close_time) - epoch_us(open_time)) / 1000.0 as duration_ms
  from a_{name})"""


BARS = f"{TICKS}, {bars_sql()}"
GAP_BARS = f"{TICKS}, {bars_sql(GAP_BAR_TICKS)}"


def bars(spark: SparkSession, sf_dir: str, n: int = BAR_TICKS) -> DataFrame:
    from tickspark.operators.bars import tick_bars

    return tick_bars(ticks(spark, sf_dir), n)


def gap_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, GAP_BAR_TICKS)
