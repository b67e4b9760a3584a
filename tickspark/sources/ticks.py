"""Reading and writing ticks, bars and other tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.functions.timeparse import parse_ts

# Column names accepted for each tick field, first match wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "ts": ("timestamp_us", "time_msc", "timestamp", "Time (EET)", "Time", "time", "ts"),
    "bid": ("bid", "Bid"),
    "ask": ("ask", "Ask"),
    "bid_volume": ("BidVolume", "bidvolume", "bid_volume"),
    "ask_volume": ("AskVolume", "askvolume", "ask_volume"),
    "last": ("last", "Last"),
    "last_volume": ("volume", "Volume", "last_volume"),
    "flags": ("flags", "Flags"),
}

# Flag bits of a tick.
FLAG_BUY = 16
FLAG_SELL = 32

OHLC_SCHEMA = T.StructType(
    [
        T.StructField("time", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("tick_volume", T.LongType()),
        T.StructField("spread", T.DoubleType()),
        T.StructField("real_volume", T.DoubleType()),
    ]
)

TICK_FILE_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("last_volume", T.DoubleType()),
    ]
)


def _format_of(path: str) -> str:
    return "csv" if path.rstrip("/").endswith((".csv", ".csv.gz", ".txt")) else "parquet"


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Rows as stored.  CSV keeps every column as text, so bad fields cannot fail the read."""
    fmt = fmt or _format_of(path)
    if fmt == "csv":
        return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.read.format(fmt).load(path)


def normalize_ticks(
    raw: DataFrame, symbol: str | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES
) -> DataFrame:
    """Rename known columns, parse the time and cast prices; rows without time, bid or ask go."""
    found = {
        field: next((n for n in names if n in raw.columns), None) for field, names in aliases.items()
    }
    missing = [f for f in ("ts", "bid", "ask") if found[f] is None]
    if missing:
        raise ValueError(f"no column for {missing} among {raw.columns}")
    source = found["ts"]
    kind = raw.schema[source].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        ts = F.col(source).cast("timestamp")
    elif source == "timestamp_us":
        ts = F.timestamp_micros(F.col(source).cast("long"))
    else:
        ts = parse_ts(F.col(source))
    columns = [ts.alias("ts")]
    if "symbol" in raw.columns and symbol is None:
        columns.insert(0, F.col("symbol"))
    else:
        columns.insert(0, F.lit(symbol or "UNKNOWN").alias("symbol"))
    if "seq" in raw.columns:
        columns.append(F.col("seq").cast("long"))
    for field in ("bid", "ask", "bid_volume", "ask_volume", "last", "last_volume"):
        if found[field] is not None:
            columns.append(F.expr(f"try_cast(`{found[field]}` as double)").alias(field))
    if found["flags"] is not None:
        columns.append(F.expr(f"try_cast(`{found['flags']}` as int)").alias("flags"))
    return raw.select(*columns).filter(
        F.col("ts").isNotNull() & F.col("bid").isNotNull() & F.col("ask").isNotNull()
    )


def read_ticks(
    spark: SparkSession, path: str, symbol: str | None = None, fmt: str | None = None,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
) -> DataFrame:
    """Tick file or folder to normalized ticks."""
    return normalize_ticks(read_raw(spark, path, fmt), symbol, aliases)


def detect_columns(df: DataFrame) -> dict[str, str | None]:
    """Which columns hold time, bid, ask and volumes, judged by name only."""
    found: dict[str, str | None] = dict.fromkeys(
        ("time", "bid", "ask", "bid_volume", "ask_volume")
    )
    for name in df.columns:
        low = name.lower()
        is_volume = "vol" in low
        if ("time" in low or "date" in low) and found["time"] is None:
            found["time"] = name
        elif "bid" in low:
            found["bid_volume" if is_volume else "bid"] = name
        elif "ask" in low:
            found["ask_volume" if is_volume else "ask"] = name
    return found


def with_flag_columns(ticks: DataFrame) -> DataFrame:
    """Buy and sell bits of the flags column."""
    flags = F.col("flags")
    return ticks.withColumns(
        {
            "is_buy": flags.bitwiseAND(FLAG_BUY) != 0,
            "is_sell": flags.bitwiseAND(FLAG_SELL) != 0,
        }
    )


def last_days(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before the newest row (one-row broadcast)."""
    newest = df.agg(F.max(ts).alias("_newest"))
    joined = df.crossJoin(F.broadcast(newest))
    return joined.filter(
        F.col(ts) >= F.col("_newest") - F.expr(f"interval {int(days)} days")
    ).drop("_newest")


def head(df: DataFrame, n: int, order=("ts", "seq")) -> DataFrame:
    """The first ``n`` rows in time order, a top-k without a full sort."""
    return df.orderBy(*order).limit(n)


def most_recent(df: DataFrame, n: int, order=("ts", "seq")) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def finalize_ticks(df: DataFrame) -> DataFrame:
    """Columns of the prepared tick file; volumes stay optional and become lower-case doubles."""
    volumes = [c for c in df.columns if c.lower().replace("_", "") in ("bidvolume", "askvolume")]
    return df.select(
        F.unix_micros("ts").alias("timestamp_us"), "bid", "ask", "mid", "spread",
        *[F.col(c).cast("double").alias(c.lower().replace("_", "")) for c in volumes],
    )


def read_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """OHLC history from CSV with a fixed schema."""
    raw = spark.read.option("header", True).schema(OHLC_SCHEMA).csv(path)
    return raw.withColumns({"symbol": F.lit(symbol), "open_time": parse_ts(F.col("time"))}).drop("time")


def stream_ticks(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, fmt: str = "parquet",
    schema: T.StructType = TICK_FILE_SCHEMA,
) -> DataFrame:
    """Ticks arriving as files.  ``max_files_per_trigger`` bounds the intake of one batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_ticks_kafka(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int | None = None
) -> DataFrame:
    """Ticks as JSON messages; needs the Kafka package on the cluster."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    body = F.from_json(F.col("value").cast("string"), TICK_FILE_SCHEMA)
    return reader.load().select(body.alias("t")).select("t.*")
