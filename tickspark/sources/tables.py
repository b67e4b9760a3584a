"""Writing and reading result tables, fact tables and runtime history."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Codecs of the Parquet conversion and names of the fact tables.
CODECS = ("snappy", "gzip", "zstd", "none")
FACT_TABLES = ("raw_ticks", "bars", "inference_decisions", "orders", "fills", "positions_state")


def convert(src: DataFrame, dst: str, compression: str = "snappy") -> DataFrame:
    """Write Parquet with the given codec and report rows and bytes per codec."""
    if compression not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    spark = src.sparkSession
    src.write.mode("overwrite").option("compression", compression).parquet(dst)
    return size_report(spark, dst).withColumn("compression", F.lit(compression))


def size_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes of a written table, from file metadata and row counts."""
    per_file = (
        spark.read.parquet(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    )
    return per_file.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"))


def save_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> None:
    """Save results, labels or features."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def tick_facts(ticks: DataFrame) -> DataFrame:
    """Rows of the raw tick table: mid and spread are 0 when a side is missing."""
    both = (F.col("bid") > 0) & (F.col("ask") > 0)
    return ticks.select(
        F.col("ts").alias("time"), "symbol", "bid", "ask",
        F.when(both, (F.col("bid") + F.col("ask")) / 2).otherwise(F.lit(0.0)).alias("mid"),
        F.when(both, F.col("ask") - F.col("bid")).otherwise(F.lit(0.0)).alias("spread"),
        F.col("last_volume").alias("volume"),
    )


def bar_facts(bars: DataFrame) -> DataFrame:
    """Rows of the bar fact table."""
    return bars.select(
        F.col("open_time").alias("time"), F.col("close_time").alias("time_close"), "symbol",
        "bar_idx", "open", "high", "low", "close", "tick_count", "duration_ms",
        (F.col("spread_sum") / F.greatest(F.col("tick_count"), F.lit(1))).alias("spread_avg"),
        "imbalance", "imbalance_ratio", "buy_count", "sell_count", "neutral_count",
    )


def append_facts(rows: DataFrame, root: str, table: str) -> None:
    """Append rows with a ``time`` column to one fact table, partitioned by symbol and date."""
    if table not in FACT_TABLES:
        raise ValueError(f"unknown fact table {table}")
    dated = rows.withColumn("date", F.to_date("time"))
    dated.write.mode("append").partitionBy("symbol", "date").parquet(f"{root}/{table}")


def write_facts(
    stream: DataFrame, root: str, checkpoint: str,
    tables: Mapping[str, Callable[[DataFrame], DataFrame]],
    enabled: Mapping[str, bool] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Fan one stream out to several fact tables in each micro-batch.

    ``tables`` maps a fact table to the projection that builds its rows.  The batch number is
    part of the folder name and a batch overwrites its own folder, so a repeated batch does not
    add rows twice.
    """
    enabled = enabled or {}

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for table, build in tables.items():
            if enabled.get(table, True):
                rows = build(batch).withColumn("date", F.to_date("time"))
                target = f"{root}/{table}/batch={batch_id}"
                rows.write.mode("overwrite").partitionBy("symbol", "date").parquet(target)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_runtime(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append runtime snapshots as they arrive."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


#: Most rows of a page of the runtime history.
MAX_PAGE = 5000


def runtime_history(df: DataFrame, limit: int = 200, offset: int = 0, time: str = "time") -> DataFrame:
    """Newest rows first, one page of 1 to 5000 rows; other limits and negative offsets are errors."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE} and offset 0 or more, not {limit} and {offset}")
    tie = [F.col(c).desc() for c in df.columns if c != time][:1]
    return df.orderBy(F.col(time).desc(), *tie).offset(offset).limit(limit)


def migrate_epoch(df: DataFrame, old: str = "ts", new: str = "time") -> DataFrame:
    """Replace an epoch-seconds column by a timestamp column, keeping times already migrated."""
    converted = F.timestamp_micros(F.round(F.col(old).cast("double") * 1e6).cast("long"))
    value = F.coalesce(F.col(new).cast("timestamp"), converted) if new in df.columns else converted
    return df.withColumn(new, value).drop(old)
