"""Running a stream to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickspark.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB, so it may exceed executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is available, append it to a table in the shared folder and read that back."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
