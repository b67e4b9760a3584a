"""Sources, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from catalog.base import ticks
from tests.conftest import SF, SMALL
from tests.util import assert_same, keyed
from tickspark.operators.bars import tick_bars
from tickspark.session import scratch_path
from tickspark.sources import tables
from tickspark.sources import ticks as src
from tickspark.streaming import bars as sbars
from tickspark.streaming.run import run_to_table


def test_bad_rows_are_dropped(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "Time (EET),Ask,Bid,AskVolume,BidVolume\n2025.01.08 01:00:01.141,10.5,10.4,1,2\n"
        "nonsense,10.5,10.4,1,2\n2025.01.08 01:00:02.000,abc,10.4,1,2\n2025.01.08 01:00:03.000,10.6,10.5,,\n"
    )
    rows = src.read_ticks(spark, str(path), symbol="X").orderBy("ts").collect()
    assert [r["ask"] for r in rows] == [10.5, 10.6]
    assert rows[0]["ts"].microsecond == 141_000 and rows[1]["bid_volume"] is None


def test_epoch_and_iso_times(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("time_msc,bid,ask,volume\n1736298001141,1,2,3\n")
    assert src.read_ticks(spark, str(path), symbol="X").first()["ts"].year == 2025
    with pytest.raises(ValueError):
        src.normalize_ticks(spark.createDataFrame([(1,)], "x int"))


def test_detect_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)], "Date string, Bid double, Ask double, BidVolume double, AskVolume double")
    assert src.detect_columns(df) == {
        "time": "Date", "bid": "Bid", "ask": "Ask", "bid_volume": "BidVolume", "ask_volume": "AskVolume"
    }


def test_flags(spark):
    rows = src.with_flag_columns(spark.createDataFrame([(16,), (32,), (48,), (2,)], "flags int")).collect()
    assert [(r["is_buy"], r["is_sell"]) for r in rows] == [(True, False), (False, True), (True, True), (False, False)]


def test_history_page_is_bounded(spark):
    df = spark.range(6000).select(F.timestamp_seconds("id").alias("time"), "id")
    assert tables.runtime_history(df, limit=5000).count() == 5000
    for bad in ({"limit": 5001}, {"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            tables.runtime_history(df, **bad)
    page = [r["id"] for r in tables.runtime_history(df, limit=3, offset=2).collect()]
    assert page == [5997, 5996, 5995]


def test_disabled_fact_table_is_not_written(spark):
    path, root = scratch_path(spark, "in"), scratch_path(spark, "facts")
    ticks(spark, SMALL).write.parquet(path)
    stream = src.stream_ticks(spark, path)
    builders = {"raw_ticks": tables.tick_facts, "fills": tables.tick_facts}
    for _ in range(2):  # the second run finds nothing new
        tables.write_facts(stream, root, f"{root}-c", builders, {"fills": False}).awaitTermination()
    assert not os.path.exists(f"{root}/fills")
    assert spark.read.parquet(f"{root}/raw_ticks").count() == ticks(spark, SMALL).count()
    with pytest.raises(ValueError):
        tables.append_facts(ticks(spark, SMALL), root, "unknown")


def test_codec_is_checked(spark):
    with pytest.raises(ValueError):
        tables.convert(spark.range(1), "/tmp/never", "lzma")


def test_delayed_ticks_are_put_in_order(spark):
    """Ticks arriving out of order within the delay give the bars of the ordered ticks."""
    path = scratch_path(spark, "shuffled")
    t = ticks(spark, SF)
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    arrival = F.unix_micros("ts") + (minute % 3) * 1_500_000_000  # up to 50 minutes late
    for k in range(4):
        low, high = F.lit(k * 8), F.lit(k * 8 + 8)
        day = F.dayofmonth(F.timestamp_micros(arrival.cast("long")))
        t.filter((day > low) & (day <= high)).coalesce(1).write.mode("append").parquet(path)
    stream = src.stream_ticks(spark, path, max_files_per_trigger=1)
    rows = run_to_table(sbars.stream_bars(stream, 20, delay_ms=7_200_000), "ordered")
    assert rows.filter(F.col("kind") == "late").count() == 0
    got = sbars.finished_bars(rows)
    n = got.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    expected = tick_bars(t, 20).join(n, "symbol").filter(F.col("bar_idx") <= F.col("last"))
    columns = ["open", "close", "high", "low", "buy_count", "spread_sum"]
    assert_same(keyed(got, columns), keyed(expected, columns))
    assert got.count() > 480


def test_late_ticks_go_to_the_side(spark):
    path = scratch_path(spark, "late")
    t = ticks(spark, SF).filter(F.col("symbol") == "view")
    cut = F.lit("2024-01-20").cast("timestamp")
    old = F.lit("2024-01-05").cast("timestamp")
    t.filter(F.col("ts") < cut).coalesce(1).write.parquet(path)
    again = t.filter((F.col("ts") >= cut) | (F.col("ts") < old))
    again.coalesce(1).write.mode("append").parquet(path)
    stream = src.stream_ticks(spark, path, max_files_per_trigger=1)
    late = sbars.late_ticks(run_to_table(sbars.stream_bars(stream, 20), "late-out"))
    assert late.count() == t.filter(F.col("ts") < old).count()
