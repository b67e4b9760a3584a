"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

from catalog.all import REGISTRY
from catalog.base import ticks
from tests.conftest import SF
from tickspark.operators import asof, clean, price
from tickspark.operators.bars import tick_bars, time_bars
from tickspark.layout import run_blocked
from tickspark.plans import training
from tickspark.plans.replay import run_signals


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_has_no_nested_loop(bar_rows):
    high = time_bars(bar_rows, 86_400)
    plan = plan_of(asof.asof_join(bar_rows, high, "open_time", "end_time", ["high"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    ticks(spark, SF).write.parquet(path)
    plan = plan_of(clean.valid_quotes(spark.read.parquet(path)).select("bid", "ask"))
    assert "GreaterThan(bid,0.0)" in plan
    assert re.search(r"ReadSchema: struct<bid:double,ask:double>", plan)


def test_windows_share_one_shuffle_and_sort(bar_rows):
    steps = [price.log_return.step(), price.rolling_zscore.step("log_return", 100), price.atr.step(14),
             price.temperature.step(50), price.direction_entropy.step(50)]
    plan = plan_of(run_blocked(bar_rows, steps)).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_windows_are_keyed_by_block(bar_rows):
    plan = plan_of(run_blocked(bar_rows, [price.rolling_zscore.step("close", 100)]))
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert "_block" in keys


def test_bars_never_group_ticks_by_symbol_alone(spark):
    plan = plan_of(tick_bars(ticks(spark, SF), 20))
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        names = re.findall(r"([a-z_]+)#", keys)
        small = names == ["symbol"]  # only the table of slice counts is ordered per symbol
        assert small or {"_slice"} & set(names) or {"bar_idx"} & set(names), keys
    assert "SinglePartition" not in plan


def wide_rows(spark, n=300):
    """Feature rows with a column that neither model nor decision uses."""
    i = F.col("id")
    return spark.range(n).select(
        F.lit("A").alias("symbol"), i.alias("bar_idx"), i.alias("pos"), F.timestamp_seconds(i * 60).alias("open_time"),
        *[(100 + i % 7).cast("double").alias(c) for c in ("close", "high", "low", "st_line", "atr_1m")],
        F.when(i % 5 == 0, 1).otherwise(0).alias("fvg_event"), F.lit(1).alias("st_dir"), F.lit(1).alias("st_trend_15m"),
        F.lit("LAMINAR").alias("market_phase"), F.lit(1).alias("meta_label"), F.lit(1.0).alias("sample_weight"),
        F.lit(1).alias("holding_bars"), F.repeat(i.cast("string"), 50).alias("ballast"),
    )


def test_replay_moves_only_what_it_uses(spark, tmp_path):
    path = str(tmp_path / "wide")
    wide_rows(spark).write.parquet(path)
    assert "ballast" not in plan_of(run_signals(spark.read.parquet(path)))


def test_fit_writes_only_what_the_model_uses(spark, monkeypatch):
    written = []
    monkeypatch.setattr(training, "materialize", lambda df, label: written.append(df.columns) or df)
    assert training.fit_meta(wide_rows(spark), training.ModelConfig(features=("close", "st_dir"))) is None
    assert set(written[0]) == {
        "symbol", "pos", "bar_idx", "holding_bars", "meta_label", "sample_weight", "close", "st_dir", "role",
    }


def test_every_query_has_typed_columns():
    for name, q in REGISTRY.items():
        assert q.columns and len({c for c, _ in q.columns}) == len(q.columns), name
