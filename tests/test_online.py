"""Features on a stream against the batch table, and what happens between triggers."""

import numpy as np
import pandas as pd
import pytest

from catalog.base import ticks
from catalog.streams import as_stream, live_config, with_score, write_parts
from pyspark.sql import functions as F
from tests.conftest import SF
from tickspark.operators import gaps, signals
from tickspark.operators.index import with_row_index
from tickspark.layout import Layout
from tickspark.plans.features import FeatureConfig, feature_table
from tickspark.plans.replay import ReplayConfig, run_signals
from tickspark.plans.training import ModelConfig, assemble, fit_meta, labelled_events, score
from tickspark.operators.labels import Barriers
from tickspark.schema import FEATURE_NAMES
from tickspark.session import materialize, scratch_path
from tickspark.streaming import bars as sbars
from tickspark.streaming.features import stream_decisions
from tickspark.streaming.online import IN_COLUMNS, Online, stream_feature_table, stream_features
from tickspark.streaming.run import run_to_table

CFG = FeatureConfig(bucket_volume=25.0, n_buckets=8, higher_seconds=6 * 3600, gap_min_bps=1.0, gap_max_age=60)


def by_key(df):
    return df.toPandas().sort_values(["symbol", "bar_idx"], ignore_index=True)


@pytest.fixture(scope="module")
def batch(gap_rows):
    return materialize(feature_table(gap_rows, CFG), "test-batch-features")


def test_all_columns_equal_the_batch_table(gap_rows, batch):
    want, got = by_key(batch), by_key(run_to_table(stream_feature_table(as_stream(gap_rows, "t-online", "bar_idx"), CFG), "t-online"))
    assert len(want) == len(got) > 1000
    for c in (*FEATURE_NAMES, "is_valid"):
        assert np.allclose(want[c].astype(float), got[c].astype(float), rtol=1e-7, atol=1e-9, equal_nan=True), c
    assert sum(want[c].astype(float).std() > 0 for c in FEATURE_NAMES) >= 60


def test_bars_one_at_a_time_give_the_same(gap_rows):
    symbol = gap_rows.select(F.min("symbol")).first()[0]
    rows = gap_rows.where(F.col("symbol") == symbol).withColumn("open_us", F.unix_micros("open_time")).select(*IN_COLUMNS)
    rows = rows.toPandas().astype("float64").sort_values("bar_idx", ignore_index=True).head(260)
    whole, state, past, parts = Online(CFG).add(rows), None, None, []
    for k in range(len(rows)):
        online = Online(CFG, past, state)
        parts.append(online.add(rows.iloc[k : k + 1].reset_index(drop=True)))
        state, past = online.state(), [online.past[c].tolist() for c in online.names]
        assert len(online.past) <= online.keep and len(online.live) <= CFG.gap_max_age and len(online.buckets) <= CFG.n_buckets
    assert np.allclose(whole, pd.concat(parts, ignore_index=True), rtol=1e-9, atol=1e-12, equal_nan=True)


def test_decisions_from_ticks_with_a_fitted_model_equal_the_batch(spark, gap_rows, batch):
    """Bars, features and decisions chained on the stream, the model's score between them."""
    model_cfg = ModelConfig(rounds=3)
    model = fit_meta(labelled_events(batch, Barriers(vertical=20)), model_cfg)
    path = scratch_path(spark, "t-live-ticks")
    t = ticks(spark, SF)
    write_parts(t, path, F.dayofmonth("ts") > 15)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)
    live = stream_feature_table(sbars.finished_bars(sbars.stream_bars(stream, 2)), CFG)
    cfg = live_config()
    got = by_key(run_to_table(stream_decisions(score(live, model, model_cfg), cfg), "t-live"))

    rows = signals.event_gate(gaps.structure_breaks(batch, 20), cfg.window_bars)
    rows = signals.trend_alignment(signals.fallback_stop(rows, cfg.stop_factor, "atr_1m"))
    rows = signals.structure_confirm(rows, cfg.confirm_bars)
    asked = F.col("event_present") & ((F.col("trend_alignment") != "COUNTER") | F.col("structure_ok")) & (F.col("bar_idx") + 1 >= 3)
    numbered = with_row_index(score(rows.filter(asked), model, model_cfg), order=("open_time", "bar_idx"), slice_seconds=86_400, name="score_idx")
    gated = signals.confidence_gate(numbered, cfg.gate, layout=Layout(idx="score_idx")).select("symbol", "bar_idx", "score", "threshold", "gate_stage")
    want = by_key(signals.decide(rows.join(gated, ["symbol", "bar_idx"], "left"), cfg.decision, cfg.gate.mode))
    assert len(want) == len(got) and set(got.filtered_reason.dropna()) >= {"NO_EVENT", "LOW_CONFIDENCE"} and got.should_trade.any()
    for c in ("event_present", "trend_alignment", "gate_stage", "filtered_reason", "should_trade"):
        assert (want[c].fillna("-") == got[c].fillna("-")).all(), c
    assert np.allclose(want.threshold.astype(float), got.threshold.astype(float), equal_nan=True)


def test_the_replay_takes_entry_and_stop_of_primary_signals(spark, batch):
    """They replace close and ATR stop at their bars, and change neither direction nor any other bar."""
    cfg = ReplayConfig(gate=signals.GateConfig(mode="fixed", fixed_threshold=0.4), decision=signals.DecisionConfig(warmup_bars=50, require_structure=False))
    plain = by_key(run_signals(batch, cfg=cfg))
    assert not plain.from_primary.any() and len(plain) > 20
    picked = plain.iloc[::3]
    rows = [(r.symbol, int(r.bar_idx), r.entry_price + 1.0, r.stop_loss - 2.0) for r in picked.itertuples()]
    rows[0] = (*rows[0][:3], None)                      # without a stop the fallback stays
    rows[1] = (*rows[1][:3], 0.0)                       # a stop of 0 is none
    primary = spark.createDataFrame([*rows, (None, None, 1.0, 1.0)], "symbol string, bar_idx long, entry_price double, stop_loss double")
    got = by_key(run_signals(batch, cfg=cfg, primary=primary))
    assert len(got) == len(plain) - 1 and got.from_primary.sum() == len(rows) - 1
    both = plain.merge(got, on=["symbol", "bar_idx"], suffixes=("", "_new"))
    assert (both.direction == both.direction_new).all()
    assert np.allclose(both.entry_price_new - both.entry_price, both.from_primary_new * 1.0)
    moved = both.from_primary_new & ~((both.symbol == rows[0][0]) & (both.bar_idx == rows[0][1]))
    assert np.allclose(both.stop_loss - both.stop_loss_new, moved * 2.0)


def test_a_quiet_symbol_gives_its_last_ticks(spark):
    """Symbol a stops; its waiting ticks come out once the watermark, moved on by b, has passed their wait."""
    def rows(symbol, minutes):
        return [(symbol, m, 60 * m) for m in minutes]

    t = spark.createDataFrame(rows("a", range(10)) + rows("b", range(40)), "symbol string, seq long, s long").select(
        "symbol", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "seq", F.lit(1.0).alias("bid"), F.lit(1.1).alias("ask"),
        F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("received"),
    )
    path = scratch_path(spark, "t-quiet")
    write_parts(t, path, F.floor(F.col("seq") / 10))
    counts = {}
    for clock in ("received", None):
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(path)
        out = run_to_table(sbars.stream_bars(stream, 5, delay_ms=300_000, clock=clock), "t-quiet-out")
        counts[clock] = {r["symbol"]: r["count"] for r in out.where("kind = 'bar'").groupBy("symbol").count().collect()}
    assert counts == {"received": {"a": 2, "b": 7}, None: {"a": 1, "b": 7}}


class _Value:
    """A state value as a processor sees it."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held


class _Handle:
    def getValueState(self, name, schema):
        return _Value()


def test_a_large_trigger_is_worked_on_in_stretches(monkeypatch):
    """The rows of one symbol in a trigger give the same features a stretch at a time."""
    import numpy as np
    import pandas as pd

    from tickspark.plans.features import FeatureConfig
    from tickspark.streaming import online

    n = 300
    walk = 1000 + np.random.default_rng(5).normal(0, 1, n).cumsum()
    bars = pd.DataFrame({
        "bar_idx": range(n), "open_us": np.arange(n) * 7_000_000_000, "open": walk, "high": walk + 1.5, "low": walk - 1.5,
        "close": walk + 0.5, "tick_count": 20, "spread_sum": 0.2, "imbalance": np.arange(n) % 7 - 3, "duration_ms": 900.0,
    })

    def run(chunk):
        monkeypatch.setattr(online, "CHUNK", chunk)
        processor = online.FeatureProcessor(FeatureConfig(higher_seconds=86_400, bucket_volume=100.0, n_buckets=5))
        processor.init(_Handle())
        found = list(processor.handleInputRows(("A",), iter([bars.iloc[150:], bars.iloc[:150]]), None))
        assert max(map(len, found)) <= chunk
        return pd.concat(found, ignore_index=True)

    whole, parts = run(1000), run(64)
    pd.testing.assert_frame_equal(whole, parts, rtol=1e-9, atol=1e-9)


def test_a_large_table_arrives_in_more_parts(spark, monkeypatch):
    """What a trigger reads is bounded, the parts are in order and no row is lost."""
    from pyspark.sql import functions as F

    from catalog import streams
    from tickspark.session import scratch_path

    monkeypatch.setattr(streams, "PART_ROWS", 100)
    rows = spark.range(1000).select(F.lit("A").alias("symbol"), F.when(F.col("id") > 4, F.col("id")).alias("at"))
    written = []
    whole = streams.write_parts

    def noted(df, path, part, by):
        written.extend(df.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("p").collect())
        whole(df, path, part, by)

    monkeypatch.setattr(streams, "write_parts", noted)
    path = scratch_path(spark, "test-parts")
    streams.write_in_order(rows, path, "at", 4)
    assert len(written) == 10 and max(r["n"] for r in written) <= 120
    assert all(a["hi"] < b["lo"] for a, b in zip(written, written[1:]))
    assert spark.read.parquet(path).count() == 1000
