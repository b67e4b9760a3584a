"""Definitions that differ between a batch and a live reading, and plain properties."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.util import assert_same, keyed
from tickspark import schema
from tickspark.layout import run_blocked
from tickspark.operators import asof, cv, denoise, fold, gaps, labels, price, trend
from tickspark.operators.bars import BAR_COLUMNS, index_time_bars, tick_bars, time_bars, volume_bars


def synthetic_bars(spark, n=100):
    """Closes alternating by 1e-4 around 1, one second and ten ticks per bar."""
    start = dt.datetime(2024, 1, 1)
    rows, close = [], 1.0
    for i in range(n):
        opened = close
        close = opened + (1e-4 if i % 2 == 0 else -1e-4)
        rows.append((
            "X", i, start + dt.timedelta(seconds=i), start + dt.timedelta(seconds=i + 1), opened,
            max(opened, close), min(opened, close), close, 10, 10.0, 0, 0.0, 5, 5, 0, 0.1, 1000.0,
        ))
    kinds = ("string bigint timestamp timestamp double double double double bigint double bigint double bigint "
             "bigint bigint double double").split()
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(BAR_COLUMNS, kinds)))


def test_temperature_is_in_log_return_units(spark):
    rows = run_blocked(synthetic_bars(spark), [price.log_return.step(), price.temperature.step(50)])
    out = keyed(rows, ["log_return", "market_temperature"])
    # the alternating series has variance 1e-8, a second per bar, scale 1e6
    assert out["market_temperature"].iloc[-1] == pytest.approx(1e-5, rel=1e-2)
    # a full window of 50 rows first exists at row 49
    assert out["market_temperature"].isna().sum() == 49


def test_rows_of_a_prefix_do_not_change(gap_rows):
    """Nothing looks ahead: with the future cut off, the past stays the same."""
    def run(rows):
        steps = [price.log_return.step(), price.rolling_zscore.step("log_return", 50),
                 price.true_range.step(), price.atr.step(14), gaps.detect_fvg.step(5.0)]
        out = gaps.fvg_event(gaps.fvg_state_features(run_blocked(rows, steps), 40))
        out = trend.pivot_supertrend(out, trend.SuperTrend(factor=0.5))
        high = index_time_bars(time_bars(rows, 86_400)).withColumn("mid", (F.col("high") + F.col("low")) / 2)
        return asof.align_features(out, high, ["mid"])

    columns = ["log_return_zscore", "atr", "fvg_event", "active_fvg_count", "st_line", "st_dir", "mid"]
    cut = 400
    full = keyed(run(gap_rows).filter(F.col("bar_idx") < cut), columns)
    prefix = keyed(run(gap_rows.filter(F.col("bar_idx") < cut)), columns)
    assert_same(full, prefix)


def test_alignment_in_progress_sees_the_future(bar_rows):
    high = time_bars(bar_rows, 86_400).withColumn("mid", (F.col("high") + F.col("low")) / 2)
    causal = keyed(asof.align_features(bar_rows, high, ["mid"]), ["mid"])
    leaky = keyed(asof.align_features(bar_rows, high, ["mid"], causal=False), ["mid"])
    assert (causal["mid"] != leaky["mid"]).any()


def test_volume_source_is_honoured(spark):
    from catalog.base import ticks

    t = ticks(spark, SF)
    by_count, by_volume = volume_bars(t, 50, "tick_count"), volume_bars(t, 50.0, "real")
    assert by_count.count() != by_volume.count()
    assert by_volume.filter(F.col("volume") < 50).count() == 0
    assert volume_bars(t, 50.0, "real", grid=True).count() >= by_volume.count()


def test_synthetic_volume_bars(spark):
    from catalog.base import ticks

    bars = volume_bars(ticks(spark, SF), 5_000.0, "synthetic")
    assert bars.count() > 0 and bars.filter(F.col("volume") < 5_000).count() == 0


def test_bars_keep_every_tick(spark):
    from catalog.base import ticks

    t = ticks(spark, SF)
    bars = tick_bars(t, 13, emit_partial=True)
    assert bars.agg(F.sum("tick_count")).first()[0] == t.count()
    bad = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    assert bars.filter(bad).count() == 0
    assert bars.filter(F.abs("imbalance_ratio") > 1).count() == 0
    assert bars.filter(F.col("imbalance") != F.col("buy_count") - F.col("sell_count")).count() == 0
    closed = tick_bars(t, 13)
    assert closed.filter(F.col("tick_count") != 13).count() == 0


def test_adaptive_mode_differs_from_plain(bar_rows):
    plain = denoise.denoise(bar_rows, "kalman").select("symbol", "bar_idx", "denoised")
    adaptive = denoise.denoise(bar_rows, "adaptive").select("symbol", "bar_idx", F.col("denoised").alias("a"))
    both = plain.join(adaptive, ["symbol", "bar_idx"])
    assert both.count() == bar_rows.count()
    assert both.filter(F.abs(F.col("denoised") - F.col("a")) > 1e-6).count() > 0


def test_wavelet_parts_add_up(bar_rows):
    for wavelet in denoise.FILTERS:
        rows = denoise.wavelet_decompose(bar_rows, "close", 3, wavelet)
        total = F.col("wavelet_trend") + F.col("detail_1") + F.col("detail_2") + F.col("detail_3")
        assert rows.filter(F.abs(total - F.col("close")) > 1e-6).count() == 0


def test_center_update_modes_differ(gap_rows):
    every = trend.pivot_supertrend(gap_rows, trend.SuperTrend())
    pivot = trend.pivot_supertrend(gap_rows, trend.SuperTrend(center_update="on_pivot"))
    a, b = keyed(every, ["center"]), keyed(pivot, ["center"])
    assert (a["center"].fillna(0) != b["center"].fillna(0)).any()


def test_imbalance_bar_rule():
    steps = [0, 1, 1, 1, -1, 1, 1, 1]
    ids, closes = fold.imbalance_bar_ids(steps, expected_ticks=4, expected_imbalance=0.5)
    assert ids[:3] == [0, 0, 0] and closes[2]
    assert ids[3] == 1


def test_imbalance_bars_keep_every_tick(spark):
    from catalog.base import ticks

    t = ticks(spark, SF)
    assert fold.imbalance_bars(t, 4.0, session_seconds=86_400).agg(F.sum("tick_count")).first()[0] == t.count()


def test_counter_cap(spark):
    rows = spark.createDataFrame(
        [("X", i, "COUNTER" if i % 2 else "ALIGNED") for i in range(40)], "symbol string, seq long, trend_alignment string"
    ).withColumn("ts", F.timestamp_seconds(F.col("seq")))
    out = keyed(fold.counter_cap(rows, 10, 0.3, 5), ["accepted", "trend_alignment"], ("symbol", "seq"))
    recent: list[bool] = []
    for ok, kind in zip(out["accepted"], out["trend_alignment"]):
        counter = kind == "COUNTER"
        blocked = counter and len(recent) >= 5 and sum(recent[-10:]) / len(recent[-10:]) >= 0.3
        assert ok == (not blocked)
        if ok:
            recent.append(counter)


def test_state_runs_on_over_days_and_batches(spark):
    """Without sessions, state is carried along each series however it is cut into batches."""
    n, before = 400, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    mids = {s: [100.0 + ((i * m) % 17) / 4 + i / 50 for i in range(n)] for s, m in (("X", 7), ("Y", 5))}
    kinds = [("COUNTER", "ALIGNED", "COUNTER")[i * i % 3] for i in range(n)]
    rows = [(s, i, x - 0.5, x + 0.5, x, kinds[i]) for s, xs in mids.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, seq long, bid double, ask double, close double, trend_alignment string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 20_000)).withColumn("open_time", F.col("ts")).withColumn("bar_idx", F.col("seq"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got_bars = fold.imbalance_bars(df, 4.0).orderBy("symbol", "bar_in_session").collect()
        got_kalman = denoise.denoise(df, "adaptive").orderBy("symbol", "seq").collect()
        got_cap = fold.counter_cap(df).orderBy("symbol", "seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    past, bars, estimates, accepted = [], [], [], []
    for s, xs in mids.items():
        ids, closes = fold.imbalance_bar_ids([0.0, *(float((b > a) - (b < a)) for a, b in zip(xs, xs[1:]))], 4.0)
        bars += [(s, k, ids.count(k), k in {i for i, c in zip(ids, closes) if c}) for k in range(max(ids) + 1)]
        flt, past = fold.AdaptiveKalman(), []
        estimates += [flt.step(x)[0] for x in xs]
        for kind in kinds:
            ok = not (kind == "COUNTER" and len(past) >= 5 and sum(past) / len(past) >= 0.3)
            accepted.append(ok)
            past = [*past, kind == "COUNTER"][-20:] if ok else past
    assert [(r["symbol"], r["bar_in_session"], r["tick_count"], r["is_complete"]) for r in got_bars] == bars
    assert [r["kalman"] for r in got_kalman] == pytest.approx(estimates, abs=1e-12)
    assert [r["accepted"] for r in got_cap] == accepted


def test_training_never_meets_the_test_block(bar_rows):
    samples = bar_rows.select("symbol", "bar_idx", F.col("bar_idx").alias("pos"), F.lit(7).alias("holding"))
    for table, key in (
        (cv.purged_kfold(samples, 5, start="bar_idx", holding="holding"), "fold"),
        (cv.cpcv(samples, 6, 2, start="bar_idx", holding="holding"), "combo"),
    ):
        rows = table.toPandas()
        for _, part in rows.groupby(["symbol", key]):
            test = part[part["role"] == "test"]
            embargo = int(part["embargo"].iloc[0])
            spans = [(b["bar_idx"].min(), b["bar_idx"].max() + 7) for _, b in test.groupby("fold_of")]
            for low, high in spans:
                train = part[part["role"] == "train"]
                assert not ((train["bar_idx"] <= high + embargo) & (train["bar_idx"] + 7 >= low)).any()
    assert cv.combination_folds(4, 2) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_both_barrier_methods_agree(bar_rows):
    rows = labels.barrier_vol(bar_rows, 20).withColumn("direction", F.when(F.col("imbalance") > 0, 1))
    cfg = labels.Barriers(vertical=9)
    columns = ["barrier_hit", "exit_idx", "exit_price", "return_pct", "holding_bars"]
    dense, sparse = labels.triple_barrier(rows, cfg), labels.triple_barrier(rows, cfg, sparse=True)
    assert_same(keyed(dense, columns), keyed(sparse, columns))


def test_audit_raises_on_duplicates(bar_rows):
    rows = labels.barrier_vol(bar_rows, 20).withColumn("direction", F.lit(1))
    made = labels.meta_label(labels.triple_barrier(rows, labels.Barriers(vertical=5)))
    signals = made.select("symbol", "bar_idx", "direction")
    labels.funnel_audit(signals, made, bar_rows)
    with pytest.raises(ValueError):
        labels.funnel_audit(signals.unionByName(signals), made, bar_rows)
    with pytest.raises(ValueError):
        labels.funnel_audit(signals.filter(F.col("bar_idx") > 3), made, bar_rows)


def test_balanced_segments(spark):
    from catalog.base import ticks
    from tickspark.operators.bars import indexed_ticks

    rows = labels.balance_segments(indexed_ticks(ticks(spark, SF)), 50, 1.0)
    counts = rows.groupBy("trend").count().toPandas()["count"]
    assert counts.nunique() == 1 and len(counts) == 3
    again = labels.balance_segments(indexed_ticks(ticks(spark, SF)), 50, 1.0)
    keys = ["symbol", "segment"]
    assert rows.select(keys).exceptAll(again.select(keys)).count() == 0


def test_schema_round_trip():
    text = schema.to_json()
    assert schema.from_json(text) == schema.FEATURES
    assert len(schema.FEATURES) == 63 and len({s.category for s in schema.FEATURES}) == 15
    with pytest.raises(ValueError):
        schema.from_json(text.replace('"vpin"', '"vpim"'))
    assert not schema.is_compatible(schema.FEATURES, schema.FEATURES[::-1])
    assert schema.missing_names(["vpin", "nope"], schema.FEATURE_NAMES) == ["nope"]
    assert set(schema.SEQUENCE_FEATURES) <= set(schema.FEATURE_NAMES) and len(schema.SEQUENCE_FEATURES) == 24
    assert set(schema.FILTER_FEATURES) <= set(schema.FEATURE_NAMES) and len(schema.FILTER_FEATURES) == 10


def test_normal_cdf(spark):
    import math

    from tickspark.functions.math import normal_cdf

    values = [-40.0, -9.0, -7.2, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0, 6.9, 7.2, 40.0]
    rows = spark.createDataFrame([(v,) for v in values], "z double").select("z", normal_cdf(F.col("z")).alias("p"))
    for z, p in rows.collect():
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-7, abs=1e-15)


def test_adaptive_filter_tracks(spark):
    flt = fold.AdaptiveKalman()
    out = [flt.step(5.0)[0] for _ in range(50)]
    assert out[-1] == pytest.approx(5.0)
    assert pd.Series(out).nunique() == 1


def test_the_validation_tail_meets_no_label_of_training(spark):
    """Positions with gaps, labels that reach the tail, a key of one row, a label of unknown length."""
    rows = [("a", p, 2 * p, 1) for p in (0, 1, 2, 3, 30, 31)] + [("a", 40, 80, 0), ("a", 49, 98, 0), ("a", 10, 20, 60), ("a", 11, 22, 58)]
    rows += [("a", 12, 24, 57 - 2), ("a", 13, 26, None), ("b", 7, 3, 9), ("a", 39, 78, 2)]
    df = spark.createDataFrame(rows, "symbol string, pos long, bar_idx long, holding_bars long")
    got = {(r.symbol, r.pos): r.role for r in cv.purged_tail(df, 5).collect()}
    tail = {("a", 40), ("a", 49), ("b", 7)}
    assert {k for k, v in got.items() if v == "validation"} == tail
    # The tail of a starts at bar 80: labels that end at 80 are left out.
    gone = {("a", 10), ("a", 11), ("a", 39)}
    assert set(got) == {(r[0], r[1]) for r in rows} - gone
    assert cv.purged_tail(df.limit(0)).count() == 0
    one = {r.pos: r.role for r in cv.purged_tail(df.filter("symbol = 'a' and pos < 4"), 2, by=()).collect()}
    assert one == {0: "train", 1: "train", 2: "validation", 3: "validation"}  # 2 + 1 < 4
