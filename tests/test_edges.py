"""Series that the supplied tables do not hold: flat, without volume, of one row, sparse, out of ticket order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_semantics import synthetic_bars
from tickspark.layout import run_blocked
from tickspark.operators import classic, clean, cv, gaps, joins, price, profile, risk, scan, signals, vpin
from tickspark.plans.features import feature_table

DAY = dt.datetime(2024, 1, 1)


def flat_bars(spark, n=80):
    same = {c: F.lit(1.0) for c in ("open", "high", "low", "close")}
    return synthetic_bars(spark, n).withColumns(same)


def fills(spark, rows):
    return spark.createDataFrame(
        [(DAY + dt.timedelta(hours=10, minutes=m), t, "FILLED", float(p), a) for m, t, p, a in rows],
        "ts timestamp, ticket bigint, status string, pnl double, account bigint",
    )


def test_fills_follow_time_not_ticket(spark):
    rows = fills(spark, [(0, 250_000, -1, 0), (10, 5, 2, 0), (20, 250_001, -4, 0)])
    daily = {r["ticket"]: r["daily_pnl"] for r in risk.daily_pnl(rows).collect()}
    assert daily == {250_000: -1, 5: 1, 250_001: -3}
    streak = {r["ticket"]: (r["total_trades"], r["consecutive_losses"]) for r in risk.loss_streaks(rows).collect()}
    assert streak == {250_000: (1, 1), 5: (2, 0), 250_001: (3, 1)}
    equity = risk.drawdown(risk.account_equity(risk.with_trading_day(rows), 100.0))
    assert {r["ticket"]: (r["equity"], r["peak_equity"]) for r in equity.collect()} == {
        250_000: (99, 99), 5: (101, 101), 250_001: (97, 101)
    }


def test_accounts_are_apart(spark):
    rows = fills(spark, [(0, 1, -1, 0), (1, 2, -1, 1), (2, 3, -1, 0), (3, 4, 5, 1)])
    got = {r["ticket"]: r["consecutive_losses"] for r in risk.loss_streaks(rows, by=("account",)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 0}
    breaches = risk.risk_breaches(rows, 1e9, 2, by=("account",)).collect()
    assert [(r["account"], r["ticket"]) for r in breaches] == [(0, 3)]


def test_nan_is_no_norm(spark):
    rows = spark.createDataFrame([(1, [float("nan")]), (2, [float("inf")]), (3, [200.0]), (4, [1.0])], "k int, vector array<double>")
    assert sorted(r["k"] for r in risk.saturation_alerts(rows).collect()) == [2, 3]


def test_flat_series(spark):
    flat = flat_bars(spark)
    lines = classic.dmi(flat).where("di_plus is not null").select("di_plus", "di_minus").distinct().collect()
    assert [tuple(r) for r in lines] == [(0.0, 0.0)]
    ranged = run_blocked(flat, [price.true_range.step(), price.atr.step(14), gaps.detect_fvg.step(5.0)])
    assert gaps.fvg_event(ranged).count() == 80
    zero = flat.withColumn("close", F.lit(0.0))
    assert run_blocked(zero, [price.log_return.step()]).agg(F.max("log_return")).first()[0] == 0


@pytest.mark.parametrize("n", [1, 80])
def test_feature_table_of_flat_and_single_rows(spark, n):
    assert feature_table(flat_bars(spark, n)).count() == n


def test_no_volume(spark):
    rows = spark.createDataFrame(
        [("X", i, 0.0, 0.0, 0.0, i, True) for i in range(6)],
        "symbol string, bar_idx long, buy_volume double, sell_volume double, tick_count double, bucket long, closes_bucket boolean",
    )
    assert {r["vpin"] for r in vpin.vpin(rows, 3).collect()} == {None, 0.0}


def test_one_return(spark):
    rows = spark.createDataFrame(
        [("X", DAY + dt.timedelta(seconds=i), i, 1.0 + i, 1.1 + i) for i in range(2)],
        "symbol string, ts timestamp, seq long, bid double, ask double",
    )
    got = profile.return_profile(rows).first()
    assert got["n_returns"] == 1 and got["return_std"] is None and got["large_moves"] == 0
    missing = rows.withColumn("ts", F.when(F.col("seq") == 0, F.col("ts")))
    with pytest.raises(Exception, match="NULL in ts"):
        clean.tick_returns(missing).collect()


def test_average_of_a_sparse_column(spark):
    n, alpha = 70_000, 0.1
    rows = spark.range(n).select(
        F.lit("X").alias("symbol"), F.col("id").alias("bar_idx"),
        F.when(F.col("id") % 200 == 0, (F.col("id") / 200 % 7).cast("double")).alias("x"),
    )
    got = scan.ewma(rows, "x", alpha).where("bar_idx in (65600, 66000)").orderBy("bar_idx").collect()
    value, want = None, {}
    for i in range(0, 66_001, 200):
        x = i / 200 % 7
        value = x if value is None else value + alpha * (x - value)
        want[i] = value
    assert [r["x_ewma"] for r in got] == pytest.approx([want[65_600], want[66_000]])


def test_positions_live_to_their_close(spark):
    ticks = spark.range(10_000).select(
        F.lit("X").alias("symbol"), F.col("id").alias("row_idx"), F.timestamp_seconds("id").alias("ts"),
        F.lit(1.0).alias("bid"), F.lit(1.1).alias("ask"),
    )
    held = spark.createDataFrame(
        [("X", 1, 0, 9000), ("X", 2, 9990, None), ("X", 3, 5, 5), ("X", 4, 4095, 4096), ("X", 5, 9_999, None)],
        "symbol string, ticket int, start_row long, close_row long",
    )
    got = {r["ticket"]: (r["a"], r["b"], r["n"]) for r in joins.positions_on_ticks(held, ticks).groupBy("ticket").agg(
        F.min("row_idx").alias("a"), F.max("row_idx").alias("b"), F.count("*").alias("n")).collect()}
    assert got == {1: (1, 9000, 9000), 2: (9991, 9999, 9), 4: (4096, 4096, 1)}


def test_embargo_has_no_bound_unless_asked(spark):
    row = spark.range(1).select(cv.embargo_size(F.lit(50_000)).alias("a"), cv.embargo_size(F.lit(50_000), high=100).alias("b")).first()
    assert tuple(row) == (500, 100)


def test_phase_is_checked_behind_a_fixed_gate_only(spark):
    row = spark.range(1).select(
        F.lit("ALIGNED").alias("trend_alignment"), F.lit(True).alias("structure_ok"), F.lit("FROZEN").alias("market_phase"),
        F.lit(100).alias("bar_idx"), F.lit(True).alias("event_present"), F.lit("FULL").alias("gate_stage"),
        F.lit(0.9).alias("score"), F.lit(0.5).alias("threshold"), F.lit(1.0).alias("stop_loss"),
    )
    cfg = signals.DecisionConfig(require_transition=True)
    assert [signals.decide(row, cfg, m).first()["filtered_reason"] for m in ("rolling_quantile", "fixed")] == [None, "WRONG_PHASE"]
