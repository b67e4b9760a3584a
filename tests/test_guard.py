"""Halts from scores, fills and commands: rules one event at a time, and waiting, late and quiet inputs on a stream."""

import pytest
from pyspark.sql import functions as F

from tickspark.session import scratch_path
from tickspark.streaming.guard import RANKS, Guard, GuardConfig, guard_events, step, stream_guard
from tickspark.streaming.run import run_to_table

CFG = GuardConfig(low_run=3, loss_limit=100.0, max_losses=3, wait_ms=60_000)
DAY = 86_400_000_000


def event(us, kind, alert=None, low=None, slow=None, pnl=None, command=None):
    return (us, RANKS[kind], us, alert, low, slow, pnl, (us // DAY + 1) * DAY if kind == "fill" else None, command)


def walk(*events, until=None):
    rows = list(step(Guard(CFG), "a", sorted(events, key=lambda e: e[:3]), until))
    return [dict(zip(("kind", "us", "run", "model", "pnl", "losses", "risk"), (r[2], r[1], r[5], r[6], r[7], r[8], r[11]))) for r in rows]


def test_a_halted_model_waits_for_unlock():
    low = dict(low=True, slow=False)
    rows = walk(
        event(1, "score", **low), event(2, "score", **low), event(3, "command", command="unlock"), event(4, "score", **low),
        event(5, "score", low=False, slow=False), event(6, "command", command="unlock"), event(7, "score", low=False, slow=True),
        event(8, "score", alert="NAN_INF"), event(9, "command", command="resume"), event(10, "command", command="unlock"),
        event(11, "score", alert="NAN_INF"),
    )
    assert [r["model"] for r in rows] == [
        None, None, None, "CONFIDENCE_COLLAPSE", "CONFIDENCE_COLLAPSE", None, "LATENCY_EXCEEDED", "LATENCY_EXCEEDED", "LATENCY_EXCEEDED",
        None, "NAN_INF",
    ]
    # An unlock where nothing is halted leaves the run of low scores alone.
    assert [r["run"] for r in rows] == [1, 2, 2, 3, 3, 0, 0, 0, 0, 0, 0]


def test_a_daily_loss_ends_with_its_day_and_a_streak_does_not():
    rows = walk(
        event(1, "fill", pnl=5.0), event(2, "fill", pnl=-106.0), event(DAY + 1, "fill", pnl=-1.0), event(DAY + 2, "fill", pnl=-1.0),
        event(2 * DAY + 1, "score", low=False, slow=False), event(2 * DAY + 2, "command", command="resume"), event(2 * DAY + 3, "fill", pnl=0.0),
        until=9 * DAY,
    )
    assert [(r["kind"], r["pnl"], r["losses"], r["risk"]) for r in rows] == [
        ("fill", 5.0, 0, None), ("fill", -101.0, 1, "DAILY_LOSS_LIMIT"), ("rollover", 0.0, 1, None), ("fill", -1.0, 2, None),
        ("fill", -2.0, 3, "CONSECUTIVE_LOSSES"), ("rollover", 0.0, 3, "CONSECUTIVE_LOSSES"), ("score", 0.0, 3, "CONSECUTIVE_LOSSES"),
        ("command", 0.0, 0, None), ("fill", 0.0, 0, None), ("rollover", 0.0, 0, None),
    ]


def test_a_late_fill_of_an_ended_day_keeps_other_days_clean():
    guard = Guard(CFG)
    list(step(guard, "a", [event(1, "fill", pnl=-50.0), event(DAY + 5, "fill", pnl=-50.0)]))
    late = list(step(guard, "a", [event(2, "fill", pnl=-90.0), event(DAY + 4, "fill", pnl=-10.0)]))
    assert [(r[4], r[7], r[8], r[9]) for r in late] == [(True, -50.0, 3, 3), (True, -60.0, 4, 4)]


@pytest.fixture(scope="module")
def arrivals(spark):
    """Account a falls silent after a loss, b goes on; one fill of a comes days late; null account, score, result and time."""
    day = 1_700_006_400  # a midnight
    rows = [
        ("a", day + 60, 1, day + 60, "score", 0.9, None), ("a", day + 120, 2, day + 150, "fill", None, -150.0),
        ("a", day + 110, 3, day + 155, "score", 0.1, None), ("b", day + 100, 4, day + 160, "score", None, None),
        ("b", day + 130, 5, day + 170, "fill", None, None), (None, day + 140, 6, day + 180, "fill", None, -1.0),
        ("b", None, 7, day + 190, "fill", None, -1.0),
        *[("b", day + s, 8 + s, day + s, "score", 0.5, None) for s in (40_000, 80_000, 120_000, 160_000, 240_000)],
        ("a", day + 50, 900, day + 361_000, "fill", None, -7.0),
        ("b", day + 350_000, 901, day + 350_000, "score", 0.5, None),
    ]
    df = spark.createDataFrame(rows, "account string, s long, seq long, r long, kind string, score double, pnl double").select(
        "account", F.timestamp_seconds("s").alias("ts"), "seq", F.timestamp_seconds("r").alias("clock"), "kind", "score", "pnl",
    )
    path = scratch_path(spark, "t-guard")
    for k in range(4):  # one file for each trigger
        df.filter(F.floor((F.unix_seconds("clock") - day) / 100_000) == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    scores = stream.filter("kind = 'score'").withColumn("latency_ms", F.lit(None).cast("double"))
    fills = stream.filter("kind = 'fill'").withColumn("status", F.lit("FILLED"))
    commands = stream.filter("kind = 'command'").withColumn("command", F.lit("resume"))
    out = run_to_table(stream_guard(scores, fills, commands, CFG), "t-guard-out").toPandas()
    return day, out.sort_values("us", kind="stable")


def test_events_wait_and_are_used_in_order_of_time(arrivals):
    day, out = arrivals
    a = out[(out.account == "a") & ~out.is_late]
    assert [(k, None if s != s else s) for k, s in zip(a.kind, a.seq.astype(float))] == [
        ("score", 1), ("score", 3), ("fill", 2), ("rollover", None),
    ]
    assert list(a.risk_halt.fillna("-")) == ["-", "-", "DAILY_LOSS_LIMIT", "-"]
    assert a.us.iloc[-1] == (day + 86_400) * 1_000_000 and list(a.may_trade) == [True, True, False, True]


def test_late_null_and_odd_events(arrivals):
    _, out = arrivals
    late = out[out.is_late]
    assert list(late.seq) == [900] and list(late.total_trades) == [2] and list(late.daily_pnl) == [0.0]
    b = out[(out.account == "b") & (out.kind != "rollover")]
    assert 7 not in set(b.seq) and list(b.model_halt.unique()) == ["NAN_INF"]
    assert list(b[b.kind == "fill"].winning_trades) == [1]
    nobody = out[out.account.isna()]
    assert list(nobody.kind) == ["fill", "rollover"] and list(nobody.daily_pnl) == [-1.0, 0.0]


def test_vectors_are_checked_before_they_reach_the_state(spark):
    rows = [(1, [0.0, 3.0]), (2, [float("nan")]), (3, [101.0]), (4, [float("inf")]), (5, None)]
    scores = spark.createDataFrame(rows, "seq long, vector array<double>").selectExpr(
        "'a' as account", "timestamp_seconds(seq) as ts", "seq", "0.9d as score", "1d as latency_ms", "vector", "current_timestamp() as clock"
    )
    fills = scores.selectExpr("account", "ts", "seq", "clock", "'FILLED' as status", "1d as pnl").limit(0)
    commands = scores.selectExpr("account", "ts", "seq", "clock", "'unlock' as command").limit(0)
    got = {r.seq: r.alert for r in guard_events(scores, fills, commands, CFG).collect()}
    assert got == {1: None, 2: "NAN_INF", 3: "STATE_SATURATION", 4: "NAN_INF", 5: None}


def test_waiting_events_are_kept_in_stretches(monkeypatch):
    """The state holds many events in a row of its list, and gives them back as they were."""
    from tickspark.streaming import guard

    monkeypatch.setattr(guard, "STRETCH", 4)
    events = [event(k, "fill", pnl=float(k)) if k % 3 else event(k, "score", alert=None, low=k % 2 == 0, slow=False) for k in range(10)]
    rows = guard.in_stretches(events)
    assert [len(r[0]) for r in rows] == [4, 4, 2]
    assert guard.from_stretches(rows) == events
    assert guard.in_stretches([]) == [] and guard.from_stretches([]) == []
