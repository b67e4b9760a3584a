"""The block-stepped walk of positions against a plain walk over every tick."""

import random

import pytest
from pyspark.sql import functions as F

from tickspark.operators import exits
from tickspark.operators.risk import Costs


def series(n, seed):
    rng, price, rows = random.Random(seed), 1000.0, []
    for k in range(n):
        price += rng.choice([-0.6, -0.2, 0.2, 0.6]) + (8 * rng.choice([-1, 1]) if k % 97 == 96 else 0)
        rows.append(("s", k, 1_700_000_000 + 7 * k, price - 0.05, price + 0.05))
    return rows


def plain(make, rules, position, rows):
    symbol, ticket, side, entry, opened, lots, start, close, stop, alignment = position
    p, out = make(rules, side, entry, opened, lots, stop, alignment), []
    for _, k, now, bid, ask in rows:
        if k <= start or (close is not None and k > close):
            continue
        action, price, pnl = p.tick(bid, ask, now)
        if action is not None:
            out.append((ticket, k, action[0], action[1], round(price, 9), action[2], action[3], round(pnl, 9)))
            if action[0] == "FULL_CLOSE":
                break
    return out


@pytest.mark.parametrize("mid", [False, True])
@pytest.mark.parametrize("block", [16, 50, 4096])
def test_blocks_equal_a_plain_walk(spark, monkeypatch, mid, block):
    """Long lives, early closes, positions opened at block edges; a gap of rows at the end of the series."""
    monkeypatch.setattr(exits, "POSITIONS_PER_GROUP", 4)
    rows = series(420, 3)
    rng, positions = random.Random(5), []
    for ticket in range(30):
        start = rng.choice([0, 15, 16, 31, 49, 50, 99, 200, 300, 400, 419])
        side, entry = rng.choice([1, -1]), rows[start][3] + 0.05
        close = rng.choice([None, None, start, start + 1, start + 60, 10_000])
        stop = rng.choice([entry - side * d for d in (2.0, 6.0, 300.0)] + [0.0])
        positions.append(("s", ticket, side, entry, float(rows[start][2]), 0.1, start, close, stop, rng.choice(["ALIGNED", "COUNTER", "UNKNOWN"])))
    rules = exits.MidExitRules(value_per_lot=20.0) if mid else exits.ExitRules(costs=Costs(value_per_lot=20.0), digits=4)
    make = exits.MidExit if mid else exits.NetExit
    ticks = spark.createDataFrame(rows, "symbol string, row_idx long, s long, bid double, ask double").withColumn("ts", F.timestamp_seconds("s"))
    opened = spark.createDataFrame(
        positions, "symbol string, ticket long, direction int, entry_price double, o double, lots double, start_row long, "
        "close_row long, stop_loss double, trend_alignment string",
    ).withColumn("entry_time", F.timestamp_seconds(F.col("o").cast("long")))
    run = exits.staged_exits_mid if mid else exits.staged_exits
    got = sorted(
        (r["ticket"], r["row_idx"], r["action"], r["stage"], round(r["price"], 9), r["new_sl"], r["close_lots"], round(r["pnl_usd"], 9))
        for r in run(opened, ticks, rules, block).collect()
    )
    want = sorted(a for p in positions for a in plain(make, rules, p, rows))
    assert got == want and {a[3] for a in want} == {"BE", "PARTIAL", "TRAILING", "SL_HIT"}
    assert run(opened.limit(0), ticks, rules, block).count() == 0
