"""Staged exits evaluated over recorded positions and ticks.

The rules depend on their own past actions, so a position is walked tick by tick, but only where something can
happen.  Ticks lie in blocks.  A round moves every open position, whatever its age, to the next block whose prices
reach one of its levels, found in a table of the extremes of all blocks, and walks it through that one
block.  Only the state of positions still open is handed to the next round; nothing is read after the close.  So a group
holds one block of ticks and a bounded number of positions, and there are as many rounds as the busiest
position has blocks in which it may act.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.operators.risk import Costs
from tickspark.session import materialize

ACTION_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()), T.StructField("ticket", T.LongType()),
        T.StructField("row_idx", T.LongType()), T.StructField("action", T.StringType()),
        T.StructField("stage", T.StringType()), T.StructField("price", T.DoubleType()),
        T.StructField("new_sl", T.DoubleType()), T.StructField("close_lots", T.DoubleType()),
        T.StructField("pnl_usd", T.DoubleType()),
    ]
)

# Multipliers of the profit thresholds and of the trailing distance by alignment.
ALIGNMENT_FACTORS = {"ALIGNED": (1.3, 1.2), "COUNTER": (0.7, 0.8), "UNKNOWN": (1.0, 1.0)}

Action = tuple[str, str, float | None, float | None]


@dataclass(frozen=True)
class ExitRules:
    """Rules on net profit at bid and ask."""

    costs: Costs = Costs()
    min_hold_sec: float = 30.0
    modify_cooldown_sec: float = 2.0
    min_gap: float = 0.50
    digits: int = 2
    be_trigger: float = 15.0
    be_offset: float = 0.50
    partial_trigger: float = 30.0
    partial_ratio: float = 0.5
    min_lots: float = 0.02
    partial_cooldown_sec: float = 5.0
    trail_start: float = 25.0
    trail_distance: float = 3.0
    trail_step: float = 0.50
    alignment: dict = field(default_factory=lambda: dict(ALIGNMENT_FACTORS))


@dataclass(frozen=True)
class MidExitRules:
    """The older rules on gross profit at the mid."""

    value_per_lot: float = 1.0
    be_trigger: float = 15.0
    be_offset: float = 1.0
    partial_trigger: float = 30.0
    partial_ratio: float = 0.5
    min_lots: float = 0.01
    trail_distance: float = 5.0
    trail_step: float = 1.0
    modify_cooldown_sec: float = 1.0
    digits: int = 2


def partial_lots(lots: float, ratio: float, keep: float) -> float:
    """Lots to close so that at least ``keep`` remain."""
    part = round(lots * ratio, 2)
    return part if lots - part >= keep else max(0.0, round(lots - keep, 2))


class Position:
    """What is kept of an open position between blocks: its ``FIELDS`` as numbers, NaN for none."""

    FIELDS: tuple[str, ...] = ()

    def state(self) -> list[float]:
        return [math.nan if (v := getattr(self, f)) is None else float(v) for f in self.FIELDS]

    @classmethod
    def at(cls, rules, state: Sequence[float]):
        """The position as it was left."""
        out = cls.__new__(cls)
        out.r = rules
        for f, v in zip(cls.FIELDS, state):
            setattr(out, f, None if v != v else v)
        return out

    def first_busy(self, worst: np.ndarray, best: np.ndarray) -> int:
        """The first of the blocks, given by their worst and best price, in which the position may act.

        Blocks before it are passed; their number if there is none.
        """
        side, best_so_far = self.side, side_best(self.side, best)
        hit = (worst - self.stop) * side <= 0 if self.stop > 0 else np.zeros(len(worst), bool)
        busy = np.flatnonzero(hit | self.may_act(best, best_so_far))
        k = int(busy[0]) if len(busy) else len(worst)
        if k:
            self.passed(float(best_so_far[k - 1]))
        return k


def side_best(side: float, prices: np.ndarray) -> np.ndarray:
    """The best price so far."""
    return side * np.maximum.accumulate(side * prices)


class NetExit(Position):
    """One position under :class:`ExitRules`; every tick gives at most one action."""

    FIELDS = (
        "side", "entry", "opened", "lots", "stop", "cost", "profit_factor", "distance_factor", "stage", "trailing", "trail_stop",
        "best", "moved_at", "acted_at",
    )

    @staticmethod
    def prices(rows: pd.DataFrame, side: float, end: str) -> np.ndarray:
        """Longs leave at the bid, shorts at the ask; ``end`` is the ``worst`` or ``best`` price of a block."""
        return rows[f"{'bid' if side == 1 else 'ask'}_{'low' if (end == 'worst') == (side == 1) else 'high'}"].to_numpy()

    def may_act(self, best: np.ndarray, best_so_far: np.ndarray) -> np.ndarray:
        r, side = self.r, self.side
        net = (best - self.entry) * side * self.lots * r.costs.value_per_lot - self.cost
        if self.stage == 0:
            return net >= r.be_trigger * self.profit_factor
        due = np.zeros(len(best), bool) if self.stage >= 2 else net >= min(r.partial_trigger, r.trail_start) * self.profit_factor
        if self.stage >= 2 or self.trailing:
            peak = best_so_far if self.best is None else side * np.maximum(side * self.best, side * best_so_far)
            reach = peak - side * r.trail_distance * self.distance_factor
            base = self.trail_stop if self.trailing else self.stop
            slack = 0.5 * 10.0 ** -r.digits
            due |= (base <= 0) | ((reach - base - side * r.trail_step) * side >= -slack)
        return due

    def passed(self, best: float) -> None:
        if self.best is None or self._ahead(best, self.best):
            self.best = best

    def __init__(self, rules: ExitRules, side: int, entry: float, opened: float, lots: float, stop: float, alignment: str):
        self.r, self.side, self.entry, self.opened = rules, side, entry, opened
        self.lots, self.stop = lots, stop
        c = rules.costs
        self.cost = (c.commission_per_lot + c.slippage_per_lot) * lots + c.buffer_usd
        self.profit_factor, self.distance_factor = rules.alignment[alignment]
        self.stage, self.trailing, self.trail_stop = 0, False, 0.0
        self.best: float | None = None
        self.moved_at = self.acted_at = 0.0

    def _ahead(self, a: float, b: float) -> bool:
        """Is ``a`` better than ``b`` for this side?"""
        return a > b if self.side == 1 else a < b

    def _allowed(self, stop: float, price: float) -> bool:
        """Far enough from the price, and never a step back."""
        if not self._ahead(price - self.side * self.r.min_gap, stop):
            return False
        return self.stop <= 0 or not self._ahead(self.stop, stop)

    def tick(self, bid: float, ask: float, now: float) -> tuple[Action | None, float, float]:
        r, side = self.r, self.side
        price = bid if side == 1 else ask
        if self.best is None or self._ahead(price, self.best):
            self.best = price
        net = (price - self.entry) * side * self.lots * r.costs.value_per_lot - self.cost
        return self._decide(price, net, now), price, net

    def _decide(self, price: float, net: float, now: float) -> Action | None:
        r, side = self.r, self.side
        if now - self.opened < r.min_hold_sec:
            return None
        if self.stop > 0 and not self._ahead(price, self.stop):
            return "FULL_CLOSE", "SL_HIT", None, self.lots
        if self.stage == 1 and net >= r.partial_trigger * self.profit_factor:
            part = partial_lots(self.lots, r.partial_ratio, r.min_lots)
            if part >= r.min_lots and now - self.acted_at >= r.partial_cooldown_sec:
                self.stage, self.trailing, self.best = 2, True, price
                self.lots -= part
                self.acted_at = now
                return "PARTIAL_CLOSE", "PARTIAL", None, part
        cooling = self.moved_at > 0 and now - self.moved_at < r.modify_cooldown_sec
        if self.stage == 0 and net >= r.be_trigger * self.profit_factor:
            stop = round(self.entry + side * r.be_offset, r.digits)
            if not cooling and self._allowed(stop, price):
                self.stage, self.stop, self.trail_stop = 1, stop, stop
                self.moved_at = self.acted_at = now
                return "MOVE_SL", "BE", stop, None
            if cooling:
                return None
        if self.stage >= 2 or (self.stage == 1 and net >= r.trail_start * self.profit_factor):
            if not self.trailing:
                self.trailing, self.trail_stop = True, self.stop
            if now - self.moved_at < r.modify_cooldown_sec:
                return None
            stop = round(self.best - side * r.trail_distance * self.distance_factor, r.digits)
            far = self.trail_stop <= 0 or not self._ahead(self.trail_stop + side * r.trail_step, stop)
            if self._allowed(stop, price) and far:
                if self._ahead(stop, self.trail_stop):
                    self.trail_stop = self.stop = stop
                    self.moved_at = now
                return "MOVE_SL", "TRAILING", stop, None
        return None


class MidExit(Position):
    """One position under :class:`MidExitRules`."""

    FIELDS = ("side", "entry", "lots", "stop", "at_even", "partial", "trailing", "trail_stop", "best", "moved_at")

    @staticmethod
    def prices(rows: pd.DataFrame, side: float, end: str) -> np.ndarray:
        return rows[f"mid_{'low' if (end == 'worst') == (side == 1) else 'high'}"].to_numpy()

    def may_act(self, best: np.ndarray, best_so_far: np.ndarray) -> np.ndarray:
        r, side = self.r, self.side
        pnl = (best - self.entry) * side * self.lots * r.value_per_lot
        if not self.at_even:
            return pnl >= r.be_trigger
        due = np.zeros(len(best), bool) if self.partial else pnl >= r.partial_trigger
        if self.trailing:
            peak = side * np.maximum(side * self.best, side * best_so_far)
            due |= (peak - side * (r.trail_distance + r.trail_step) - self.trail_stop) * side > 0
        return due

    def passed(self, best: float) -> None:
        if self.trailing and self._ahead(best, self.best):
            self.best = best

    def __init__(self, rules: MidExitRules, side: int, entry: float, opened: float, lots: float, stop: float, alignment: str):
        self.r, self.side, self.entry, self.lots, self.stop = rules, side, entry, lots, stop
        self.at_even = self.partial = self.trailing = False
        self.trail_stop = 0.0
        self.best = 0.0
        self.moved_at = 0.0

    def _ahead(self, a: float, b: float) -> bool:
        return a > b if self.side == 1 else a < b

    def tick(self, bid: float, ask: float, now: float) -> tuple[Action | None, float, float]:
        price = (bid + ask) / 2
        if self.trailing and self._ahead(price, self.best):
            self.best = price
        pnl = (price - self.entry) * self.side * self.lots * self.r.value_per_lot
        return self._decide(price, pnl, now), price, pnl

    def _decide(self, price: float, pnl: float, now: float) -> Action | None:
        r, side = self.r, self.side
        if self.stop > 0 and not self._ahead(price, self.stop):
            return "FULL_CLOSE", "SL_HIT", None, self.lots
        if self.at_even and not self.partial and pnl >= r.partial_trigger:
            part = partial_lots(self.lots, r.partial_ratio, r.min_lots)
            if part >= r.min_lots:
                self.partial = self.trailing = True
                self.lots -= part
                self.trail_stop, self.best = self.stop, price
                return "PARTIAL_CLOSE", "PARTIAL", None, part
        if not self.at_even and pnl >= r.be_trigger:
            stop = round(self.entry + side * r.be_offset, r.digits)
            self.at_even, self.stop, self.moved_at = True, stop, now
            return "MOVE_SL", "BE", stop, None
        if self.trailing and now - self.moved_at >= r.modify_cooldown_sec:
            raw = self.best - side * r.trail_distance
            if self._ahead(raw, self.trail_stop + side * r.trail_step):
                stop = round(raw, r.digits)
                self.trail_stop = self.stop = stop
                self.moved_at = now
                return "MOVE_SL", "TRAILING", stop, None
        return None


#: Positions walked in one group, and ticks in a block.
POSITIONS_PER_GROUP = 256
BLOCK_TICKS = 1 << 16
OPEN = "symbol string, ticket long, until long, at long, state array<double>"
END = (1 << 62)


def _opened(positions: DataFrame, make: type[Position], rules) -> DataFrame:
    """The first state of every position: ``until`` is its closing row, ``at`` the last row it has passed."""
    rows = positions.select(
        "symbol", F.col("ticket").cast("long"), F.coalesce(F.col("close_row").cast("long"), F.lit(END)).alias("until"),
        F.col("start_row").cast("long").alias("at"), F.col("direction").cast("double"), "entry_price",
        (F.unix_micros("entry_time") / 1e6).alias("opened"), "lots", "stop_loss", "trend_alignment",
    ).where("until > at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            terms = ["direction", "entry_price", "opened", "lots", "stop_loss", "trend_alignment"]
            states = [make(rules, *x).state() for x in b[terms].itertuples(index=False, name=None)]
            yield b[["symbol", "ticket", "until", "at"]].assign(state=states)

    return rows.mapInPandas(run, OPEN)


def _dealt(rows: DataFrame, keys: list[str], others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows dealt into ``part`` of each key with about ``POSITIONS_PER_GROUP`` each, and ``others`` copied to every part."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / POSITIONS_PER_GROUP).cast("int").alias("_parts"))
    dealt = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("ticket"), F.col("_parts")).cast("int")).drop("_parts")
    copied = others.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt, copied


def _walk_all(positions: DataFrame, ticks: DataFrame, make: type[Position], rules, block_ticks: int) -> DataFrame:
    """Rounds of passing quiet blocks and walking the next busy one, until no position is open."""
    block = F.floor(F.col("row_idx") / block_ticks).cast("long")
    quotes = materialize(
        ticks.select("symbol", "row_idx", "bid", "ask", (F.unix_micros("ts") / 1e6).alias("now"), block.alias("block")), "exit-ticks"
    )
    quoted = quotes.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    extremes = [f(c).alias(f"{c}_{n}") for c in ("bid", "ask", "mid") for n, f in (("low", F.min), ("high", F.max))]
    summary = materialize(quoted.groupBy("symbol", "block").agg(F.max("row_idx").alias("last"), *extremes), "tick-extremes")

    def skip(open_rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", ignore_index=True)
        number = blocks["block"].to_numpy()
        prices = {(side, end): make.prices(blocks, side, end) for side in (1, -1) for end in ("worst", "best")}
        out = []
        for symbol, ticket, until, at, state in open_rows[["symbol", "ticket", "until", "at", "state"]].itertuples(index=False, name=None):
            position = make.at(rules, state)
            first = int(np.searchsorted(number, (at + 1) // block_ticks))
            last = int(np.searchsorted(number, until // block_ticks, side="right"))
            if first < last and (at + 1) % block_ticks:
                # The rest of a block begun is walked: its extremes may lie before the position.
                k = first
            else:
                k = first + position.first_busy(prices[position.side, "worst"][first:last], prices[position.side, "best"][first:last])
            if k < last:
                out.append((symbol, ticket, until, at, position.state(), int(number[k])))
        return pd.DataFrame(out, columns=["symbol", "ticket", "until", "at", "state", "block"])

    def walk(open_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_idx", ignore_index=True)
        index, end = rows["row_idx"].to_numpy(), int(rows["row_idx"].iloc[-1])
        bid, ask, now = (rows[c].tolist() for c in ("bid", "ask", "now"))
        out = []
        for symbol, ticket, until, at, state in open_rows[["symbol", "ticket", "until", "at", "state"]].itertuples(index=False, name=None):
            position, closed = make.at(rules, state), False
            for k in range(int(np.searchsorted(index, at, side="right")), int(np.searchsorted(index, until, side="right"))):
                action, price, pnl = position.tick(bid[k], ask[k], now[k])
                if action is not None:
                    name, stage, stop, lots = action
                    out.append((symbol, ticket, int(index[k]), name, stage, price, stop, lots, pnl, None, None, None))
                    if name == "FULL_CLOSE":
                        closed = True
                        break
            if not closed and until > end:
                # A block ends where the next begins, also where a series stops short of it.
                after = (end // block_ticks + 1) * block_ticks - 1
                out.append((symbol, ticket, None, None, None, None, None, None, None, until, after, position.state()))
        frame = pd.DataFrame(out, columns=[*ACTION_SCHEMA.fieldNames(), "until", "at", "state"])
        whole = {c: "Int64" for c in ("ticket", "row_idx", "until", "at")}
        return frame.astype({**whole, **{c: "float64" for c in ("price", "new_sl", "close_lots", "pnl_usd")}})

    moved_schema = OPEN + ", block long"
    walked_schema = T.StructType([
        *ACTION_SCHEMA.fields, T.StructField("until", T.LongType()), T.StructField("at", T.LongType()),
        T.StructField("state", T.ArrayType(T.DoubleType())),
    ])
    frontier, found = materialize(_opened(positions, make, rules), "open-positions"), None
    while not frontier.isEmpty():
        dealt, blocks = _dealt(frontier, ["symbol"], summary)
        by = ["symbol", "part"]
        moved = materialize(dealt.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(skip, moved_schema), "moved-positions")
        dealt, rows = _dealt(moved, ["symbol", "block"], quotes)
        by = ["symbol", "block", "part"]
        walked = materialize(dealt.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(walk, walked_schema), "walked-positions")
        actions = walked.where(F.col("action").isNotNull()).select(*ACTION_SCHEMA.fieldNames())
        found = actions if found is None else found.unionByName(actions)
        frontier = walked.where(F.col("action").isNull()).select("symbol", "ticket", "until", "at", "state")
    if found is None:
        found = positions.sparkSession.createDataFrame([], ACTION_SCHEMA)
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("new_sl", "close_lots")})


def staged_exits(positions: DataFrame, ticks: DataFrame, rules: ExitRules = ExitRules(), block_ticks: int = BLOCK_TICKS) -> DataFrame:
    """Actions of the net-profit rules: stop, partial close, break-even, trailing.

    Positions are open from the tick after ``start_row`` to ``close_row``, or to the end of the series without one.
    """
    return _walk_all(positions, ticks, NetExit, rules, block_ticks)


def staged_exits_mid(positions: DataFrame, ticks: DataFrame, rules: MidExitRules = MidExitRules(), block_ticks: int = BLOCK_TICKS) -> DataFrame:
    """Actions of the older mid-price rules."""
    return _walk_all(positions, ticks, MidExit, rules, block_ticks)
