"""Halts of the model and of the account on streams: scores, fills and commands in one state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tickspark.operators.risk import vector_norms, with_trading_day
from tickspark.streaming.run import use_rocksdb

RANKS = {"rollover": 0, "command": 1, "fill": 2, "score": 3}  #: order of events of one moment

GUARD_SCHEMA = T.StructType(
    [
        T.StructField("account", T.StringType()), T.StructField("us", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()),
        T.StructField("is_late", T.BooleanType()), T.StructField("low_run", T.LongType()),
        T.StructField("model_halt", T.StringType()), T.StructField("daily_pnl", T.DoubleType()),
        T.StructField("consecutive_losses", T.LongType()), T.StructField("total_trades", T.LongType()),
        T.StructField("winning_trades", T.LongType()), T.StructField("risk_halt", T.StringType()),
        T.StructField("may_trade", T.BooleanType()),
    ]
)
EVENT_COLUMNS = ("us", "rank", "seq", "alert", "low", "slow", "pnl", "day_end_us", "command")
#: Waiting events, a stretch of them in each row of the state: a call per event costs more than its use.
EVENT_STATE = (
    "us array<long>, rank array<int>, seq array<long>, alert array<string>, low array<boolean>, slow array<boolean>, "
    "pnl array<double>, day_end_us array<long>, command array<string>"
)
STRETCH = 1000


def in_stretches(events: list[tuple]) -> list[tuple]:
    """Rows of :data:`EVENT_STATE` for sorted events; :func:`from_stretches` gives the events back."""
    rows = [
        (int(us), int(rank), int(seq), alert, low, slow, pnl, None if end is None else int(end), command)
        for us, rank, seq, alert, low, slow, pnl, end, command in events
    ]
    return [tuple(map(list, zip(*rows[at:at + STRETCH]))) for at in range(0, len(rows), STRETCH)]


def from_stretches(rows: Iterable[tuple]) -> list[tuple]:
    return [event for row in rows for event in zip(*row)]


@dataclass(frozen=True)
class GuardConfig:
    """Limits of the model's and the account's halts, and how long events are waited for."""

    low_score: float = 0.3
    low_run: int = 10
    max_latency_ms: float = 200.0
    max_norm: float = 100.0
    loss_limit: float = 500.0
    max_losses: int = 5
    tz: str = "UTC"
    cutoff_hours: int = 0
    wait_ms: int = 60_000


class Guard:
    """Halt state of one account, moved on by one event at a time."""

    def __init__(self, cfg: GuardConfig, state: tuple | None = None):
        self.cfg = cfg
        (
            self.run, self.model_halt, self.pnl, self.losses, self.trades, self.wins, self.risk_halt,
            self.day_end, self.used,
        ) = state or (0, None, 0.0, 0, 0, 0, None, None, None)

    def state(self) -> tuple:
        return (
            int(self.run), self.model_halt, float(self.pnl), int(self.losses), int(self.trades), int(self.wins),
            self.risk_halt, self.day_end, self.used,
        )

    def rollover(self) -> int:
        """End the trading day: its result is set back and a halt for it is lifted; a losing streak stays."""
        at, self.day_end, self.pnl = self.day_end, None, 0.0
        if self.risk_halt == "DAILY_LOSS_LIMIT":
            self.risk_halt = None
        return at

    def score(self, alert: str | None, low: bool, slow: bool) -> None:
        """A halted model is not checked; the first check that fails halts it."""
        if self.model_halt is not None:
            return
        if alert is not None:
            self.model_halt = alert
            return
        self.run = self.run + 1 if low else 0
        if self.run >= self.cfg.low_run:
            self.model_halt = "CONFIDENCE_COLLAPSE"
        elif slow:
            self.model_halt = "LATENCY_EXCEEDED"

    def fill(self, pnl: float, day_end: int) -> None:
        """Fills count while halted too, as open positions still close.

        A late fill of a day that has ended counts for the streak only, not for the result of another day.
        """
        if self.used is None or day_end > self.used:
            self.day_end = day_end if self.day_end is None else self.day_end
            self.pnl += pnl
        self.trades += 1
        won = pnl >= 0
        self.wins += won
        self.losses = 0 if won else self.losses + 1
        if self.pnl < -self.cfg.loss_limit:
            self.risk_halt = "DAILY_LOSS_LIMIT"
        if self.losses >= self.cfg.max_losses:
            self.risk_halt = "CONSECUTIVE_LOSSES"

    def command(self, name: str) -> None:
        """``unlock`` frees the model, ``resume`` the account; each does nothing where nothing is halted."""
        if name == "unlock" and self.model_halt is not None:
            self.model_halt, self.run = None, 0
        elif name == "resume" and self.risk_halt is not None:
            self.risk_halt, self.losses = None, 0

    def row(self, account: str, us: int, kind: str, seq: int | None, late: bool) -> tuple:
        return (
            account, int(us), kind, seq, late, int(self.run), self.model_halt, float(self.pnl), int(self.losses),
            int(self.trades), int(self.wins), self.risk_halt, self.model_halt is None and self.risk_halt is None,
        )


def step(guard: Guard, account: str, events: list[tuple], until: int | None = None) -> Iterator[tuple]:
    """Rows of sorted ``events``; a day that ends between them, or by ``until``, is rolled over at its end.

    An event older than one already used is late: it counts where it arrives.
    """
    kinds = {rank: kind for kind, rank in RANKS.items()}
    for us, rank, seq, alert, low, slow, pnl, day_end, command in events:
        late = guard.used is not None and us < guard.used
        if guard.day_end is not None and us >= guard.day_end:
            at = guard.rollover()
            yield guard.row(account, at, "rollover", None, False)
        kind = kinds[rank]
        if kind == "score":
            guard.score(alert, bool(low), bool(slow))
        elif kind == "fill":
            guard.fill(float(pnl), int(day_end))
        else:
            guard.command(command)
        guard.used = int(us) if guard.used is None else max(guard.used, int(us))
        yield guard.row(account, us, kind, int(seq), late)
    if until is not None and guard.day_end is not None and guard.day_end <= until:
        at = guard.rollover()
        guard.used = at if guard.used is None else max(guard.used, at)
        yield guard.row(account, at, "rollover", None, False)


class GuardProcessor(StatefulProcessor):
    """Events of one account wait ``wait_ms`` and are then used in order of time.

    One timer stands at the next moment at which something is due: the end of the wait of the oldest
    event, or of the trading day.  So a quiet account is rolled over too.
    """

    def __init__(self, cfg: GuardConfig):
        self.cfg = cfg

    def init(self, handle) -> None:
        self.handle = handle
        self.guard = handle.getValueState(
            "guard",
            "run long, model_halt string, pnl double, losses long, trades long, wins long, risk_halt string, "
            "day_end long, used long",
        )
        self.waiting = handle.getListState("waiting", EVENT_STATE)

    def handleInputRows(self, key, rows, timerValues):
        fresh = []
        for pdf in rows:
            events = pdf[list(EVENT_COLUMNS)]
            fresh += events.astype(object).where(events.notna(), None).itertuples(index=False, name=None)
        yield self._use(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._use(key, [], timerValues)

    def _use(self, key, fresh: list[tuple], timerValues) -> pd.DataFrame:
        # What is due has waited: its millisecond, with the wait, lies before the watermark.
        due = (timerValues.getCurrentWatermarkInMs() - self.cfg.wait_ms) * 1000
        pending = from_stretches(self.waiting.get()) if self.waiting.exists() else []
        pending = sorted([*pending, *fresh], key=lambda e: e[:3])
        ready = [e for e in pending if e[0] < due]
        rest = pending[len(ready):]
        guard = Guard(self.cfg, tuple(self.guard.get()) if self.guard.exists() else None)
        out = list(step(guard, key[0], ready, due - 1))
        self.guard.update(guard.state())
        if rest:
            self.waiting.put(in_stretches(rest))
        elif self.waiting.exists():
            self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        ends = [t for t in (rest[0][0] if rest else None, guard.day_end) if t is not None]
        if ends:
            self.handle.registerTimer(int(min(ends)) // 1000 + 1 + self.cfg.wait_ms)
        frame = pd.DataFrame(out, columns=GUARD_SCHEMA.fieldNames())
        for c in ("us", "seq", "low_run", "consecutive_losses", "total_trades", "winning_trades"):
            frame[c] = frame[c].astype("Int64")
        return frame

    def close(self) -> None:
        pass


def guard_events(
    scores: DataFrame, fills: DataFrame, commands: DataFrame, cfg: GuardConfig = GuardConfig(), clock: str = "clock",
) -> DataFrame:
    """The three inputs as one table of events, checked as far as a single row can be."""
    bad = F.isnull("score") | F.isnan("score") | (F.abs("score") == float("inf"))
    alert = F.when(bad, F.lit("NAN_INF"))
    if "vector" in scores.columns:
        scores = vector_norms(scores)
        broken = F.exists("vector", lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        alert = alert.when(broken, F.lit("NAN_INF")).when(F.col("norm") > cfg.max_norm, F.lit("STATE_SATURATION"))
    day_end = F.to_utc_timestamp(
        F.date_add("trading_day", 1).cast("timestamp") + F.expr(f"interval {int(cfg.cutoff_hours)} hours"), cfg.tz,
    )

    def shaped(df: DataFrame, kind: str, **values) -> DataFrame:
        none = {
            "alert": F.lit(None).cast("string"), "low": F.lit(None).cast("boolean"), "slow": F.lit(None).cast("boolean"),
            "pnl": F.lit(None).cast("double"), "day_end_us": F.lit(None).cast("long"), "command": F.lit(None).cast("string"),
        }
        return df.select(
            F.col("account").cast("string").alias("account"), F.unix_micros("ts").alias("us"),
            F.lit(RANKS[kind]).alias("rank"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"),
            *[v.alias(k) for k, v in {**none, **values}.items()], F.col(clock).alias("clock"),
        ).filter(F.col("us").isNotNull())

    scored = shaped(
        scores, "score", alert=alert, low=F.col("score") < cfg.low_score, slow=F.col("latency_ms") > cfg.max_latency_ms,
    )
    filled = with_trading_day(fills.filter(F.col("status") == "FILLED"), cfg.tz, cfg.cutoff_hours)
    pnl = F.coalesce(F.nanvl(F.col("pnl").cast("double"), F.lit(0.0)), F.lit(0.0))
    filled = shaped(filled, "fill", pnl=pnl, day_end_us=F.unix_micros(day_end))
    return scored.unionByName(filled).unionByName(shaped(commands, "command", command=F.col("command")))


def stream_guard(
    scores: DataFrame, fills: DataFrame, commands: DataFrame, cfg: GuardConfig = GuardConfig(),
    clock: str = "clock", watermark: str = "0 seconds",
) -> DataFrame:
    """State of the halts after every score, fill and command of an account, and at the end of its trading days.

    ``scores`` has account, ts, seq, score, latency_ms and perhaps vector; ``fills`` account, ts, seq, status
    and pnl; ``commands`` account, ts, seq and command (``unlock`` or ``resume``, others do nothing).  All
    have the time of receipt ``clock``, whose watermark releases events ``wait_ms`` after their own time, in order
    of time, command before fill before score.  An event that comes later than that is used on arrival and
    marked ``is_late``.  The inputs share one watermark, so rare commands hold nothing up; ``watermark`` is how
    far their times of receipt may be apart, as Spark drops a row whose ``clock`` lies behind it.

    A null score counts as NaN, a null or NaN result as 0, a null ``seq`` as -1; a null latency is not checked.
    Left out are rows without a time and fills that are not FILLED.  Rows of kind ``rollover`` have no ``seq``.
    """
    use_rocksdb(scores.sparkSession)
    rows = guard_events(scores, fills, commands, cfg, clock).withWatermark("clock", watermark)
    return rows.groupBy("account").transformWithStateInPandas(
        statefulProcessor=GuardProcessor(cfg), outputStructType=GUARD_SCHEMA, outputMode="Append", timeMode="EventTime",
    )
