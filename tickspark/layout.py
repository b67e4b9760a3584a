"""How an ordered series is cut into blocks so one hot series uses many tasks.

Every row of a bar series has a dense index (``bar_idx`` 0, 1, 2, ...).  Rows are grouped by
``(series key, index // block_rows)`` instead of by the series key alone.  An operator that
looks back ``k`` rows also needs the last ``k`` rows of the block before, so these rows are
copied into the next block (the halo) and dropped again after the window functions ran.
The result equals the one over the whole series; only the task size changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"
OWN = "_own"


@dataclass(frozen=True)
class Layout:
    """Series key, dense row index and rows per block."""

    by: tuple[str, ...] = ("symbol",)
    idx: str = "bar_idx"
    block_rows: int = 65_536

    @property
    def keys(self) -> list[str]:
        return [*self.by, BLOCK]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.idx)


BARS = Layout()
#: Ticks are a hundred times as many as bars, so their blocks are larger: the chain over the blocks
#: of one series stays a table of some ten thousand short rows for 10**9 ticks.  A worker holds a block a
#: few times over, which sets the other bound.
TICKS = Layout(idx="row_idx", block_rows=1 << 16)


def with_blocks(df: DataFrame, lookback: int, lookahead: int, layout: Layout) -> DataFrame:
    """Add block id and ownership flag, copying halo rows to the blocks that need them."""
    n = layout.block_rows
    idx = F.col(layout.idx)
    own = F.floor(idx / n).cast("long")
    if lookback == 0 and lookahead == 0:
        return df.withColumns({BLOCK: own, OWN: F.lit(True)})
    first = F.floor((idx - lookahead) / n).cast("long")
    last = F.floor((idx + lookback) / n).cast("long")
    blocks = F.sequence(F.greatest(first, F.lit(0).cast("long")), last)
    return df.withColumn(BLOCK, F.explode(blocks)).withColumn(OWN, F.col(BLOCK) == own)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(BLOCK, OWN)


class Step(NamedTuple):
    """One window operator bound to its arguments, with the rows it looks back and ahead."""

    apply: Callable[[DataFrame, WindowSpec], DataFrame]
    lookback: int
    lookahead: int


def run_blocked(df: DataFrame, steps: list[Step], layout: Layout = BARS) -> DataFrame:
    """Run several steps over one block layout: one shuffle and one sort for all of them."""
    lookback = sum(s.lookback for s in steps)
    lookahead = sum(s.lookahead for s in steps)
    out = with_blocks(df, lookback, lookahead, layout)
    for step in steps:
        out = step.apply(out, layout.window)
    return own_rows(out)


def windowed(lookback=0, lookahead=0):
    """Turn ``fn(df, window, ...)`` into an operator ``op(df, ..., layout=BARS)``.

    ``lookback``/``lookahead`` are row counts, or functions of the operator's arguments.
    ``op.step(...)`` gives the bound :class:`Step` for :func:`run_blocked`.
    """

    def decorate(fn):
        def step(*args, **kwargs) -> Step:
            def rows(spec):
                return spec(*args, **kwargs) if callable(spec) else spec

            return Step(lambda df, w: fn(df, w, *args, **kwargs), rows(lookback), rows(lookahead))

        @wraps(fn)
        def operator(df: DataFrame, *args, layout: Layout = BARS, **kwargs) -> DataFrame:
            return run_blocked(df, [step(*args, **kwargs)], layout)

        operator.step = step
        return operator

    return decorate
