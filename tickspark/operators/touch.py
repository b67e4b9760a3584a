"""First bar that reaches a level, at any distance, over a tree of block extremes.

Bars are summarised in blocks of ``fan`` rows, the blocks in blocks of ``fan`` blocks, and so on; a node holds
the lowest low and the highest high of each of its children.  A level climbs from its start until a node has a
child that reaches it, and then descends to the bar.  Each step is one equi-join on (series, node), so a level
takes at most twice the height of the tree in rows read, however far its touch lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 1024
#: Height without ``max_age``: 1024 ** 4 rows per series.
HEIGHT = 4
#: Places a node above the first level is dealt to, as levels that stay unreached for long share it.
PLACES = 16


def _reached(side: Column, level: Column, child: Column) -> Column:
    return F.when(side == 1, child["low"] <= level).otherwise(child["high"] >= level)


def _height(max_age: int | None, fan: int) -> int:
    """Levels to climb until at least ``max_age`` rows after the start have been seen."""
    if max_age is None:
        return HEIGHT
    height, seen = 1, 1
    while seen < max_age and height < HEIGHT:
        seen += fan ** height
        height += 1
    return height


def _tree(bars: DataFrame, by: Sequence[str], idx: str, height: int, fan: int) -> list[DataFrame]:
    """Per level the nodes with their children (number, low, high)."""
    below = bars.select(*by, F.col(idx).cast("long").alias("_child"), F.col("low"), F.col("high"))
    out = []
    for _ in range(height):
        nodes = below.groupBy(*by, F.floor(F.col("_child") / fan).cast("long").alias("_node")).agg(
            F.collect_list(F.struct("_child", "low", "high")).alias("_children"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        out.append(nodes.select(*by, "_node", "_children"))
        below = nodes.select(*by, F.col("_node").alias("_child"), "low", "high")
    return out


def first_touch(
    levels: DataFrame, bars: DataFrame, by: Sequence[str] = ("symbol",), after: str = "gap_idx",
    side: str = "side", level: str = "level", idx: str = "bar_idx", max_age: int | None = None, fan: int = FAN,
    name: str = "touch_idx",
) -> DataFrame:
    """Add ``name``: the first ``idx`` after ``after`` whose low is at or below (``side`` 1) or high at or above
    (any other side) ``level``; null where no bar does.

    With ``max_age`` only bars with ``idx - after <= max_age`` count.  ``idx`` need not be dense.  A null level,
    start, low or high is never reached; a repeated ``idx`` counts once; a series without bars gives nulls.
    ``bars`` needs ``by``, ``idx``, ``low`` and ``high``; columns of ``levels`` pass through.
    """
    by = list(by)
    height = _height(max_age, fan)
    tree = _tree(bars, by, idx, height, fan)
    # _at is the level of the tree where the touch is known to lie (0: the bar), null while climbing;
    # _pos is the child to go on from, or the child that holds the touch.
    rows = levels.withColumns(
        {"_at": F.lit(None).cast("int"), "_pos": (F.col(after) + 1).cast("long"),
         "_place": F.pmod(F.coalesce(F.col(after), F.lit(0)).cast("long"), F.lit(PLACES)).cast("int")}
    )

    def step(rows: DataFrame, l: int, active: Column, node: Column, from_pos: bool) -> DataFrame:
        nodes = tree[l - 1]
        keys = [*by, "_node"]
        if l > 1:
            nodes = nodes.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
            keys.append("_place")
        # Rows that rest carry a number no node has, spread over the tasks.
        keyed = rows.withColumn(
            "_node", F.coalesce(F.when(active, node), -1 - F.pmod(F.xxhash64(after), F.lit(4096)))
        )

        def hit(child: Column) -> Column:
            found = _reached(F.col(side), F.col(level), child)
            return found & (child["_child"] >= F.col("_pos")) if from_pos else found

        found = F.array_min(F.transform(F.filter("_children", hit), lambda c: c["_child"]))
        joined = keyed.join(nodes, keys, "left").withColumn("_found", F.when(active, found)).drop("_children")
        rest = F.when(active, F.col("_node") + 1).otherwise(F.col("_pos")) if from_pos else F.col("_pos")
        return joined.withColumns(
            {
                "_at": F.when(F.col("_found").isNotNull(), F.lit(l - 1)).otherwise(F.col("_at")),
                "_pos": F.coalesce(F.col("_found"), rest),
            }
        ).drop("_found", "_node")

    for l in range(1, height + 1):
        climbing = F.col("_at").isNull() & F.col("_pos").isNotNull()
        rows = step(rows, l, climbing, F.floor(F.col("_pos") / fan).cast("long"), True)
    for l in range(height - 1, 0, -1):
        rows = step(rows, l, F.col("_at") == l, F.col("_pos"), False)
    hit = F.col("_at") == 0
    if max_age is not None:
        hit = hit & (F.col("_pos") - F.col(after) <= max_age)
    return rows.withColumn(name, F.when(hit, F.col("_pos"))).drop("_at", "_pos", "_place")
