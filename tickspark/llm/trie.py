"""Prefix trie of conversations: what they share from their first turn on.

A node is a distinct sequence of first turns.  Conversations are cut into blocks of 16 turns, so that no row grows
with a conversation; a block carries a 128-bit fingerprint of all turns before it and the id of one turn behind
it.  Blocks are sharded by range of (block, fingerprint, turn ids, conversation), so that conversations
with equal first turns lie side by side whatever their number.  A shard is one padded matrix of turn ids: numpy
sorts its rows, compares each with the row before, and the changes accumulated by OR along the columns mark
where the nodes of every depth begin; ``reduceat`` over these marks gives each node's numbers.  The last row
before a shard and the first one behind it are known, so nodes that cross an edge are found: their parts
are added up afterwards.

Sums over a subtree are sums over its members, because each distinct node is counted with the one member at
which it begins.  For blocks further down these counts are handed up along the conversations first.

Turns are ordered by ``turn`` (null first), equal ones by a digest of role and text.  Null role or text counts
as empty.  Repeated rows are turns of their own.  Rows without ``conv_id`` are one conversation without id that
takes no turns from another: it counts as a member, but its id is null where it is the only member and is
left out of the list of ends; the largest long stands for it inside and must not be an id.  Very long texts
enter by digest and size, very long conversations by blocks.  Other columns are not read.  An empty table has
no nodes.  Equal 128-bit hashes of different turns are taken not to occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickspark.llm.common import number_rows, read
from tickspark.session import materialize

#: Turns of a block.
BLOCK = 16
#: Rows (blocks of conversations) of a shard; its matrix takes about 300 bytes for each.
SHARD_ROWS = 40_000
#: Rows of one conversation that a join or a window gets together.
SLICE_ROWS = 1 << 16
#: Blocks of one conversation that a window gets together.
RUN_BLOCKS = 1 << 12
#: Conversations with neighbouring ids that share their beginnings, and how many lengths these have.
FAMILY, SHARED = 5, 9
NONE = (1 << 63) - 1


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, at, digest, n_bytes`` of every turn, ``at`` from 0, and ``conv, n`` of every conversation.

    Turns get global numbers by a range shuffle; a conversation of any size spreads over slices of numbers.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    narrow = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv"), "turn", F.unhex(own).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = number_rows(narrow, "conv", "turn", "digest").withColumn("slice", F.floor(F.col("row_no") / SLICE_ROWS))
    slices = rows.groupBy("conv", "slice").agg(F.min("row_no").alias("lo"), F.count(F.lit(1)).alias("n"))
    convs = slices.groupBy("conv").agg(F.min("lo").alias("first"), F.sum("n").alias("n"))
    first = slices.select("conv", "slice").join(convs.select("conv", "first"), "conv")
    turns = rows.join(first, ["conv", "slice"]).select("conv", (F.col("row_no") - F.col("first")).alias("at"), "digest", "n_bytes")
    return materialize(turns, "turns"), materialize(convs.select("conv", "n"), "conversations")


def rebuild(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """``conv, pos, digest, n_bytes`` and ``conv, n_turns`` of conversations that begin like the first of their family.

    Conversation c takes the first ``h`` turns of c - c % family and goes on with its own behind its first ``h``;
    ``h`` is the crc32 of its decimal id modulo ``shared``.
    """
    turns, convs = numbered_turns(conversations)
    c = F.col("conv")
    plan = convs.select(
        "conv", "n", F.when(c == NONE, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % shared).alias("h"),
        F.when(c != NONE, c - c % family).alias("base"),
    ).join(convs.select(c.alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = materialize(plan.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))), "families")
    # Turns of one conversation come in slices; the plan is joined to slices, not to all of its turns at once.
    cut = turns.withColumn("slice", F.floor(F.col("at") / SLICE_ROWS))
    wide = plan.select("conv", "h", "head", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / SLICE_ROWS))).alias("slice"))
    own = cut.join(wide, ["conv", "slice"]).where("at >= h").select(
        "conv", (F.col("head") + F.col("at") - F.col("h")).alias("pos"), "digest", "n_bytes"
    )
    heads = turns.where(F.col("at") < shared - 1).withColumnRenamed("conv", "base")
    taken = heads.join(plan.select("conv", "base", "head"), "base").where("at < head").select(
        "conv", F.col("at").alias("pos"), "digest", "n_bytes"
    )
    sizes = plan.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return own.unionByName(taken), sizes


def along(df: DataFrame, values: dict[str, tuple[str, str]], backwards: bool = False) -> DataFrame:
    """Add sums (``sum``) or parities (``xor``) over the blocks of a conversation before each one, or behind it.

    Blocks are reduced by runs first, so one conversation is never in one window as a whole.
    """
    function = {"sum": F.sum, "xor": F.bit_xor}
    combine = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    sign = -1 if backwards else 1
    df = df.withColumn("_run", F.floor(F.col("block") / RUN_BLOCKS))
    before = W.partitionBy("conv").orderBy(F.col("_run") * sign).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("conv", "_run").orderBy(F.col("block") * sign).rowsBetween(W.unboundedPreceding, -1)
    runs = df.groupBy("conv", "_run").agg(*[function[f](c).alias(f"_p_{o}") for o, (f, c) in values.items()])
    runs = runs.select("conv", "_run", *[F.coalesce(function[f](f"_p_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o, (f, _) in values.items()])
    out = df.join(runs, ["conv", "_run"]).withColumns({
        o: combine[f](F.col(f"_c_{o}"), F.coalesce(function[f](c).over(inside), F.lit(0))) for o, (f, c) in values.items()
    })
    return out.drop("_run", *[f"_c_{o}" for o in values])


def blocks(turns: DataFrame, sizes: DataFrame, size: int = BLOCK) -> DataFrame:
    """``conv, block, n_turns, key, sizes, rest``: a row per conversation and block of turns.

    ``key`` is the block's number, the fingerprint of all turns before it (two longs), and two longs for each of
    its turns and for the next one.  ``rest`` counts the bytes from the block on.  A conversation that
    ends with a block has an empty one behind it, as a member of the node that block starts from.
    """
    pos = F.col("pos")
    own = F.floor(pos / size)
    cells = turns.select(
        "conv", pos, "n_bytes", F.xxhash64(F.lit(1), pos, "digest").alias("a"), F.xxhash64(F.lit(2), pos, "digest").alias("b"),
        F.explode(F.when((pos % size == 0) & (pos > 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("block"),
    )
    inside = F.floor(F.col("pos") / size) == F.col("block")
    rows = cells.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n_bytes"))).alias("cells"),
        F.bit_xor(F.when(inside, F.col("a"))).alias("x"), F.bit_xor(F.when(inside, F.col("b"))).alias("y"),
        F.sum(F.when(inside, F.col("n_bytes"))).alias("z"),
    ).join(sizes, "conv")
    zero = F.lit(0).cast("long")
    empty = sizes.where(F.col("n_turns") % size == 0).select(
        "conv", F.floor(F.col("n_turns") / size).alias("block"),
        F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,n_bytes:bigint>>").alias("cells"),
        zero.alias("x"), zero.alias("y"), zero.alias("z"), "n_turns",
    )
    rows = materialize(rows.unionByName(empty), "blocks")
    several = F.col("n_turns") >= size
    single = rows.where(~several).withColumns({"fx": zero, "fy": zero, "behind": zero})
    longer = along(rows.where(several), {"fx": ("xor", "x"), "fy": ("xor", "y")})
    longer = along(longer, {"behind": ("sum", "z")}, backwards=True)
    all_rows = single.unionByName(longer)
    key = F.flatten(F.transform("cells", lambda t: F.array(t["a"], t["b"])))
    return all_rows.select(
        "conv", "block", "n_turns", F.concat(F.array("block", "fx", "fy"), key).alias("key"),
        F.transform("cells", lambda t: t["n_bytes"]).alias("sizes"), (F.col("z") + F.col("behind")).alias("rest"),
    )


def sharded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the number ``part`` of their shard, and the keys before and behind each shard.

    Shards are ranges of (key, conv) and are written, so they stay what they are when a task is repeated.
    """
    spark = rows.sparkSession
    parts = max(-(-rows.count() // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, "key", "conv").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "shards")
    ends = placed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    w = W.orderBy("part")
    return placed, ends.select("part", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))


class Shard:
    """The padded matrix of one shard, sorted, with the marks of its nodes."""

    def __init__(self, rows: pa.Table, edge: pa.Table, size: int = BLOCK) -> None:
        self.size = size
        get = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        keys, cells = get["key"], get["sizes"]
        at = keys.offsets.to_numpy().astype(np.int64)
        n, turns = len(keys), (np.diff(at) - 3) // 2
        flat = keys.values.to_numpy()
        head = flat[at[:-1, None] + np.arange(3)]
        column = np.arange(size + 1)
        present = column < turns[:, None]
        ids = np.zeros((n, size + 1, 2), np.uint64)
        # Unsigned in the order of signed numbers, so that padding comes first.
        where = (at[:-1, None] + 3 + 2 * column)[present]
        ids[present] = (flat[where[:, None] + np.arange(2)] ^ np.int64(-(1 << 63))).view(np.uint64)
        size_at = cells.offsets.to_numpy().astype(np.int64)
        n_bytes = np.zeros((n, size + 1), np.int64)
        n_bytes[present] = cells.values.to_numpy()[(size_at[:-1, None] + column)[present]]
        conv = get["conv"].to_numpy()
        order = np.lexsort((conv, *(ids[:, k, lane] for k in range(size, -1, -1) for lane in (1, 0)), head[:, 2], head[:, 1], head[:, 0]))
        self.conv, self.head, self.ids, self.turns = conv[order], head[order], ids[order], turns[order]
        self.block, self.n_bytes = self.head[:, 0], n_bytes[order, :size]
        self.n_turns, self.rest = get["n_turns"].to_numpy()[order], get["rest"].to_numpy()[order]
        #: Column 0 is the node from which the block starts.
        self.present = np.concatenate([np.ones((n, 1), bool), present[order]], axis=1)
        changed = np.ones((n + 1, size + 2), bool)
        changed[1:n, 0] = (self.head[1:] != self.head[:-1]).any(1)
        changed[1:n, 1:] = (self.ids[1:] != self.ids[:-1]).any(2) | (self.present[1:, 1:] != self.present[:-1, 1:])
        changed[0] = self._against(edge.column("before")[0].as_py(), 0)
        changed[n] = self._against(edge.column("after")[0].as_py(), n - 1)
        self.new = np.logical_or.accumulate(changed, axis=1)
        self.start = self.new[:n] & self.present
        #: The conversation ends in this block, by `turns` of it.
        local = self.n_turns - self.block * size
        self.ends = (local <= size) & ((local > 0) | (self.block == 0))
        leaf = self.ends & self.new[1:][np.arange(n), np.minimum(self.turns, size + 1)]
        self.leaf = leaf.astype(np.int64)
        self.added = (self.n_bytes * self.start[:, 1 : size + 1]).sum(1)

    def _against(self, key: list[int] | None, row: int) -> np.ndarray:
        """Where a row differs from the key beyond the shard's edge."""
        if key is None:
            return np.ones(self.size + 2, bool)
        turns = (len(key) - 3) // 2
        present = np.arange(self.size + 1) < turns
        ids = np.zeros((self.size + 1, 2), np.uint64)
        ids[:turns] = (np.array(key[3:], np.int64) ^ np.int64(-(1 << 63))).view(np.uint64).reshape(-1, 2)
        differs = (ids != self.ids[row]).any(1) | (present != self.present[row, 1:])
        return np.concatenate([[tuple(key[:3]) != tuple(self.head[row].tolist())], differs])

    def fingerprint(self, row: int, depth: int) -> tuple[int, int]:
        """Of the first ``depth`` turns of the block, and all before."""
        turns = (self.ids[row, :depth] ^ np.uint64(1 << 63)).view(np.int64)
        x = np.bitwise_xor.reduce(np.concatenate([self.head[row, None, 1:], turns.reshape(-1, 2)]), axis=0)
        return int(x[0]), int(x[1])

    def nodes(self, below: np.ndarray, leaves_below: np.ndarray) -> Iterator[dict]:
        """Columns of the nodes that begin or go on in this shard, a depth of the blocks at a time."""
        n, last = len(self.conv), len(self.conv) - 1
        added, leaf = self.added + below, self.leaf + leaves_below
        so_far = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(self.n_bytes, axis=1)], axis=1)
        fresh = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(self.n_bytes * self.start[:, 1 : self.size + 1], axis=1)], axis=1)
        above = None
        for depth in range(self.size + 1):
            mark = self.new[:n, depth].copy()
            mark[0] = True
            lo = np.flatnonzero(mark)
            count = np.diff(np.append(lo, n))
            low = np.minimum.reduceat(self.conv, lo)
            before, ending = ~self.new[lo, depth], np.zeros(len(lo), bool)
            ending[-1] = not self.new[n, depth]
            open_ = before | ending
            end_rows = self.ends & (self.turns == depth)
            n_ends = np.add.reduceat(end_rows.astype(np.int64), lo)
            outer = max(depth - 1, 0)
            distinct = np.add.reduceat(added, lo) - np.where(before, 0, fresh[lo, outer])
            saved = np.add.reduceat(self.rest, lo) - count * so_far[lo, outer] - distinct
            children = np.add.reduceat(self.start[:, depth + 1].astype(np.int64), lo)
            # A node from which a later block starts is made by the block before; here it only names a parent.
            stem = (depth == 0) & (self.block[lo] > 0)
            use = np.flatnonzero(self.present[lo, depth] & (~stem | open_))
            parent = np.searchsorted(above[0], lo, side="right") - 1 if depth else None
            names = [self.fingerprint(int(lo[k]), depth) if open_[k] else (0, 0) for k in range(len(lo))] if open_.any() else [(0, 0)] * len(lo)
            ends = [
                ",".join(map(str, c[c != NONE].tolist())) if k else ""
                for c, k in ((self.conv[lo[i] : lo[i] + n_ends[i]], n_ends[i]) for i in use)
            ]
            yield {
                "depth": self.block[lo[use]] * self.size + depth, "conv_id": low[use],
                "parent_conv_id": above[1][parent[use]] if depth else np.full(len(use), NONE),
                "n_convs": count[use], "n_children": children[use], "n_leaves": np.add.reduceat(leaf, lo)[use], "saved_tokens": saved[use],
                "ends": [e if o else None for e, o in zip(ends, open_[use], strict=True)],
                "ends_sha256": [None if o else hashlib.sha256(e.encode()).hexdigest() for e, o in zip(ends, open_[use], strict=True)],
                "is_open": open_[use], "stem": stem[use], "x": [names[i][0] for i in use], "y": [names[i][1] for i in use],
                "parent_open": above[2][parent[use]] if depth else np.zeros(len(use), bool),
                "px": [above[3][i][0] for i in parent[use]] if depth else [0] * len(use),
                "py": [above[3][i][1] for i in parent[use]] if depth else [0] * len(use),
            }
            above = (lo, low, open_, names)


CARRIED = "conv long, block long, added long, leaf long"
NODES = (
    "part int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, ends_sha256 string, is_open boolean, stem boolean, x long, y long, parent_open boolean, px long, py long"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _carried(rows: pa.Table, edge: pa.Table) -> pa.Table:
    s = Shard(rows, edge)
    return pa.table({"conv": s.conv, "block": s.block, "added": s.added, "leaf": s.leaf})


def _nodes(rows: pa.Table, edge: pa.Table) -> pa.Table:
    s = Shard(rows, edge)
    # The counts from further down come in the order of the rows.
    by_row = {(c, b): k for k, (c, b) in enumerate(zip(rows["conv"].to_pylist(), rows["block"].to_pylist(), strict=True))}
    order = np.array([by_row[c, b] for c, b in zip(s.conv.tolist(), s.block.tolist(), strict=True)])
    below, leaves = rows["below"].to_numpy()[order], rows["leaves_below"].to_numpy()[order]
    kinds = {"ends": pa.string(), "ends_sha256": pa.string(), "is_open": pa.bool_(), "stem": pa.bool_(), "parent_open": pa.bool_()}
    part = rows["part"][0].as_py()
    tables = []
    for columns in s.nodes(below, leaves):
        if len(columns["depth"]):
            arrays = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()}
            tables.append(pa.table({"part": pa.array([part] * len(columns["depth"]), pa.int32()), **arrays}))
    if tables:
        return pa.concat_tables(tables)
    empty = {c.split()[0]: c.split()[1] for c in NODES.split(", ")}
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.table({c: pa.array([], types[t]) for c, t in empty.items()})


def chained_sha256(parts: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``key, ends_sha256``: the hash of each key's non-empty values, in order and joined by commas.

    A hash is made in sequence by definition; values are long strings already joined, and pass in a stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, empty = None, hashlib.sha256(), True
        for b in batches:
            out = []
            for *k, text in b[[*key, value]].itertuples(index=False):
                if held is not None and k != held:
                    out.append((*held, state.hexdigest()))
                    state, empty = hashlib.sha256(), True
                held = k
                if text:
                    state.update((("" if empty else ",") + text).encode())
                    empty = False
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if held is not None:
            yield pd.DataFrame([(*held, state.hexdigest())], columns=[*key, "ends_sha256"])

    kind = ", ".join(f"{k} long" for k in key) + ", ends_sha256 string"
    together = parts.select(*key, order, value).repartition(*key).sortWithinPartitions(*key, order)
    return together.drop(order).mapInPandas(run, kind)


def or_null(c: str) -> Column:
    return F.when(F.col(c) != NONE, F.col(c)).alias(c)


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv, pos, digest, n_bytes`` and ``conv, n_turns``."""
    zero = F.lit(0).cast("long")
    rows = materialize(blocks(turns, sizes), "keyed-blocks")
    deep, edges = sharded(rows.where("block > 0"))
    found = deep.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_carried, CARRIED)
    # Every later block of a conversation hands its counts up to all blocks before it, also to the first.
    several = rows.where(F.col("n_turns") >= BLOCK).select("conv", "block").join(found, ["conv", "block"], "left").fillna(0)
    handed = along(several, {"below": ("sum", "added"), "leaves_below": ("sum", "leaf")}, backwards=True)
    handed = rows.where(F.col("n_turns") >= BLOCK).join(handed.select("conv", "block", "below", "leaves_below"), ["conv", "block"])
    single = rows.where(F.col("n_turns") < BLOCK).withColumns({"below": zero, "leaves_below": zero})
    shards, edges = sharded(single.unionByName(handed))
    nodes = materialize(shards.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_nodes, NODES), "trie")

    name = ["depth", "x", "y"]
    parts = nodes.where("is_open")
    smallest = materialize(parts.groupBy(*name).agg(F.min("conv_id").alias("parent")), "parents")
    own = parts.where("not stem")
    whole = own.groupBy(*name).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.first("px").alias("px"), F.first("py").alias("py"),
    )
    whole = whole.join(chained_sha256(own, name, "part", "ends"), name)
    above = smallest.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), "parent")
    crossing = whole.join(above, ["depth", "px", "py"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent", F.lit(NONE))).otherwise(NONE)
    )
    # Children of a crossing node meet its row once per shard, so the root's many children do not meet in one task.
    per_part = parts.select("part", *name).distinct().join(smallest, name).select(
        "part", (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), "parent"
    )
    closed = nodes.where("not is_open")
    under = closed.where("parent_open").join(per_part, ["part", "depth", "px", "py"]).withColumn("parent_conv_id", F.col("parent"))
    found = closed.where("not parent_open").select(*RESULT).unionByName(under.select(*RESULT)).unionByName(crossing.select(*RESULT))
    return found.withColumns({"conv_id": or_null("conv_id"), "parent_conv_id": or_null("parent_conv_id")})


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuild(read(spark, sf_dir, "conversations")))


#: Nodes by their whole sequence; each distinct node is counted with its smallest member.
OP13_SQL = f"""
with crc_table as (
  select i, list_reduce(list_prepend(cast(i as bigint), range(8)),
                        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256)) as i)
), crc as (select list(v order by i) as steps from crc_table),
t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first) - 1 as at
  from conversations
), convs as (
  select conv_id, n,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
                         lambda c, k: xor(c >> 8, steps[xor(c & 255, k) + 1])), 4294967295) % {SHARED} as h
  from (select conv_id, count(*) as n from t group by conv_id) cross join crc
), plan as (
  select c.conv_id, c.h, c.conv_id - c.conv_id % {FAMILY} as base, least(c.h, coalesce(b.n, 0)) as head, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) as m
  from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % {FAMILY}
), r as (
  select p.conv_id, t.at as pos, t.role, t.text from plan p join t on t.conv_id = p.base and t.at < p.head
  union all
  select p.conv_id, p.head + t.at - p.h, t.role, t.text from plan p join t on t.conv_id = p.conv_id and t.at >= p.h
), k as (
  select conv_id, pos + 1 as depth, octet_length(encode(text)) as b,
         string_agg(md5(strlen(role) || ':' || role || text), '' order by pos) over (partition by conv_id order by pos) as name
  from r
), s as (
  select conv_id, depth, b, md5(name) as name from k union all select conv_id, 0, 0, '' from plan
), node as (
  select depth, name, min(conv_id) as conv_id, count(*) as n_convs, max(b) as b,
         count(*) filter (where m > s.depth) = 0 as leaf,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where m = s.depth), '')) as ends_sha256
  from s join (select conv_id, m from plan) using (conv_id) group by depth, name
), w as (
  select s.conv_id, s.depth, s.name, case when n.conv_id = s.conv_id then (n.n_convs - 1) * n.b else 0 end as saved,
         case when n.conv_id = s.conv_id and n.leaf then 1 else 0 end as leaf, n.conv_id = s.conv_id as own
  from s join node n using (depth, name)
), up as (
  select conv_id, depth, name, sum(saved) over below as saved, sum(leaf) over below as leaves,
         lead(own) over (partition by conv_id order by depth) as child
  from w window below as (partition by conv_id order by depth desc)
), total as (
  select depth, name, sum(saved) as saved, sum(leaves) as leaves, count(*) filter (where child) as children from up group by depth, name
), parent as (
  select n.depth, n.name, p.name as parent from node n join s using (conv_id, depth) join s p on p.conv_id = n.conv_id and p.depth = n.depth - 1
)
select n.conv_id, cast(n.depth as bigint) as depth, q.conv_id as parent_conv_id, n.n_convs, t.children as n_children,
       cast(t.leaves as bigint) as n_leaves, cast(t.saved as bigint) as saved_tokens, n.ends_sha256
from node n join total t using (depth, name) left join parent p using (depth, name)
     left join node q on q.depth = n.depth - 1 and q.name = p.parent
"""
