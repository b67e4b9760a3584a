"""Packing documents into sequences of fixed length by linear grouping.

A piece is a document's tokens with the end id, or a part of a longer document.  Lengths are whole
numbers up to the capacity, so a plan needs only their histogram, whatever the number of pieces:

1. Large lengths, in descending order, are cut into groups of equal cardinality and rounded up to the
   longest of their group, which leaves few sizes.
2. Fillings of a sequence with these sizes are optimised as a linear program by column generation
   (a knapsack over the capacity proposes the next filling); the fractions left after rounding down
   are packed by best fit.
3. Real pieces take the places of the rounded ones, a group's longest first, which frees room.
4. Small pieces, longest first, go where they leave the least room; new sequences are opened when
   none fits.

The plan is a list of runs: consecutive pieces, in the order of their length, go to consecutive
sequences at one offset.  Spark numbers the pieces in that order and looks each one up.

Null and empty texts are the end id alone.  Repeated rows are packed each; equal lengths are ordered by
id, piece and checksum.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import number_rows, read
from tickspark.llm.tokens import encoder
from tickspark.session import materialize

CAPACITY = 2048
END = 0
#: Groups of large lengths.
GROUPS = 48
#: The capacity divided by these is tried as the longest small length; the plan of fewest sequences is used.
SMALL_PARTS = (8, 4, 2)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    Only documents longer than ``capacity`` are cut; the first piece takes what is over.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, False)
        for b in batches:
            rows = []
            for doc_id, raw in zip(b["doc_id"].astype("Int64"), encode.all(b["text"]), strict=True):
                ids = np.append(np.frombuffer(raw, np.uint16), END).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, (a, e) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    raw = ids[a:e].tobytes()
                    rows.append((doc_id, k, a, e - a, zlib.crc32(raw), *([ids[a:e].astype(np.int64)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES + (", ids array<long>" if with_ids else ""))


class Plan:
    """Runs of (first row, rows, first sequence, offset); rows are numbered by ascending length."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.lengths = sorted(histogram)
        self.count = {s: histogram[s] for s in self.lengths}
        self.first = dict(zip(self.lengths, np.cumsum([0, *(histogram[s] for s in self.lengths)]).tolist(), strict=False))
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int]] = []
        #: Room left to ranges of sequences (first, number).
        self.room: dict[int, list[list[int]]] = {}
        self.rooms: list[int] = []

    def _give(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.room:
                self.room[room] = []
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.room[room].append([first, n])

    def _take(self, room: int, n: int) -> Iterator[tuple[int, int]]:
        """Up to ``n`` sequences with this room, as ranges."""
        stock = self.room[room]
        while n and stock:
            first, have = stock[-1]
            got = min(n, have)
            if got == have:
                stock.pop()
            else:
                stock[-1] = [first + got, have - got]
            n -= got
            yield first, got
        if not stock:
            del self.room[room]
            self.rooms.remove(room)

    def best_fit(self, length: int, row: int, n: int) -> None:
        """Place ``n`` pieces of one length, rows from ``row`` on, where they leave the least room."""
        while n:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                fit = self.capacity // length
                opened = -(-n // fit)
                self._give(self.capacity, self.sequences, opened)
                self.sequences += opened
                continue
            room = self.rooms[k]
            fit = room // length
            here = sum(m for _, m in self.room[room])
            each, number = (fit, min(here, n // fit)) if n >= fit else (n, 1)
            for first, got in self._take(room, number):
                for turn in range(each):
                    self.runs.append((row, got, first, self.capacity - room + turn * length))
                    row += got
                    n -= got
                self._give(room - each * length, first, got)

    def fill(self, slots: list[tuple[int, int]], number: int) -> None:
        """Open ``number`` sequences; slot (row, step) takes rows row, row-1, ... one per sequence."""
        cuts = {0, number}
        for row, _ in slots:
            # Rows row-number+1 .. row; a cut where the length changes.
            for s in self._lengths_between(row - number + 1, row):
                cuts.add(min(max(0, row - self.first[s] + 1), number))
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:], strict=False):
            used = 0
            for row, _ in slots:
                # Rows descend as sequences ascend, so a run of equal lengths is turned round.
                low = row - b + 1
                self.runs.append((low, b - a, self.sequences + a, used))
                used += self.length_of(low)
            self._give(self.capacity - used, self.sequences + a, b - a)
        self.sequences += number

    def length_of(self, row: int) -> int:
        return self.lengths[int(np.searchsorted(self._starts, row, side="right")) - 1]

    @property
    def _starts(self) -> np.ndarray:
        return np.array([self.first[s] for s in self.lengths])

    def _lengths_between(self, low: int, high: int) -> list[int]:
        a = int(np.searchsorted(self._starts, low, side="right")) - 1
        b = int(np.searchsorted(self._starts, high, side="right")) - 1
        return self.lengths[a : b + 1]


def fillings(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fillings of a sequence and how often to use each, for least sequences (Gilmore and Gomory)."""
    g = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    amount = np.linalg.solve(basis, demand.astype(float))
    for _ in range(60 * g):
        price = np.linalg.solve(basis.T, np.ones(g))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            value = np.where(sizes <= c, best[c - np.minimum(sizes, c)] + price, -1.0)
            k = int(value.argmax())
            best[c], choice[c] = (value[k], k) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(g), capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        change = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, amount / change, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    return [(basis[:, k].astype(int), float(amount[k])) for k in range(g)]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PARTS[0]) -> Plan:
    """The plan for a histogram of lengths."""
    plan = Plan(histogram, capacity)
    small = capacity // small_part
    large = [s for s in plan.lengths if s > small]
    if large:
        total = sum(plan.count[s] for s in large)
        top = plan.first[large[-1]] + plan.count[large[-1]]
        # Group k has the rows edges[k+1] .. edges[k]-1, longest first.
        edges = sorted({top - total * k // groups for k in range(groups + 1)}, reverse=True)
        next_row: dict[int, list[list[int]]] = {}
        for high, low in zip(edges, edges[1:], strict=False):
            next_row.setdefault(plan.length_of(high - 1), []).append([high - 1, high - low])
        sizes = np.array(sorted(next_row, reverse=True))
        demand = np.array([sum(n for _, n in next_row[s]) for s in sizes])
        # Groups of one size are one stretch of rows.
        cursor = {s: max(r for r, _ in next_row[s]) for s in sizes.tolist()}
        left = dict(zip(sizes.tolist(), demand.tolist(), strict=True))
        for column, amount in fillings(sizes, demand, capacity):
            number = int(amount + 1e-6)
            for s, a in zip(sizes.tolist(), column.tolist(), strict=True):
                if a:
                    number = min(number, left[s] // a)
            if number <= 0:
                continue
            slots = []
            for s, a in zip(sizes.tolist(), column.tolist(), strict=True):
                for _ in range(a):
                    slots.append((cursor[s], number))
                    cursor[s] -= number
                left[s] -= a * number
            plan.fill(slots, number)
        for s in sizes.tolist():
            while left[s]:
                length = plan.length_of(cursor[s])
                n = min(left[s], cursor[s] - plan.first[length] + 1)
                plan.best_fit(length, cursor[s] - n + 1, n)
                cursor[s] -= n
                left[s] -= n
    for s in reversed(plan.lengths):
        if s <= small:
            plan.best_fit(s, plan.first[s], plan.count[s])
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small_parts: tuple[int, ...] = SMALL_PARTS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; lengths must be 1 .. ``capacity``.

    The driver gets the histogram (one row per length).  The plan has a few runs per pair of length and
    free room at most, so its size depends on the capacity and not on the number of pieces.
    """
    numbered = number_rows(cut, "length", "doc_id", "piece", "ids_crc32")
    histogram = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}
    plan = min((make_plan(histogram, capacity, groups, k) for k in small_parts), key=lambda p: p.sequences)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 4)

    @F.pandas_udf("sequence_id long, offset long")
    def place(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for row in rows:
            k = np.searchsorted(runs[:, 0], row, side="right") - 1
            yield pd.DataFrame({"sequence_id": runs[k, 2] + row.to_numpy() - runs[k, 0], "offset": runs[k, 3]})

    placed = numbered.withColumn("_at", place("row_no"))
    return placed.select(*cut.columns, "_at.sequence_id", "_at.offset")


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from packed pieces with ``ids``; a sequence holds ``capacity`` pieces at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def tokenizer_path() -> str:
    """The installed byte-pair vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents, written once, with their places."""
    return pack(materialize(pieces(docs, path), "pieces"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces."""
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents packed; the columns are those of the pieces."""
    return pack_documents(docs, tokenizer_path())
