"""Cost-balanced packing: descending pieces go to the sequence of least attention cost that has room.

A piece of ``n`` tokens costs ``linear * n + n * n``, the shares of the dense layers and of attention within
the piece; a sequence costs the sum over its pieces.  There are as many sequences as all tokens fill, and
what is over is spread over sequences of power-of-two length, which need no padding.  Pieces are taken in
descending order of length; each goes whole to the sequence of least cost that has room.  When none has,
the cheapest one that is not full takes the first tokens and the rest waits for its turn by length.  So nothing is
padded, and documents are cut only where they are longer than a sequence or nothing else would fill it.

The plan needs only the histogram of lengths: sequences in the same state (used, cost) are one class, and
pieces of one length go to a class together.  Its size depends on the capacity, not on the number of pieces.

Null and empty texts are the end id alone.  A null id is kept and sorts nowhere: rows are told apart by the
task and place at which they were read.  Repeated rows are packed each; equal lengths are ordered by that place.
Very long texts become full sequences and a rest.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import number_rows, read
from tickspark.llm.tokens import encoder
from tickspark.session import materialize, scratch_path

CAPACITY = 2048
END = 1
#: Cost of a token beside attention, in units of one pair of tokens: six times a hidden width of 1024.
LINEAR = 6 * 1024


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``part, seq, doc_id, n, ids`` (16-bit ids with the end id) of every document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, True).column
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = to_ids(b.column("text"), END)
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(ids), part, np.int64), "seq": np.arange(seen, seen + len(ids)), "doc_id": b.column("doc_id"),
                "n": pc.binary_length(ids).to_numpy().astype(np.int64) // 2, "ids": ids,
            })
            seen += len(ids)

    kind = "part long, seq long, doc_id long, n long, ids binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)
    place = scratch_path(docs.sparkSession, "balanced-ids")
    rows.write.option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.schema(rows.schema).parquet(place)


class Plan:
    """Runs of (first row, rows, start in the piece, length, first sequence, offset).

    Rows are numbered by ascending length.  A run sends consecutive rows to consecutive sequences.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, linear: int = LINEAR) -> None:
        self.linear = linear
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        #: Sequences that are not full: (cost, capacity, used) to ranges of them; their keys by cost; their rooms.
        self.open: dict[tuple[int, int, int], list[list[int]]] = {}
        self.by_cost: list[tuple[int, int, int]] = []
        self.rooms: list[int] = []
        total = sum(length * n for length, n in histogram.items())
        self.sequences, over = divmod(total, capacity)
        if self.sequences:
            self._put((0, capacity, 0), [[0, self.sequences]])
        for bit in range(over.bit_length()):
            if over >> bit & 1:
                self._put((0, 1 << bit, 0), [[self.sequences, 1]])
                self.sequences += 1
        first = 0
        waiting = []
        for length in sorted(histogram):
            waiting.append((-length, first, histogram[length], 0))
            first += histogram[length]
        heapq.heapify(waiting)
        while waiting:
            length, row, n, start = heapq.heappop(waiting)
            self._place(waiting, -length, row, n, start)

    def _put(self, key: tuple[int, int, int], ranges: list[list[int]]) -> None:
        _, capacity, used = key
        if used == capacity:
            return
        if key in self.open:
            self.open[key] += ranges
            return
        self.open[key] = ranges
        insort(self.by_cost, key)
        insort(self.rooms, capacity - used)

    def _take(self, key: tuple[int, int, int], n: int) -> list[list[int]]:
        """Up to ``n`` sequences of a class, as ranges."""
        stock, out = self.open[key], []
        while n and stock:
            first, have = stock.pop()
            got = min(n, have)
            if got < have:
                stock.append([first + got, have - got])
            out.append([first, got])
            n -= got
        if not stock:
            del self.open[key]
            self.by_cost.pop(bisect_left(self.by_cost, key))
            self.rooms.pop(bisect_left(self.rooms, key[1] - key[2]))
        return out

    def _place(self, waiting: list[tuple[int, int, int, int]], length: int, row: int, n: int, start: int) -> None:
        while n:
            whole = self.rooms[-1] >= length
            # The cheapest sequences have the most room with few exceptions, so this ends soon.
            key = next(k for k in self.by_cost if k[1] - k[2] >= length) if whole else self.by_cost[0]
            cost, capacity, used = key
            size = length if whole else capacity - used
            taken = self._take(key, n)
            for first, got in taken:
                self.runs.append((row, got, start, size, first, used))
                if not whole:
                    heapq.heappush(waiting, (size - length, row, got, start + size))
                row += got
                n -= got
            self._put((cost + self.linear * size + size * size, capacity, used + size), taken)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges of stretches of rows with the same runs, where each stretch's runs begin, and the runs in that order."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 6)
        edges = np.unique(np.concatenate([runs[:, 0], runs[:, 0] + runs[:, 1]]))
        a, e = np.searchsorted(edges, runs[:, 0]), np.searchsorted(edges, runs[:, 0] + runs[:, 1])
        which = np.repeat(np.arange(len(runs)), e - a)
        stretch = np.arange(len(which)) - np.repeat(np.cumsum(e - a) - (e - a), e - a) + a[which]
        order = np.lexsort((runs[which, 2], stretch))
        begin = np.searchsorted(stretch[order], np.arange(len(edges) + 1))
        return edges, begin, runs[which[order]]


def pack(lengths: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR) -> DataFrame:
    """``part, seq, start, length, sequence_id, offset`` of every piece, from ``part, seq, n``.

    Documents longer than ``capacity`` are rows of whole sequences and a rest.  The driver gets the histogram
    (one row per length up to the capacity).
    """
    rest = F.pmod(F.col("n"), F.lit(capacity))
    long_cuts = F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)
    rows = lengths.select("part", "seq", "n", F.explode(long_cuts).alias("k")).select(
        "part", "seq", F.when(F.col("k") == 0, F.lit(0)).otherwise(
            F.col("k") * capacity - F.when(rest > 0, capacity - rest).otherwise(0)).cast("long").alias("start"),
        F.when((F.col("k") == 0) & (rest > 0), rest).otherwise(capacity).cast("long").alias("length"),
    )
    numbered = number_rows(rows, "length", "part", "seq", "start")
    histogram = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}
    edges, begin, runs = Plan(histogram, capacity, linear).tables()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row = b["row_no"].to_numpy()
            at = np.searchsorted(edges, row, side="right") - 1
            n = begin[at + 1] - begin[at]
            which = np.repeat(np.arange(len(row)), n)
            run = runs[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[at][which]]
            yield pd.DataFrame({
                "part": b["part"].to_numpy()[which], "seq": b["seq"].to_numpy()[which],
                "start": b["start"].to_numpy()[which] + run[:, 2], "length": run[:, 3],
                "sequence_id": run[:, 4] + row[which] - run[:, 0], "offset": run[:, 5],
            })

    return numbered.mapInPandas(place, "part long, seq long, start long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, linear: int = LINEAR, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked, ``ids`` of every piece.

    Lengths alone are planned; ids move once, to meet the places of their document's pieces.
    """
    encoded = encode(docs, path)
    placed = pack(encoded.select("part", "seq", "n"), capacity, linear)
    cuts = placed.groupBy("part", "seq").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, n, raw, places in zip(b["doc_id"].astype("Int64"), b["n"], b["ids"], b["cuts"], strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                for p in places:
                    a, e = p["start"], p["start"] + p["length"]
                    rows.append((doc_id, a, e - a, zlib.crc32(ids[a:e]), n, p["sequence_id"], p["offset"], *([ids[a:e].astype(np.int64)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")] + (["ids"] if with_ids else []))
            yield out.astype({"doc_id": "Int64"})

    return encoded.join(cuts, ["part", "seq"]).select("doc_id", "n", "ids", "cuts").mapInPandas(
        cut, kind + (", ids array<long>" if with_ids else "")
    )


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from packed pieces with ``ids``; a sequence holds ``capacity`` tokens at most."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("ids"))


def tokenizer_path() -> str:
    """The installed vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents."""
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())
