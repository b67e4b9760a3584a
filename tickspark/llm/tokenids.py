"""Token ids in binary files: ranks by frequency in byte-aligned codes with separate control bytes.

Ids are numbered by falling frequency in the whole corpus, so that frequent ones have small numbers.
Numbers are stored in one to four bytes each; the lengths, four to a control byte, stand before the data, and
a table of the 256 control bytes gives them all at once in numpy.

Files hold frames, each followed by a line feed that the writer adds::

    magic, part, frame, documents, tokens, data bytes         header, little-endian
    ids of documents (signed 64 bits), 1 where the id is null (8 bits), tokens of each (32 bits)
    control bytes, data bytes

``part`` and ``frame`` are in ascending order of document id (nulls first), and documents inside a frame too.
The numbering is a file of its own beside them.  Reading needs nothing else.  Spark's own writer and
reader are used, so the files can be in any store it knows.

Null and empty texts are the end id alone.  Repeated rows are stored each; equal ids are ordered by
their tokens.  An empty table gives no frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickspark.llm.common import read
from tickspark.llm.tokens import encoder
from tickspark.session import materialize, scratch_path

END = 2
#: A frame is closed once it has this many tokens; a longer document has a frame of its own.
FRAME_TOKENS = 1 << 18
#: Frames in one file.
FRAMES_PER_FILE = 32
#: Ids counted at once.
TALLY = 1 << 20
HEAD = struct.Struct("<4sIIIQQ")
MAGIC = b"FRQ1"
#: Lengths of the four numbers of every control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
PLACE = np.arange(4, dtype=np.uint8)


def compress(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(numbers, "<u4")
    size = (1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)).astype(np.uint8)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[PLACE < size[:, None]].tobytes()


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of control and data bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[PLACE < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def write_frame(part: int, number: int, doc_ids: list[int | None], tokens: list[np.ndarray]) -> bytes:
    """One frame of documents given as rank arrays."""
    flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint32)
    control, data = compress(flat)
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([
        HEAD.pack(MAGIC, part, number, len(doc_ids), len(flat), len(data)),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.array([len(t) for t in tokens], "<u4").tobytes(), control, data,
    ])


def read_frames(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``part, frame, doc_ids, null, counts, ranks`` of every frame of a file."""
    at = 0
    while at < len(content):
        magic, part, number, docs, tokens, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a frame")
        at += HEAD.size
        ids = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        counts = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        control = content[at : at + -(-tokens // 4)]
        at += len(control)
        yield part, number, ids, null, counts, expand(control, content[at : at + size], tokens)
        at += size + 1


def write_blobs(blobs: DataFrame, path: str, per_file: int = 0) -> None:
    """Write a column ``blob`` of bytes as raw files, each blob followed by a line feed."""
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (16-bit ids with the end id) of every document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, True).column
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), to_ids(b.column("text"), END)], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")
    place = scratch_path(docs.sparkSession, "ids")
    rows.write.option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.schema(rows.schema).parquet(place)


def ranked_ids(ids: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first; equal counts by id.  Bounded by the vocabulary."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for b in batches:
            column = b.column("ids").cast(pa.binary())
            if not len(column):
                continue
            _, place, data = column.buffers()
            first, *_, end = (np.frombuffer(place, np.int32)[column.offset :][: len(column) + 1] // 2).tolist()
            every = np.frombuffer(data or b"", "<u2")
            for at in range(first, end, TALLY):
                n += np.bincount(every[at : min(at + TALLY, end)], minlength=1 << 16)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": used, "n": n[used]})

    total = ids.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = total.collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], "<u4")


def write_corpus(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write all documents' ids in ascending order of id below ``path``."""
    spark = docs.sparkSession
    ids = encode(docs, tokenizer)
    by_rank = ranked_ids(ids)
    rank = np.zeros(1 << 16, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        tokens: list[np.ndarray] = []
        for b in batches:
            for doc_id, raw in zip(b["doc_id"].astype("Int64"), b["ids"], strict=True):
                names.append(None if doc_id is pd.NA else int(doc_id))
                tokens.append(rank[np.frombuffer(raw, "<u2")])
                held += len(tokens[-1])
                if held >= FRAME_TOKENS:
                    yield pd.DataFrame({"blob": [write_frame(part, number, names, tokens)]})
                    number, held, names, tokens = number + 1, 0, [], []
        if names:
            yield pd.DataFrame({"blob": [write_frame(part, number, names, tokens)]})

    ordered = ids.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    write_blobs(ordered.mapInPandas(frames, "blob binary"), f"{path}/frames", FRAMES_PER_FILE)
    table = spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "blob binary")
    write_blobs(table.coalesce(1), f"{path}/ranks")


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The numbering of a corpus: id of every rank."""
    files = spark.read.format("binaryFile").load(f"{path}/ranks/part-*").where("length > 0").select("content").collect()
    return np.frombuffer(bytes(files[0]["content"])[:-1], "<u4") if files else np.empty(0, "<u4")


def read_corpus(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``part, frame, doc_id, before, n_tokens, ids_crc32`` and, if asked, ``ids`` of every stored document.

    ``before`` counts the tokens of the frame before the document; :func:`starts` makes it global.
    """
    id_of = read_ranks(spark, path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for part, number, ids, null, counts, ranks in read_frames(bytes(content)):
                    tokens = id_of[ranks]
                    ends = np.cumsum(counts, dtype=np.int64)
                    raw = memoryview(tokens.tobytes())
                    out = pd.DataFrame({
                        "part": part, "frame": number, "doc_id": pd.array(ids, "Int64"), "before": ends - counts,
                        "n_tokens": counts.astype(np.int64),
                        "ids_crc32": [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)],
                    })
                    out.loc[null == 1, "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = np.split(tokens.astype(np.int64), ends[:-1])
                    yield out

    files = spark.read.format("binaryFile").load(f"{path}/frames").select("content")
    return files.mapInPandas(
        decode, "part long, frame long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    )


def starts(stored: DataFrame) -> DataFrame:
    """Add ``start``, the tokens of all documents before, from the totals of frames and of parts."""
    frames = materialize(stored.groupBy("part", "frame").agg(F.sum("n_tokens").alias("n")), "frames")
    parts = frames.groupBy("part").agg(F.sum("n").alias("n"))

    def before(w: W) -> DataFrame:
        return F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    part_start = parts.select("part", before(W.orderBy("part")).alias("part_start"))
    frame_start = frames.select("part", "frame", before(W.partitionBy("part").orderBy("frame")).alias("frame_start"))
    base = frame_start.join(part_start, "part").select("part", "frame", (F.col("part_start") + F.col("frame_start")).alias("base"))
    return stored.join(base, ["part", "frame"]).withColumn("start", F.col("base") + F.col("before"))


def tokenizer_path() -> str:
    """The installed vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids, read back from the files."""
    docs = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "corpus")
    write_corpus(docs, tokenizer_path(), path)
    return starts(materialize(read_corpus(spark, path), "digests")).select("doc_id", "start", "n_tokens", "ids_crc32")
