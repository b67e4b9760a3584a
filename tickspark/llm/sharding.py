"""Reproducible shuffle into shards by a keyed permutation of global row numbers.

Rows get dense numbers in a fixed order, and a Feistel network over a grid of ``a`` by ``b`` cells
(``a * b`` at least the row count, both near its square root) maps each number to a new one;
numbers that fall outside the table are mapped again until they fall inside (cycle walking).  The
new number alone gives ``shard = number mod shards`` and ``slot = number div shards``: any row's place
can be computed, and shard sizes differ by one at most.

Null texts count as empty, null ids sort first, rows equal in id, checksum and size take
neighbouring numbers in any order (their places are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import number_rows, read

ROUNDS = 6
#: Longest walk tried for one number.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """The sides of a near-square grid with at least ``n`` cells, fewer than ``a`` of them unused."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(number: Column, n: int, key: int, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. n-1 as one expression.

    Fewer than ``a`` cells are unused, so for ``n`` up to 4096 a walk of 64 steps always ends;
    above, one step misses with a chance below 1/64, and a number still outside after 64 steps
    would raise an error rather than get a wrong place.
    """
    a, b = grid(n)

    def noise(half: Column, i: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(key).cast("long"), i, half), F.lit(size).cast("long"))

    def once(x: Column) -> Column:
        right = F.pmod(x, F.lit(b).cast("long"))
        start = F.struct(((x - right) / F.lit(b)).cast("long").alias("l"), right.alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)),
            start,
            lambda s, i: F.when(
                i % 2 == 1,
                F.struct(F.pmod(s["l"] + noise(s["r"], i, a), F.lit(a).cast("long")).alias("l"), s["r"].alias("r")),
            ).otherwise(
                F.struct(s["l"].alias("l"), F.pmod(s["r"] + noise(s["l"], i, b), F.lit(b).cast("long")).alias("r"))
            ),
            lambda s: s["l"] * F.lit(b).cast("long") + s["r"],
        )

    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK)), once(number.cast("long")),
        lambda x, _: F.when(x < n, x).otherwise(once(x)),
    )
    return F.aggregate(
        F.array(walked), F.lit(0).cast("long"),
        lambda _, x: F.when(x < n, x).otherwise(F.raise_error(F.lit("walk too long")).cast("long")),
    )


def sized(docs: DataFrame) -> list[Column]:
    """The size and the checksum of a text, by which rows with one id are ordered."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return [(F.octet_length(body) + 1).cast("long"), F.crc32(body)]


def place(docs: DataFrame, shards: int = 8, key: int = 20240229) -> DataFrame:
    """``doc_id, size, text_crc32, shuffled, shard, slot`` of every row.

    Only these few numbers are shuffled, never texts.
    """
    size, crc = sized(docs)
    narrow = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    numbered = number_rows(narrow, "doc_id", "text_crc32", "size")
    n = numbered.count()
    return numbered.select(
        "doc_id", "size", "text_crc32", permute(F.col("row_no"), n, key).alias("shuffled")
    ).select(
        "*", (F.col("shuffled") % shards).cast("int").alias("shard"),
        ((F.col("shuffled") - F.col("shuffled") % shards) / shards).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: int = 20240229, files: int = 1) -> None:
    """Write whole documents below ``path``, one folder per shard, sorted by slot in each file.

    The rows themselves are numbered, in the order of :func:`place`, so each is written exactly once at the place that
    it has there, also rows without id and repeated ones.  Documents are in a column ``document``, beside ``slot``, so that
    their columns may have any names.
    """
    size, crc = sized(docs)
    rows = docs.select("doc_id", crc.alias("text_crc32"), size.alias("size"), F.struct(*docs.columns).alias("document"))
    numbered = number_rows(rows, "doc_id", "text_crc32", "size")
    n = numbered.count()
    placed = numbered.select("document", permute(F.col("row_no"), n, key).alias("at")).select(
        "document", (F.col("at") % shards).cast("int").alias("shard"),
        ((F.col("at") - F.col("at") % shards) / shards).cast("long").alias("slot"),
    )
    spread = placed.withColumn("file", F.pmod(F.xxhash64("slot"), F.lit(files)))
    spread.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").drop("file").write.partitionBy(
        "shard"
    ).parquet(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents under the law of equal row counts."""
    return place(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
