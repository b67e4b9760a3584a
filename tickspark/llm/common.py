"""Shared parts of the corpus operators: row numbers, words, hashes, crc folds, components.

Rows are documents ``(doc_id, text, lang, source, n_chars)``.  Words are ``[^\\x20\\x09-\\x0D]+``,
shingles are five words; the whole word sequence stands in when there are fewer.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickspark.session import configure, materialize

#: Most rows and bytes of one batch that a Python worker is given.
BATCH_ROWS, BATCH_BYTES = "1000", str(32 << 20)
#: Places among which the links of one node are dealt.
SALTS = 16
#: Words in one shingle.
SHINGLE = 5
#: White space between words, as a regular expression class.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A supplied table; the session is prepared on the way."""
    spark = configure(spark)
    # Texts can be long: a worker holds few of them at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_memory() -> None:
    """Give the system back what this process no longer uses, after learning on the driver; without glibc nothing happens."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def text_key(text: Column) -> Column:
    """128-bit hash of the bytes of a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda x: x != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def window_hashes(word_array: Column, n: int = SHINGLE) -> Column:
    """Hash of every run of ``n`` words; empty when there are fewer."""
    return F.transform(
        F.when(F.size(word_array) >= n, F.sequence(F.lit(0), F.size(word_array) - n))
        .otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(word_array, i + k) for k in range(n)]),
    )


def number_rows(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """Add dense row numbers from 0 in the order of ``order`` (nulls first).

    One range shuffle; each partition is sorted and counted, and the table of counts (one row per
    partition) gives each partition its first number.  The numbered rows are written once so that a
    retried task cannot number them anew.  Keep ``df`` narrow: all its columns are shuffled.
    """
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33))
    )
    placed = materialize(placed, "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(first, "_part").select(
        *df.columns, (F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(name)
    )


def since_first(df: DataFrame, keys: list[str], value: str, within: str, name: str) -> DataFrame:
    """Add ``value`` less its least one among the rows with the same ``keys`` (nulls equal).

    ``within`` cuts rows into stretches of bounded size.  The join is on both, so a key of any size
    spreads over its stretches; a window sees one row per key and stretch.
    """
    by = [*keys, within]
    first = F.min("_lo").over(W.partitionBy(*keys))
    parts = df.groupBy(*by).agg(F.min(value).alias("_lo")).select(*[F.col(k).alias(f"_{k}") for k in by], first.alias("_first"))
    same = [df[k].eqNullSafe(parts[f"_{k}"]) for k in by]
    return df.join(parts, same).select(*[df[c] for c in df.columns], (df[value] - parts["_first"]).alias(name))


def first_texts(docs: DataFrame, chosen: DataFrame, *columns: str) -> DataFrame:
    """One row of ``columns`` (the least, nulls first) for each ``doc_id`` of the small table ``chosen``, and its columns.

    However often an id occurs among the documents, the result has as many rows as ``chosen`` at most.
    """
    small = chosen.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", *columns).join(F.broadcast(small), F.col("doc_id") == F.col("_id")).drop("_id")
    labels = [c for c in chosen.columns if c != "doc_id"]
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("_row"), *[F.max(c).alias(c) for c in labels])
    return one.select("doc_id", *[F.col("_row")[c].alias(c) for c in columns], *labels)


class WordHash(dict):
    """64-bit hash of a word (bytes), remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; the whole sequence when it is short."""
    ws = split_words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    n = min(SHINGLE, len(ws))
    out = np.full(len(ws) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(ws) - n + 1 + k])
    return np.unique(out)


def components(nodes_links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternating star contraction: every node points its larger neighbours at its smallest
    neighbour, then its smaller ones, until nothing changes.  Each round is two groupings of the
    links by node and is written to the shared folder; a node with very many links is first reduced
    by the map-side minimum, and its links meet that in ``SALTS`` places.  The number of rounds grows with the logarithm of the longest chain.
    """
    links = nodes_links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    links = materialize(links, label)

    def state(pairs: DataFrame) -> tuple[int, int | None, int | None]:
        """Number and 128-bit digest of distinct pairs: one grouping, where a comparison of tables takes several."""
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    before = state(links)

    def with_least(pairs: DataFrame) -> DataFrame:
        """Each pair (u, v) with the least neighbour ``m`` of u; a node's pairs meet its row in ``SALTS`` places."""
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pairs.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "_salt"]).drop("_salt")

    changed = before[0] > 0
    while changed:
        # Large star: both directions, larger neighbours go to the smallest of neighbours and self.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours and self go to the smallest neighbour.
        joined = with_least(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        links = materialize(small, label)
        now = state(links)
        changed, before = now != before, now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
