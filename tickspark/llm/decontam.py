"""Benchmark decontamination by size-partitioned MinHash containment search, in built-in expressions.

An item is contained in a document when enough of its distinct five-word shingles occur there.  A
MinHash of a long document says nothing about a short item, so documents are cut into overlapping
segments, and the search is partitioned by size: items of up to ``L`` shingles (64 or a power of two above) meet
segments of ``2 L`` shingles that start every ``L``, one of which holds any passage of ``L`` shingles whole.
The MinHash has one permutation and ``k`` bins: a set keeps the least hash of each bin.  In each partition ``k`` is
the least power of two with which an item at the threshold shares no bin minimum with its segment with a
chance below ``MISS``.  A shared minimum makes a candidate; containment is then counted on full shingle sets.

Words are compared in lower case.  Items of fewer than five words have no shingles and are never found; the
same holds for null and empty texts.  Null ids are kept as they are; in the table of pairs, rows with one id and
different texts count by the higher containment, and repeated rows give one pair.  The pipeline stage judges every
row by its own text, whatever its id.  Shingles are compared by 64-bit hashes, whole texts by 128-bit ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import let, read, text_key, window_hashes, words
from tickspark.session import materialize

#: Least containment that counts, in percent.
PERCENT = 75
#: Largest item of the first partition, in shingles.
LEAST_SIZE = 64
#: Chance that an item at the threshold is missed.
MISS = 1e-4
#: The items' bin minima are broadcast up to this many rows (24 bytes each), joined by shuffle above.
BROADCAST_KEYS = 1_000_000


def shingles(text: Column) -> Column:
    """Hashes of all five-word shingles of a text, in order."""
    return let(words(F.lower(text)), window_hashes)


def bins_for(smallest: int, size: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Bins with which an item of ``smallest`` shingles is found in a segment of ``2 * size``."""
    shared, union = max(1, math.ceil(smallest * percent / 100)), 2 * size + smallest
    k = 64
    while k < 1 << 20:
        alone = k / union * (1 - (1 - 1 / k) ** union)
        if (1 - alone) ** shared <= miss:
            break
        k *= 2
    return k


def bin_minima(hashes: Column, k: int) -> Column:
    """The least hash of every bin that occurs; bins are ranges of hashes, so sorting brings them together."""
    shift = 64 - int(math.log2(k))
    return let(
        F.array_sort(hashes),
        lambda s: F.filter(
            s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift))
        ),
    )


def segments(hashes: Column, size: int) -> Column:
    """Stretches of ``2 * size`` hashes that start every ``size``; the whole when it is short."""
    number = F.greatest(F.lit(1), F.ceil(F.size(hashes) / size).cast("int") - 1)
    return F.transform(
        F.sequence(F.lit(0), number - 1), lambda b: F.slice(hashes, b * size + 1, F.lit(2 * size))
    )


def items(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_set, n_item, size`` of items with shingles."""
    rows = benchmark.select("item_id", F.array_distinct(shingles(F.col("text"))).alias("item_set"))
    rows = rows.withColumn("n_item", F.size("item_set").cast("long")).where("n_item > 0")
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double")) - 1e-9)).cast("int")
    return rows.withColumn("size", F.greatest(F.lit(LEAST_SIZE), power))


def find(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_item, n_common, containment`` of every contained item."""
    known = materialize(items(benchmark), "items")
    parts = known.groupBy("size").agg(F.min("n_item").alias("smallest")).orderBy("size").collect()
    # The key of the text tells rows apart whose ids are null or repeated.
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    if not parts:
        nothing = rows.select("doc_id", F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_common"))
        return nothing.limit(0).crossJoin(known.select("item_id").limit(0)).select(
            "doc_id", "item_id", "n_item", "n_common", F.lit(0.0).alias("containment")
        )
    bins = {p["size"]: bins_for(p["smallest"], p["size"], percent) for p in parts}

    def marks(size: int, sets: Column) -> Column:
        """The bin minima of each of several sets, with the size they are for."""
        found = F.flatten(F.transform(sets, lambda h: bin_minima(h, bins[size])))
        return F.transform(found, lambda x: F.struct(F.lit(size).alias("size"), x.alias("key")))

    keys = None
    for size in bins:
        own = known.where(F.col("size") == size).select("item_id", F.explode(marks(size, F.array("item_set"))).alias("mark"))
        keys = own if keys is None else keys.unionByName(own)
    keys = keys.select("item_id", "mark.size", "mark.key")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    # Shingles are made once for all sizes.
    all_marks = let(shingles(F.col("text")), lambda h: F.when(
        F.size(h) > 0, F.concat(*[marks(size, segments(h, size)) for size in bins])
    ))
    sketch = rows.select("doc_id", "text_key", F.explode(all_marks).alias("mark")).select("doc_id", "text_key", "mark.size", "mark.key")
    found = sketch.join(keys, ["size", "key"]).select("doc_id", "text_key", "item_id").distinct()
    candidates = materialize(found, "candidates")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    wanted = candidates.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    # One row for each id and text, however often both are repeated.
    texts = rows.join(wanted, same, "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.first("text").alias("text")
    )
    sets = texts.select("_id", "_key", shingles(F.col("text")).alias("h"))
    pairs = candidates.join(sets, same).join(known, "item_id")
    counted = pairs.select(
        "doc_id", "item_id", "n_item", F.size(F.array_intersect("item_set", "h")).cast("long").alias("n_common")
    ).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common"))
    return counted.where(100 * F.col("n_common") >= percent * F.col("n_item")).withColumn(
        "containment", F.col("n_common") / F.col("n_item")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the benchmark contained in documents."""
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose own text contains a benchmark item go; ids, null or repeated, do not matter."""
    texts = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    leaks = find(texts, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, text_key(docs["text"]) == leaks["_leak"], "left_anti")


#: Containment counted on all shingles of all texts, without any search.
OP6_SQL = """
with item_words as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark
), item_shingles as (
  select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s
  from item_words where len(w) >= 5
), sizes as (
  select item_id, count(*) as n_item from item_shingles group by item_id
), doc_words as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), doc_shingles as (
  select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s
  from doc_words where len(w) >= 5
), shared as (
  select doc_id, item_id, count(*) as n_common from doc_shingles join item_shingles using (s) group by doc_id, item_id
)
select doc_id, item_id, n_item, n_common, n_common / n_item as containment
from shared join sizes using (item_id) where 100 * n_common >= 75 * n_item
"""
