"""Near duplicates by banded MinHash with odd sketches.

Texts with the same set of five-word shingles form a class.  Each class has ``BANDS * ROWS`` MinHash values:
bands of ``ROWS`` give bucket keys, and all samples are folded into an odd sketch, a bitmap in which each
sample flips one bit.  The population count of two sketches' XOR estimates how many samples differ,
most precisely where similarity is high, so that pairs of a bucket are dropped or passed on to the exact test on full
shingle sets without fetching these.

Buckets are not expanded into all pairs.  First every member is compared with one leader of its bucket,
the member that meets most others in its buckets, and what is linked falls into components.  Then only members
of one bucket in different components are compared, those outside its largest component with the others,
and only pairs that pass the sketch leave the join.  Links inside a component cannot change it, so no
component is lost.  Of the members still compared,
shingles that no other of them has are counted out: they are in no intersection.  Bitmaps of the rest
bound the similarity of two sets from above, and pairs that cannot reach the threshold leave no row.  A pair at the
threshold shares no band with a chance below 1 in 10,000; above it, the chance falls fast.

Null and empty texts have no shingles and are linked with nothing; a text of fewer than five words has
its whole sequence as its one shingle.  Repeats of a row share its component.  Null ids are allowed: a
component takes the least id that is not null, or null when all are, and then marks all its rows as kept.
The pipeline stage keeps exactly one row of each component, also where ids are null or repeated.
Shingles are compared by 64-bit hashes, sets and texts by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import WordHash, components, mix, read, shingle_set, text_key
from tickspark.session import materialize

BANDS, ROWS = 50, 6
#: Bits of an odd sketch.
SKETCH = 2048
#: Smallest similarity that counts as a link, in percent.
PERCENT = 75
#: Pairs whose sketches estimate less are dropped; five standard errors below the threshold.
SKETCH_FLOOR = 0.61
#: Words of 64 bits in the bitmaps of members that are compared across components.
MARK_WORDS = 64
_RNG = np.random.default_rng(20090622)
#: Multipliers of the hash functions.
FACTORS = (_RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """One minimum per hash function over a non-empty set."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 1024):
        x = h[None, k : k + 1024] * FACTORS + SHIFTS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(1), out=low)
    return low


def fold_bits(samples: np.ndarray) -> np.ndarray:
    """Odd sketch: each (function, sample) flips one bit of the map."""
    bit = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH)
    parity = np.bincount(bit.astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    s = samples.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key + s[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, sketch, bands`` of every document; the last three null without shingles."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for b in batches:
            n, digest, sketch, bands = [], [], [], []
            for text in b["text"]:
                s = shingle_set(text, cache)
                n.append(len(s))
                if not len(s):
                    digest.append(None), sketch.append(None), bands.append(None)
                    continue
                low = minhash(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(fold_bits(low))
                bands.append(band_keys(low))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text_key": b["text_key"], "n_shingles": n, "digest": digest, "sketch": sketch, "bands": bands})

    return docs.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text")).alias("text_key")).mapInPandas(
        sign, "doc_id long, text_key binary, n_shingles long, digest binary, sketch array<long>, bands array<long>"
    )


def shingles_of(docs: DataFrame) -> DataFrame:
    """``digest, shingles`` of every document with shingles."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHash()
        for b in batches:
            sets = [s for s in (shingle_set(t, cache) for t in b["text"]) if len(s)]
            yield pd.DataFrame({
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]
            }, dtype=object)

    return docs.select("text").mapInPandas(take, "digest binary, shingles array<long>")


def full_sets(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """``digest, shingles`` of the chosen classes (digest, first_id), from the texts."""
    ids = chosen.where("first_id is not null").select("first_id").distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("first_id"), "left_semi").unionByName(
        docs.select("doc_id", "text").where("doc_id is null")
    )
    return shingles_of(texts).join(chosen.select("digest").distinct(), "digest").dropDuplicates(["digest"])


def common_marks(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """``digest, shared, marks, bits``: of the shingles that another chosen class has too, how many a
    chosen class has, a bitmap of their hashes, and how many of its bits are set."""
    each = materialize(full_sets(chosen, docs).select("digest", F.explode("shingles").alias("s")), "open-shingles")
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")
    word = F.pmod(F.col("s"), F.lit(MARK_WORDS))
    words = each.join(common, "s").groupBy("digest", word.cast("int").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(s, 32), 64) as int))")).alias("m")
    )
    kept = words.groupBy("digest").agg(
        F.sum("n").alias("shared"), F.sum(F.bit_count("m")).alias("bits"),
        F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("by_word"),
    )
    marks = F.transform(F.sequence(F.lit(0), F.lit(MARK_WORDS - 1)), lambda w: F.coalesce(F.try_element_at("by_word", w), F.lit(0).cast("long")))
    return kept.select("digest", "shared", "bits", marks.alias("marks"))


def bits(a: Column, b: Column, use: Callable[[Column, Column], Column]) -> Column:
    """Set bits of two bitmaps combined; one short expression, since the driver plans each join several times."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(use(x, y))), F.lit(0), lambda n, k: n + k)


def most_common(x: str, y: str) -> Column:
    """The most shingles that two chosen classes can share: common bits, and what one bit may stand for."""
    both = bits(F.col(f"{x}_marks"), F.col(f"{y}_marks"), lambda x, y: x.bitwiseAND(y))
    return both + F.least(F.col(f"{x}_shared") - F.col(f"{x}_bits"), F.col(f"{y}_shared") - F.col(f"{y}_bits"))


def similar_size(a: Column, b: Column) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two odd sketches."""
    differ = bits(a, b, lambda x, y: x.bitwiseXOR(y))
    rest = F.greatest(1 - 2 * differ / SKETCH, F.lit(1e-9))
    return 1 + F.log(rest) * SKETCH / (4 * BANDS * ROWS)


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) of digests that are links: first by sketch, then on full sets."""
    side = classes.select("digest", "sketch", "first_id")
    near = pairs.join(side.toDF("a", "a_sketch", "a_id"), "a").join(side.toDF("b", "b_sketch", "b_id"), "b").where(
        estimate(F.col("a_sketch"), F.col("b_sketch")) >= SKETCH_FLOOR
    )
    near = materialize(near.select("a", "b", "a_id", "b_id"), f"{label}-near")
    ends = near.select(F.col("a").alias("digest"), F.col("a_id").alias("first_id")).unionByName(
        near.select(F.col("b").alias("digest"), F.col("b_id").alias("first_id"))
    ).distinct()
    sets = materialize(full_sets(ends, docs), f"{label}-sets")
    both = near.select("a", "b").join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    linked = 100 * common >= PERCENT * (F.size("a_set") + F.size("b_set") - common)
    return materialize(both.where(linked).select("a", "b"), f"{label}-links")


#: What a member brings to the comparison across components.
MEMBER = ("digest", "root", "n_shingles", "shared", "bits", "marks", "sketch")


def link(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``digest, root`` for every class that is linked with another."""
    keyed = classes.select("digest", "n_shingles", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowd = materialize(keyed.join(crowded, "key"), "crowd")
    # The leader of a bucket is the member that meets most others in all its buckets.
    company = crowd.groupBy("digest").agg(F.sum("members").alias("met"))
    crowd = materialize(crowd.drop("members").join(company, "digest"), "company")
    lead = crowd.groupBy("key").agg(F.max(F.struct("met", "digest", "n_shingles")).alias("lead"))
    members = materialize(
        crowd.join(lead, "key").select(
            "key", "digest", "n_shingles", F.struct(F.col("lead.digest").alias("d"), F.col("lead.n_shingles").alias("n")).alias("lead")
        ), "members",
    )
    star = members.where((F.col("digest") != F.col("lead.d")) & similar_size(F.col("n_shingles"), F.col("lead.n")))
    tried = materialize(
        star.select(F.least("digest", "lead.d").alias("a"), F.greatest("digest", "lead.d").alias("b")).distinct(), "star"
    )
    first = confirm(tried, classes, docs, "star")
    joined = components(first)
    # What is left: members of one bucket in different components.
    owned = members.select("key", "digest", "n_shingles").join(joined.withColumnRenamed("node", "digest"), "digest", "left")
    owned = materialize(owned.withColumn("root", F.coalesce("root", "digest")), "owned")
    by_root = owned.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_root.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")
    ).where("roots > 1").select("key", "main")
    open_rows = materialize(owned.join(mixed, "key"), "open")
    chosen = open_rows.select("digest").distinct().join(classes.select("digest", "first_id"), "digest")
    shared = common_marks(materialize(chosen, "chosen"), docs)
    # A class whose shared shingles are too few for any link has no pair at all.
    open_rows = open_rows.join(shared, "digest").join(classes.select("digest", "sketch"), "digest").where(100 * F.col("shared") >= PERCENT * F.col("n_shingles"))
    open_rows = materialize(open_rows.select("key", "main", *MEMBER), "open-shared")
    outside = open_rows.where("root <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in MEMBER])
    inside = open_rows.select("key", "main", *[F.col(c).alias(f"y_{c}") for c in MEMBER])
    most = F.least("x_shared", "y_shared")
    rest = outside.join(inside, "key").where(
        (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_digest") < F.col("y_digest")))
        & similar_size(F.col("x_n_shingles"), F.col("y_n_shingles"))
        & (100 * most >= PERCENT * (F.col("x_n_shingles") + F.col("y_n_shingles") - most))
        & (estimate(F.col("x_sketch"), F.col("y_sketch")) >= SKETCH_FLOOR)
        & ((100 + PERCENT) * most_common("x", "y") >= PERCENT * (F.col("x_n_shingles") + F.col("y_n_shingles")))
    )
    rest = rest.select(F.least("x_digest", "y_digest").alias("a"), F.greatest("x_digest", "y_digest").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    second = confirm(materialize(rest, "rest"), classes, docs, "rest")
    return components(first.unionByName(second))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures, and ``digest, first_id, root`` of every class; classes of one root are a component."""
    signed = materialize(signatures(docs), "signatures")
    classes = materialize(
        signed.where("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
        ), "classes",
    )
    roots = materialize(
        classes.select("digest", "first_id").join(link(classes, docs).withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest")), "roots",
    )
    return signed, roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    signed, roots = grouped(docs)
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least, "root").select("digest", "component_id")
    # Rows of one text share a digest, which may be that of a third of all rows: only the small side is grouped.
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def chosen_rows(docs: DataFrame) -> DataFrame:
    """``_id, _key, _n``: id and text key of the row that stays of each component, and how many rows have both.

    It is the row of least id, null ids last, then of least key.  Rows without shingles are only grouped
    with their repeats (same id, same text).
    """
    signed, roots = grouped(docs)
    rows = signed.groupBy("doc_id", "text_key", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.join(roots.select("digest", "root"), "digest", "left"), "rows")
    first = rows.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("r")
    )
    names = ["_id", "_key", "_n"]
    return materialize(
        first.select("r.doc_id", "r.text_key", "r.n").toDF(*names)
        .unionByName(rows.where("root is null").select("doc_id", "text_key", "n").toDF(*names)), "chosen-rows",
    )


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, the one of least id."""
    chosen = chosen_rows(docs)

    def pick(rows: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(rows["_id"]) & text_key(docs["text"]).eqNullSafe(rows["_key"])
        return docs.join(rows, same, "left_semi")

    repeated = chosen.where("_n > 1")
    if repeated.isEmpty():
        return pick(chosen)
    # Of rows with one id and one text, the first stays; they meet one by one partition.
    by = ["_stage_id", "_stage_key"]
    once = pick(repeated).withColumns({by[0]: F.col("doc_id"), by[1]: text_key(F.col("text"))}).dropDuplicates(by).drop(*by)
    return pick(chosen.where("_n = 1")).unionByName(once)
