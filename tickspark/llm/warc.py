"""Fixity audit of web archives with hash trees.

Every record of an archive is a leaf: its digest (SHA-256 of its bytes, with the page id among them), the
number of its copy among equal records, and its offset in its range of page ids.  A range is sixteen
consecutive ids, the same for all replicas; a lowest node of the tree hashes the leaves of a range in order, and
sixteen neighbouring nodes are hashed into one of the next level, up to one root.  Two replicas with
the same root are equal; otherwise only the children of nodes that differ are compared, level by level, so a
damaged stretch opens the branches above it and no others.  A record that is lost or put in shows in its own range and,
as moved, in the records behind it there.

A range with very many records (one id, or none, may hold a third of all) is split by hash into lowest nodes of
bounded size, in the same way for all replicas, and these are hashed together sixteen at a time as well.

What is left over on both sides is paired by page id, in order.  Null url or html counts as empty; a
null page id sorts first and has a range of its own.  A record without a partner is ``missing`` or ``extra``.  An
empty replica has no leaves.  Repeated pages are separate records.  Very long pages enter by digest and size; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickspark.llm.common import number_rows, read, since_first
from tickspark.session import materialize

FANOUT = 16
#: Records in one archive file.
PER_ARCHIVE = 1000
#: Archives whose sizes one window sums.
PER_GROUP = 1000


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """``ordinal, archive, page_id, start, stop, digest``: the records in archives, by page id.

    Digests are taken where the page is read; only they and the lengths are shuffled.  Offsets are
    running sums inside an archive, which holds a fixed number of records.
    """
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    narrow = pages.select(
        "page_id", F.octet_length(record).cast("long").alias("bytes"),
        F.sha2(record.cast("binary"), 256).alias("digest"),
    )
    rows = number_rows(narrow, "page_id", "bytes", "digest", name="ordinal").withColumn(
        "archive", ((F.col("ordinal") - F.col("ordinal") % PER_ARCHIVE) / PER_ARCHIVE).cast("long")
    )
    upto = W.partitionBy("archive").orderBy("ordinal")
    return rows.withColumn("stop", F.sum("bytes").over(upto)).select(
        "ordinal", "archive", "page_id", (F.col("stop") - F.col("bytes")).alias("start"), "stop", "digest"
    )


def keyed(leaf_rows: DataFrame, origin: int, fanout: int = FANOUT) -> DataFrame:
    """Leaves with their ``range`` of ids from ``origin`` on (0: no id), ``copy`` among equal records and ``offset`` in the range."""
    group = F.expr(f"archive div {PER_GROUP}").alias("_group")
    archives = leaf_rows.groupBy("archive").agg(F.max("stop").alias("_bytes")).select("archive", "_bytes", group)
    before = W.rowsBetween(W.unboundedPreceding, -1)
    groups = archives.groupBy("_group").agg(F.sum("_bytes").alias("_all"))
    groups = groups.select("_group", F.coalesce(F.sum("_all").over(before.orderBy("_group")), F.lit(0)).alias("_first"))
    inside = F.coalesce(F.sum("_bytes").over(before.partitionBy("_group").orderBy("archive")), F.lit(0))
    base = archives.select("archive", "_group", inside.alias("_inside")).join(groups, "_group").select(
        "archive", (F.col("_first") + F.col("_inside")).alias("_base")
    )
    number = F.floor((F.col("page_id") - F.lit(origin)) / fanout) + 1
    rows = leaf_rows.join(base, "archive").select(
        *leaf_rows.columns, (F.col("start") + F.col("_base")).alias("_at"), F.coalesce(number, F.lit(0)).cast("long").alias("range")
    )
    rows = since_first(since_first(rows, ["digest"], "ordinal", "archive", "copy"), ["range"], "_at", "archive", "offset")
    return rows.drop("_at")


def levels_for(n: int, fanout: int = FANOUT) -> int:
    """Levels until one node is above ``n`` of them."""
    depth = 0
    while fanout**depth < n:
        depth += 1
    return depth


def tree(leaf_rows: DataFrame, slots: DataFrame, depths: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """The leaves (as from :func:`keyed`) with the ``range`` and ``slot`` of their lowest node, then levels of
    ``range, slot, digest`` from the lowest nodes to the root.

    ``slots`` has the number of lowest nodes of each range that needs more than one; ``depths`` are the levels over
    slots and over ranges.
    """
    leaf_rows = leaf_rows.join(slots, "range", "left")
    slot = F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("digest", "copy"), F.col("slots"))).otherwise(0)
    levels = [materialize(leaf_rows.withColumn("slot", slot.cast("long")).drop("slots"), "replica")]

    def above(rows: DataFrame, place: Column, order: list[str], *parts: str) -> DataFrame:
        leaf = F.struct(*order, F.concat_ws(":", *parts).alias("_text"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["_text"]), "\n")
        return materialize(
            rows.groupBy(place.alias("_node")).agg(F.sha2(text.cast("binary"), 256).alias("digest")).select("_node.*", "digest"), "tree"
        )

    def node(by_range: int, by_slot: int) -> Column:
        return F.struct(F.expr(f"range div {by_range}").alias("range"), F.expr(f"slot div {by_slot}").alias("slot"))

    levels.append(above(levels[0], node(1, 1), ["offset", "digest", "copy"], "page_id", "digest", "copy", "offset"))
    for k in range(sum(depths)):
        up = node(1, fanout) if k < depths[0] else node(fanout, 1)
        levels.append(above(levels[-1], up, ["range", "slot"], "range", "slot", "digest"))
    return levels


def compare(ours: list[DataFrame], theirs: list[DataFrame], depths: tuple[int, int], fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """``range, slot`` of the lowest nodes that differ, and how many differ on each level from the root down."""
    bad, opened = None, []
    name = ["range", "slot"]
    for k in range(sum(depths), -1, -1):
        a, b = ours[k + 1], theirs[k + 1]
        if bad is not None:
            by = (1, fanout) if k < depths[0] else (fanout, 1)
            up = (F.expr(f"range div {by[0]}") == F.col("_range")) & (F.expr(f"slot div {by[1]}") == F.col("_slot"))
            parents = bad.select(F.col("range").alias("_range"), F.col("slot").alias("_slot"))
            a, b = a.join(parents, up, "left_semi"), b.join(parents, up, "left_semi")
        both = a.withColumnRenamed("digest", "a").join(b.withColumnRenamed("digest", "b"), name, "full_outer")
        bad = materialize(both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*name), "damage")
        opened.append(bad.count())
    return bad, opened


#: What is known of a record on one side.
SIDE = ("ordinal", "archive", "start", "stop", "digest", "offset")


def pair(rows: DataFrame, *by: str) -> DataFrame:
    """The records ``a`` (ours) and ``b`` (theirs) of each key, at most one on either side."""
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("side") == s, F.struct(*SIDE))).alias(s) for s in "ab"])


def differing(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> tuple[tuple[DataFrame, DataFrame], list[int]]:
    """The leaves of both replicas below lowest nodes that differ, and the numbers of nodes opened from the root down."""
    ours, theirs = materialize(ours, "leaves"), materialize(theirs, "leaves")
    ends = ours.unionByName(theirs).agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    origin = ends["low"] or 0
    a, b = (materialize(keyed(rows, origin, fanout), "keyed") for rows in (ours, theirs))
    counts = [rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")) for rows in (a, b)]
    size = counts[0].unionByName(counts[1]).groupBy("range").agg(F.max("n").alias("n"))
    slots = size.where(F.col("n") > 4 * fanout).select("range", F.ceil(F.col("n") / fanout).alias("slots"))
    slots = materialize(slots, "slots")
    most = slots.agg(F.max("slots")).first()[0] or 1
    depths = levels_for(most, fanout), levels_for(((ends["high"] or 0) - origin) // fanout + 2, fanout)
    trees = [tree(rows, slots, depths, fanout) for rows in (a, b)]
    bad, opened = compare(*trees, depths, fanout)
    return tuple(t[0].join(bad, ["range", "slot"], "left_semi") for t in trees), opened


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records of ``ours`` and ``theirs`` (as from :func:`leaves`) that differ, with what differs.

    ``damage``: ``content`` (other bytes under the same page id), ``moved`` (same bytes at another offset
    in the range of page ids), ``missing`` (only in ours), ``extra`` (only in theirs).  Ordinal, archive, start
    and stop are those of ours, and of theirs for ``extra``.
    """
    (a, b), _ = differing(ours, theirs, fanout)
    a, b = a.withColumn("side", F.lit("a")), b.withColumn("side", F.lit("b"))
    same = materialize(pair(a.unionByName(b), "page_id", "digest", "copy"), "pairs")
    moved = same.where(F.col("a.offset") != F.col("b.offset")).select("page_id", "a", "b", F.lit("moved").alias("damage"))
    alone = same.where("a is null or b is null").select(
        "page_id", F.when(F.col("b").isNull(), "a").otherwise("b").alias("side"), F.coalesce("a", "b").alias("r")
    ).select("page_id", "side", "r.*")
    numbered = number_rows(alone, "page_id", "side", "ordinal", name="_no")
    turns = since_first(numbered.withColumn("_part", F.expr(f"_no div {PER_ARCHIVE}")), ["page_id", "side"], "_no", "_part", "turn")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("content")
    rest = pair(turns, "page_id", "turn").select("page_id", "a", "b", kind.alias("damage"))
    return moved.unionByName(rest).withColumn("r", F.coalesce("a", "b")).select(
        "r.ordinal", "page_id", "r.archive", "r.start", "r.stop",
        F.col("a.digest").alias("digest"), F.col("b.digest").alias("other_digest"), "damage",
    )


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with pages overwritten at the first character, lost, lengthened and put in, each at a rule of the page id."""
    k, html = F.col("page_id"), F.col("html")
    overwritten = F.concat(F.when(F.ascii("html") == 35, F.lit("%")).otherwise(F.lit("#")), F.expr("substring(html, 2)"))
    changed = F.when((k % 50 == 7) & F.ascii("html").between(1, 127), overwritten).when(
        k % 401 == 11, F.concat(F.coalesce(html, F.lit("")), F.lit("<!-- -->"))
    ).otherwise(html)
    kept = pages.select("page_id", "url", changed.alias("html")).where(F.coalesce(k % 211 != 3, F.lit(True)))
    added = pages.where(k % 307 == 5).select("page_id", F.concat(F.coalesce("url", F.lit("")), F.lit("#again")).alias("url"), "html")
    return kept.unionByName(added)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archives made from all pages against a replica with four kinds of damage."""
    pages = read(spark, sf_dir, "pages")
    return audit(leaves(pages), leaves(damaged_copy(pages))).select(
        "ordinal", "page_id", "archive", "start", "stop", "digest", "other_digest", "damage"
    )


_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || coalesce(cast(page_id as varchar), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
         || cast(strlen(coalesce(html, '')) as varchar) || repeat(chr(13) || chr(10), 2) || coalesce(html, '') || repeat(chr(13) || chr(10), 2)"""

#: The same audit without trees: both replicas in full, joined on page id, digest and copy.
OP2_SQL = f"""
with copy as (
  select page_id, url, case when page_id % 50 = 7 and ascii(html) between 1 and 127
              then (case when ascii(html) = 35 then '%' else '#' end) || substr(html, 2)
              when page_id % 401 = 11 then coalesce(html, '') || '<!-- -->' else html end as html
  from pages where coalesce(page_id % 211 <> 3, true)
  union all select page_id, coalesce(url, '') || '#again', html from pages where page_id % 307 = 5
), records as (
  select 'a' as side, page_id, {_RECORD} as r from pages union all select 'b', page_id, {_RECORD} from copy
), sized as (
  select side, page_id, strlen(r) as bytes, sha256(r) as digest,
         coalesce((page_id - (select min(page_id) from pages)) // 16, -1) as rng from records
), numbered as (
  select *, row_number() over (partition by side order by page_id nulls first, bytes, digest) - 1 as ordinal from sized
), placed as (
  select *, ordinal // 1000 as archive, row_number() over (partition by side, digest order by ordinal) as copy_no,
         sum(bytes) over (partition by side, ordinal // 1000 order by ordinal) as stop,
         sum(bytes) over (partition by side, rng order by ordinal) - bytes as ofs
  from numbered
), same as (
  select coalesce(a.page_id, b.page_id) as page_id, a.ordinal as ao, a.archive as aa, a.stop - a.bytes as ast, a.stop as asp, a.digest as ad, a.ofs as aof,
         b.ordinal as bo, b.archive as ba, b.stop - b.bytes as bst, b.stop as bsp, b.digest as bd, b.ofs as bof
  from (select * from placed where side = 'a') a full join (select * from placed where side = 'b') b
    on a.page_id is not distinct from b.page_id and a.digest = b.digest and a.copy_no = b.copy_no
), la as (
  select *, row_number() over (partition by page_id order by ao) as turn from same where bo is null
), lb as (
  select *, row_number() over (partition by page_id order by bo) as turn from same where ao is null
), found as (
  select page_id, ao, aa, ast, asp, ad, bo, ba, bst, bsp, bd, 'moved' as damage from same where aof <> bof
  union all
  select coalesce(la.page_id, lb.page_id), la.ao, la.aa, la.ast, la.asp, la.ad, lb.bo, lb.ba, lb.bst, lb.bsp, lb.bd,
         case when lb.bo is null then 'missing' when la.ao is null then 'extra' else 'content' end
  from la full join lb on la.page_id is not distinct from lb.page_id and la.turn = lb.turn
)
select coalesce(ao, bo) as ordinal, page_id, coalesce(aa, ba) as archive, cast(coalesce(ast, bst) as bigint) as start,
       cast(coalesce(asp, bsp) as bigint) as stop, ad as digest, bd as other_digest, damage
from found
"""
