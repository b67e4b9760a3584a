"""Fill in the middle: a text cut at two unit ends and put together in another order.

A unit is a line (with its line feed) or a code point.  Unit ends are found on the whole batch at once, eight
bytes at a time: the UTF-8 of all texts is one buffer, viewed as 64-bit words.  A few arithmetic steps on a
word set one bit per byte that ends a unit (none per text or byte), ``bitwise_count`` gives the ends in a
word, and their running sum answers both questions asked: how many ends lie before a byte (rank) and where
the k-th end lies (select: a binary search for the word, then byte-wise running counts inside it).

Where to cut and which form to use follow from the SHA-256 of the seed and the id alone, so any row can be
made again.  A text that holds one of the marks is left plain, therefore the marks in an output are the ones
put there and ``restored`` finds the text again exactly.

Null texts count as empty; empty texts are plain with no units.  A null id counts as no digits, so rows without
id share their draws.  Very long texts are cut like others.  Repeated rows and equal ids give equal results, one row
each; other columns are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import read

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50

ONE = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)


def as_words(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, with zero bytes to the end and one word more."""
    out = np.zeros(len(raw) // 8 + 2, "<u8")
    out.view(np.uint8)[: len(raw)] = raw
    return out


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed."""
    x = words ^ FEEDS
    # A byte of x is zero exactly if neither its low bits carry into the high one nor the high one is set.
    return ~(((x & LOW) + LOW) | x) & HIGH


def char_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is no continuation byte (``10xxxxxx``)."""
    return ~(words & ~(words << np.uint64(1))) & HIGH


def char_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte followed by the start of a code point."""
    starts = char_starts(words)
    after = np.append(starts[1:], np.uint64(0))
    return (starts >> np.uint64(8)) | (after << np.uint64(56))


UNITS = {"line": line_ends, "char": char_ends}


class Marked:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        #: Marks before each word, and in all.
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on bytes before ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of mark ``k`` (from 1)."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = (k - self.before[word]).astype(np.uint64)
        # Byte i of the product has the marks on bytes 0 .. i; those below `left` come before the byte sought.
        upto = (self.marks[word] >> np.uint64(7)) * ONE
        reached = ((upto | HIGH) - left * ONE) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def draws(seed: int, ids: list[int | None]) -> np.ndarray:
    """Four unsigned 32-bit numbers per id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def cuts(raw: np.ndarray, at: np.ndarray, h: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, the bytes where its prefix and its middle end, and the code points of both."""
    words = as_words(raw)
    ends, chars = Marked(UNITS[unit](words)), Marked(char_starts(words))
    a, e = at[:-1], at[1:]
    first, last = ends.rank(a), ends.rank(e)
    whole = n = last - first
    if unit == "line" and len(raw):
        n = whole + ((e > a) & (raw[np.maximum(e - 1, 0)] != 10))
    x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)

    def end_of(k: np.ndarray) -> np.ndarray:
        out = np.where(k == 0, a, e)
        inside = (k > 0) & (k < n) & (k <= whole)
        out[inside] = ends.select(first[inside] + k[inside]) + 1
        return out

    p, m = end_of(np.minimum(x, y)), end_of(np.maximum(x, y))
    return n, p, m, chars.rank(p) - chars.rank(a), chars.rank(m) - chars.rank(p)


def transform(
    docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document.

    ``rate`` and ``spm`` are percentages: of texts transformed, and of those with the suffix first.  Marks must
    be such that none can begin inside another, like the ones given.
    """
    mark_p, mark_s, mark_m = (m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            raw, at = buffers(texts)
            h = draws(seed, ids.to_pylist())
            n, p, m, prefix, middle = cuts(raw, at, h, unit)
            body = raw.tobytes()
            forms, outs = [], []
            for k, (s, e, i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), p.tolist(), m.tolist(), strict=True)):
                text = body[s:e]
                if not text or h[k, 2] % 100 >= rate or mark_p in text or mark_s in text or mark_m in text:
                    forms.append("plain")
                    outs.append(text)
                elif h[k, 3] % 100 < spm:
                    forms.append("spm")
                    outs.append(b"".join([mark_s, body[j:e], mark_p, body[s:i], mark_m, body[i:j]]))
                else:
                    forms.append("psm")
                    outs.append(b"".join([mark_p, body[s:i], mark_s, body[j:e], mark_m, body[i:j]]))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(forms, pa.string()), pa.array(prefix.astype(np.int64), mask=plain),
                 pa.array(middle.astype(np.int64), mask=plain), pa.array(outs, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, taken apart and put together from an output and its form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        rest = F.substring_index(body, second, -1)
        return F.substring_index(body, second, 1), F.substring_index(rest, marks[2], 1), F.substring_index(rest, marks[2], -1)

    prefix, suffix, middle = parts(marks[0], marks[1])
    late_suffix, late_prefix, late_middle = parts(marks[1], marks[0])
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(late_prefix, late_middle, late_suffix))
        .otherwise(output)
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all transformed documents and of the texts found again in them."""
    rows = transform(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: Lines by splitting at line feeds; a part is followed by one unless it is the last.
OP12_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h,
         string_split(coalesce(text, ''), chr(10)) as p
  from documents
), u as (
  select *, len(p) - case when p[len(p)] = '' then 1 else 0 end as n,
         cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
         cast('0x' || substr(h, 25, 8) as bigint) as h4
  from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from u
), s as (
  select *, case when a = 0 then '' when a = len(p) then text else array_to_string(p[1:a], chr(10)) || chr(10) end as head,
         case when b = 0 then '' when b = len(p) then text else array_to_string(p[1:b], chr(10)) || chr(10) end as upto,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from c
), t as (
  select *, substr(upto, length(head) + 1) as mid, substr(text, length(upto) + 1) as tail from s
)
select doc_id, n, form, case when form <> 'plain' then length(head) end as prefix_chars,
       case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || mid
                        when 'spm' then '<S>' || tail || '<P>' || head || '<M>' || mid else text end) as output_sha256,
       sha256(text) as restored_sha256
from t
"""
