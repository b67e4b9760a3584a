"""Hashes with the same value on every engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of :func:`portable_hash`.
BITS = 52


def portable_hash(columns: Sequence[str], seed: int) -> Column:
    """The first 13 hexadecimal digits of the MD5 of ``seed|a|b|...`` as a long; NULL counts as empty."""
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("long")
