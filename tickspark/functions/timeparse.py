"""Mixed timestamp texts to timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats seen in tick exports, tried in this order.
FORMATS = (
    "yyyy.MM.dd HH:mm:ss.SSSSSS",
    "yyyy.MM.dd HH:mm:ss.SSS",
    "yyyy.MM.dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
)


def parse_ts(col: Column) -> Column:
    """Epoch milliseconds, ``yyyy.MM.dd HH:mm:ss[.SSS]`` or ISO text to a timestamp.

    Unreadable text gives NULL.  All branches are built-in expressions, so parsing stays in
    generated code.
    """
    text = F.trim(col.cast("string"))
    millis = F.when(
        text.rlike(r"^\d{9,16}(\.\d+)?$"),
        F.timestamp_millis(F.try_to_number(F.regexp_extract(text, r"^(\d+)", 1),
                                           F.lit("9" * 18)).cast("long")),
    )
    parsed = [F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]
    return F.coalesce(millis, *parsed, F.try_to_timestamp(text))
