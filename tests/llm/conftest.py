import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 977} text{i % 31}," for i in range(9000))


def sentence(k: int, n: int = 40) -> str:
    return " ".join(f"w{(k * 7919 + j * 104729) % 5003}" for j in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, foreign letters, clashing columns."""
    base = sentence(1)
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (2, base, "en", "a", len(base)),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "en", "a", 4), (6, "one two", "en", None, 7),
        (7, "One  TWO", "en", "a", 8), (None, sentence(2), None, "a", None), (8, LONG, "de", "a", len(LONG)),
        (9, base + " changed", "en", "a", 0), (10, "日本語 текст é\n\n  x", "xx", "a", 12), (11, "12 34 56 !", "en", "a", 9),
        (12, "\n".join(["same line here"] * 30), "en", "a", 100), (-5, sentence(3), "en", "a", 1),
        (1 << 40, sentence(4), "fr", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("score", "quality", "toxic", "digest", "key", "row_no", "shard", "_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 1), (6, None, None), (None, 1, 1), (12, 0, 1), (8, 1, 0), (999, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
