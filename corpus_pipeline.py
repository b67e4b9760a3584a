"""From raw documents to packed training sequences.

Each stage calls one operator, works on all that the stage before kept, and is written as Parquet and read
again.  All stages but the last return the columns of documents, also those they do not know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickspark.llm import decontam, neardup, packing, quality_fm, toxicity
from tickspark.llm.common import read
from tickspark.session import materialize

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("quality", quality_fm.drop_low_quality),
    ("near_duplicates", neardup.drop_copies),
    ("decontamination", decontam.drop_leaks),
    ("packing", packing.pack_stage),
]

#: Trained scores and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the places of the pieces of all that was kept."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
