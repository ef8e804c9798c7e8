"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import materialize, table
from marginalia.llm.decontaminate import drop_contaminated
from marginalia.llm.language import keep_identified
from marginalia.llm.packing import pack
from marginalia.llm.pii import mask_personal_data
from marginalia.llm.simhash import drop_near_duplicates


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the pieces of all documents with their place in a sequence."""
    return pack(docs)


STAGES = [
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_documents),
]

#: Networks and a tokenizer decide: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
