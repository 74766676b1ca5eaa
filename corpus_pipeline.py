"""The corpus pipeline: five stages that each call one text operator.

Quality rules drop what they reject, SimHash near-dedup keeps the row with the smallest doc_id of each
group, decontamination drops contaminated documents, personal data is masked in the text, and the
rest is packed into sequences. A stage takes (spark, docs, sf_dir) and works on all that its
predecessor kept; all but the last return the columns of ``documents``.

Rows that are equal in every column count as copies in the near-dedup stage: one stays. A null doc_id
is larger than any other. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import read_table, stored
from ledgerline.llm.decontamination import clean_documents
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.pii import mask_documents
from ledgerline.llm.quality_rules import kept_documents
from ledgerline.llm.simhash import one_of_each_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack),
]

#: SQL has no counterpart of the sketches, hashes, models and tokenizers; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
