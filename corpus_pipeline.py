"""A training corpus from raw documents, in stages that are each written and read again.

Quality rules (9) reject documents, line dedup (5) takes out repeated lines, SimHash (3) keeps one
document of each near-duplicate group, personal data (2) is masked, and what is left is packed (4).

Every stage takes null texts as empty (quality rules reject them), null ids as ids that come last or
first, repeated rows as one document, further columns as they are, and an empty table as no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tintype.llm.line_dedup import dedup_lines
from tintype.llm.line_quality import apply_quality_rules
from tintype.llm.packing import pack_documents
from tintype.llm.pii import mask_personal_data
from tintype.llm.queries import tokenizer_file
from tintype.llm.simhash import keep_one
from tintype.plans.worktables import drop_table, scratch_tables, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many documents of a source share go from the rest. Copies count once, as a later stage takes them."""
    return apply_quality_rules(docs, copies_once=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of earlier lines go, and with them documents that had nothing else."""
    return dedup_lines(docs, drop_emptied=True, least_words=1, count_as=None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that the documents fill."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash", near_copies),
    ("personal data", personal_data),
    ("packing", packing),
]

#: The near-duplicate and packing stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written to the shared folder and read again.

    What a stage wrote on its way is deleted once its result is there, as is the result once the
    next stage's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch_tables(spark):
            docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"), scratch=False)
        if before is not None:
            drop_table(before)
        before = docs
    return docs
