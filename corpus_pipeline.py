"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and
rereads them, so a stage never recomputes its predecessors.

Every stage takes null texts as empty, keeps null and repeated ids apart by their texts,
leaves extra columns as they are, reads texts of any length, and gives no rows for an
empty table.  Empty and null texts fall to the quality rules, as they have too few words;
rows that repeat id and text are one row after the exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.exact_dedup import exact_dedup
from quillmark.llm.mixing import mixed_documents
from quillmark.llm.packing import pack
from quillmark.llm.quality_rules import quality_filter
from quillmark.llm.shared import table, written
from quillmark.llm.simhash_vp import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text: that with the smallest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id."""
    return simhash_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the schedule takes them, whole, in part or again, so that sources meet
    their target weights; n_chars follows the text."""
    mixed = mixed_documents(docs)
    if "n_chars" not in mixed.columns:
        return mixed
    kind = mixed.schema["n_chars"].dataType
    return mixed.withColumn("n_chars", F.length(F.col("text").cast("string")).cast(kind))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places in training sequences."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]

#: Fingerprints, components and token ids are beyond SQL; tests/llm holds the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
