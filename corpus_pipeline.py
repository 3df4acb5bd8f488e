"""The corpus pipeline: reject, deduplicate, decontaminate, mask and mix the documents.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of
documents; the last adds ``taken``, the words that the mix takes of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsweave.llm.decontaminate import clean_documents
from newsweave.llm.mixing import mixture
from newsweave.llm.order_minhash import one_of_each
from newsweave.llm.pii import masked
from newsweave.llm.shared import table, written
from newsweave.llm.toxicity import unoffending


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return unoffending(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return masked(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes words of, with how many."""
    return mixture(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
]

# Models and sketches aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
