"""A training corpus from ``documents``: toxic documents out, copies out, near duplicates out, sources
mixed to target weights, and the mix packed into sequences.

Each stage takes what the one before it left, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.llm import digest_index, jaccard, mixing, packing, toxicity
from mercato.llm.common import done_with, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest doc_id."""
    return digest_index.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of least doc_id."""
    return jaccard.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each contiguous stretch that the mix takes of one. A null or wordless
    text isn't in the mix; of an empty table nothing is left."""
    return mixing.mixed_documents(docs, mixing.TEXT_BLOCK_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences (a null text is packed as an empty one, that is as the id 1)."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
#: SQL can't express the classifier, the mix and the tokenizer; tests/llm/test_pipeline.py says every stage in plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-"))
        done_with(before)
    return STAGES[-1][1](spark, docs, sf_dir)
