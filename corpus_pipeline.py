"""A training-data pipeline over documents: toxicity, exact copies, near copies, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.common import discard, table, written
from pulseframe.llm.exact_dedup import drop_copies
from pulseframe.llm.mixing import Mix, keep_mixed
from pulseframe.llm.pieces import MODEL, Vocabulary, encode_documents
from pulseframe.llm.simhash import drop_near_copies
from pulseframe.llm.toxicity import drop_toxic

#: One epoch, so that no document comes twice, of nine tenths of what is left.
MIX = Mix(budget=0.9, max_epochs=1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the machine learns from the labels of this input."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix."""
    return keep_mixed(docs, MIX)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids and ids of each document."""
    return encode_documents(docs, Vocabulary.load(MODEL), "doc_id", "lang", "source")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the trained machine nor fingerprints nor the search; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage wrote is deleted when the next one is done."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = written(docs, f"stage-{name.replace(' ', '-')}")
            if last:
                discard(spark, last)
            last = path
    return docs
