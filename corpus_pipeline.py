"""The corpus pipeline: documents to packed sequences. Each stage is one operator over all that the stage
before it kept, near duplicates and very long texts included.

All stages but the last return the columns of documents, whatever columns stand beside doc_id, text and lang; all take
tables without rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrykit.llm.common import clean, load, mark, materialize
from quarrykit.llm.decontamination import decontaminate
from quarrykit.llm.language_id import keep_identified, train
from quarrykit.llm.ngram_join import keep_one
from quarrykit.llm.packing import pack_documents
from quarrykit.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the classifier finds go: those of null text or without a letter, and all if no
    document is labelled. It is fitted on docs themselves; rows without doc_id or lang teach nothing. Repeated rows
    stay or go alike; ties between languages reject nothing."""
    return keep_identified(docs, train(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest doc_id, rows without one last; of repeated
    rows one. Null and blank texts have no copies, and stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts, and null or very short items, match nothing; without
    items all stay."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its place in a sequence. A null text is an empty document; repeated rows
    and rows without doc_id are documents of their own; documents of any length are cut into pieces."""
    return pack_documents(docs, end=0, **vocabulary())


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: SQL can't express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep: what one stage keeps is written and read again for the next, and
    what a stage wrote besides is deleted then. No documents give no rows."""
    docs, began = load(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        clean(spark, began, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
