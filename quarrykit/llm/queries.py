"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .decontamination import contamination
from .fingerprints import edited_fingerprints
from .html_extraction import main_text
from .language_id import identify, train
from .ngram_join import ngram_jaccard_join
from .oracles import OP1_WARC, OP4_NGRAM_JACCARD_JOIN
from .packing import pack_documents
from .preference import preferences
from .tokens import token_counts
from .url_filter import judge
from .warc import warc_round_trip


def vocabulary() -> dict[str, str]:
    """The byte-level BPE of byte_bpe_50k.json, read from its ranks file."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


#: The id that ends a document in the flat token files: no text has it.
END_OF_TEXT = 50256


#: The longest rule that fits wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(load(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"), RULES)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(load(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(load(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), end=END_OF_TEXT, **vocabulary())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(load(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), end=0, **vocabulary())


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(load(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return identify(documents, train(documents))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_benchmark_decontamination,
        op3_url_filter,
        op4_ngram_jaccard_join,
        op5_winnowing,
        op6_token_counts,
        op7_html_extraction,
        op8_best_fit_packing,
        op9_preference_format,
        op10_language_id,
    )
}

#: SQL can't express the others: tests/llm holds them against brute force, round trips or held-out accuracy.
ORACLES = {"op1_warc": OP1_WARC, "op4_ngram_jaccard_join": OP4_NGRAM_JACCARD_JOIN}
