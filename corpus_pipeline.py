"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``folioweave.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import decontaminate, language_id, line_dedup, piece_transducer, simhash
from folioweave.llm.common import cut, table

TOKENIZER = "piece_bpe_32k.model"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language that the labelled ones teach go: no letters, or too few known n-grams."""
    return language_id.keep_known(docs, language_id.learn(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of lines go from the texts; n_chars follows."""
    found = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints link, as in ``op2_simhash_near_dedup``, the one of the smallest id stays."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copied or edited benchmark passage go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids and the text that they decode to."""
    import public_tokenizers

    return piece_transducer.encode_pieces(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: Fingerprints, alignments and piece ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is checkpointed, so none runs twice."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
