"""Corpus pipeline: documents of good quality, one of each near-duplicate group, without repeated passages and
benchmark contamination, as token ids.

Each stage takes all rows its predecessor kept. All but the last return the columns of ``documents``; the last returns
``doc_id, lang, source, token_ids, round_trip``. Stages are written and read again in the shared folder, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm.op3_jaccard_join import one_of_each
from tapeworks.llm.op4_quality_classifier import fit_quality, keep_good
from tapeworks.llm.op7_substring_dedup import remove_repeats
from tapeworks.llm.op8_sentencepiece import encode_texts
from tapeworks.llm.op10_decontamination import decontaminate
from tapeworks.llm.shared import table
from tapeworks.session import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the stage's own documents."""
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of the text."""
    return remove_repeats(docs, width=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs, ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokens),
]

#: The classifier's network, and encoding, are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
