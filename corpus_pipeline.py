"""A training corpus from raw documents: five stages, each a corpus operator on all that the one before it kept.

Null, empty and letterless texts go in the first stage; repeated rows in the second; where nothing is labelled, or no
benchmark is there, every document passes that stage. Other columns than a stage names are carried along unread.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import delete_stored, stored, stored_so_far, table
from marlstone.llm.decontam import drop_contaminated
from marlstone.llm.exact_dedup import drop_copies
from marlstone.llm.langid import keep_identified
from marlstone.llm.near_dup import drop_near_duplicates
from marlstone.llm.packing import pack_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in some language, with the one found in the text as `lang`, by which packing goes; null texts and texts without a letter go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that of the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of near copies: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, each of one language."""
    return pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), by_col="lang")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language ID, edit matching and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`; each stage's result is a written table that the next one reads.

    Tables that a stage stored go as soon as its result is written, and that result when the next one is.
    """
    docs = table(spark, sf_dir, "documents")
    before = stored_so_far()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        delete_stored(spark, before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
