"""The corpus pipeline: documents in known languages, free of copies and of benchmark passages, redacted and encoded.

Every stage takes (spark, docs, sf_dir), works on all of ``docs``, processes whole texts however long, and, but for the
last, returns the columns it got, whatever they are called. Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import bpe, decontam, langid, minhash, pii
from nearfold.llm.store import materialize, release, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Null, empty and wordless texts, numbers alone, and text of other languages go;
    repeated rows are judged alike; rows without a label or doc_id are judged but not learned from."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id. Of equal rows one stays, and rows that
    repeat a doc_id with another text are compared like others; null and wordless texts, and rows without a doc_id, stay."""
    return minhash.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``. Null and empty texts stay; an empty benchmark leaves all."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind in brackets; n_chars follows the text. Null texts stay null."""
    return pii.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids of all documents: null tokens for a null text, none for an empty one; repeated rows are encoded each."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", redact_pii),
    ("byte-pair encoding", encode),
]

#: Automata, learned models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written as a table that the next one reads and that goes when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            if before is not None:
                release(before)
            before = docs
    return docs
