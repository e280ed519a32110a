"""The chain from raw documents to token ids: each stage takes the documents that the one before has kept.

All stages but the last return the columns of ``documents``. SQL cannot express the learnt scores, the near-copies'
groups and the encoding, so there is no SQL twin; the tests hold the stages against brute force.

Defined cases, those of the operators: NULL and empty texts score like a text without known words, share fingerprint zero
(one of them stays), hold no secret, have no words to mix and no ids; texts of any length are taken whole; of rows that
repeat id and text one stays; NULL ids and sources are values of their own; other columns are carried along unread up to
the last stage; an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadlens.llm.bpe import encode_documents
from threadlens.llm.common import table
from threadlens.llm.mixing import mix_documents
from threadlens.llm.secrets import redact_secrets
from threadlens.llm.simhash import drop_near_duplicates
from threadlens.llm.toxicity import drop_toxic
from threadlens.sources.sinks import store


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints (four-word shingles) are linked within 4 bits stays: the smallest id."""
    return drop_near_duplicates(docs, words=4, distance=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources reach their target weights."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, decoded: the ids of every document of the mix, and the text that they give back."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=50_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each but the last is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
