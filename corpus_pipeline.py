"""A training corpus from raw documents: toxic texts go, near duplicates go, secrets are masked, sources are mixed, texts become ids.

All stages take null and empty texts, rows without doc_id, repeated rows, empty tables and further columns of any name.  A null or empty
text scores as clean, is no duplicate, holds no secret and has no ids.  A row without doc_id is no duplicate; rows that repeat a kept
doc_id all stay.  Of a group of duplicates the smallest doc_id stays.  Without labels nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import minhash, mixture, pieces, secrets, toxicity
from larder.llm.common import settle, table

# One task of the first stages or the vocabulary's automaton can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose text scores as toxic, by a lexicon learned from the labelled documents of this input."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of documents with five-word shingles alike to 0.8 and more."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets and linked parts of credentials in the texts."""
    return secrets.redact(docs)


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources have shares by the root of their size, in a random order."""
    return mixture.mix(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number and digests."""
    return pieces.encode_decode(docs, keep_ids=True, remember=150_000)  # workers still hold what earlier stages took


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("near_duplicates", deduplicate),
    ("secrets", mask),
    ("mixture", blend),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
