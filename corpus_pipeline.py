"""A corpus made ready for training: each stage works on all rows that the one before it kept.

Every stage takes any table with the columns of documents: nulls, empty and very long texts, ties and repeated rows are
treated as its operator states, other columns are handed on (the last stage gives its own), and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapsewise.llm import dedup, mix, pack, queries, shared, simhash, toxicity


def _without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are scored toxic; the model is fitted on the labelled ones."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def _without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest doc_id (null last)."""
    return dedup.without_copies(docs)


def _without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints 2 bits apart or less, the one with the smallest doc_id (null last)."""
    return simhash.without_near_copies(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; sources (null is one) share the words by weight."""
    return mix.mixed(docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of tokens; a null text is an end token alone."""
    return pack.pack(docs, queries.VOCABULARY)


STAGES = [
    ("toxicity", _without_toxic),
    ("exact_dedup", _without_copies),
    ("simhash", _without_near_copies),
    ("mix", _mixed),
    ("pack", _packed),
]

#: Token ids and trained scores are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
