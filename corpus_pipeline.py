"""From documents to token ids: five stages, each one operator of tagloom.llm.

Each stage takes all that the one before it kept and returns the columns of documents; the last returns token ids and what they decode to.
No SQL can express the whole (a classifier is trained in it), so it is tested against a plain version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, toxicity
from tagloom.llm.common import materialize, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, and the digest of the bytes that the ids decode to."""
    return byte_bpe.round_trip(docs, *byte_bpe.public_vocabulary(), memory=30_000)  # executors still hold what earlier stages used


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Each but the last is written, as the next reads it more than once; what a stage has
    written besides goes when it ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), packed=True)
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
