"""A training-corpus pipeline over ``documents``: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import cut, table
from tessera.llm.decontaminate import drop_leaks
from tessera.llm.minhash import Similarity, drop_near
from tessera.llm.pieces import PieceModel, encode
from tessera.llm.quality import can_fit, fit_quality, keep_quality
from tessera.llm.secrets import fit_markov, redact_secrets

#: Documents of one class share this percentage of their five-word shingles.
NEAR = Similarity(percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels of the documents at hand; unless the rows it learns from hold
    both labels it accepts all, as its score is then one base rate, and nothing is known against any document."""
    labels = table(spark, sf_dir, "labels")
    return keep_quality(docs, fit_quality(docs, labels)) if can_fit(docs, labels) else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    return drop_near(docs, NEAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return redact_secrets(docs, fit_markov(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids."""
    return encode(docs, PieceModel.load())


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("leaks", leaks), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; what each keeps is written to the shared checkpoint folder, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs


#: Trained scores and whole-set similarity have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
