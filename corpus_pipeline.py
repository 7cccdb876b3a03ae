"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again as the next one's input.

All stages take null values in any column, empty tables, further columns of any name, and rows that repeat: these are kept or dropped
together. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.mixing import mix_to_targets
from tidemark.llm.queries import TARGETS, labelled_domains, table
from tidemark.llm.secret_scan import mask_secrets
from tidemark.llm.storage import materialize
from tidemark.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts hold no term and stay."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more.
    Rows without an id, and null and empty texts, are in no group and stay."""
    groups = jaccard_components(docs, k=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows. Null texts stay null."""
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A rate for each remaining document that brings the domains' expected tokens to the targets. Null and empty texts
    have no tokens and rate 1."""
    return mix_to_targets(docs, labelled_domains(spark, sf_dir), TARGETS)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("secret_scan", secret_scan), ("mixing", mixing)]
#: SQL cannot express the trained and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
