"""A corpus from raw documents to packed sequences, in five stages of the training-data operators.

Every stage reads ``doc_id`` and ``text`` (and ``n_chars``, where a text changes) and hands all other columns on, whatever
their names; nulls in them stay. Of an empty table every stage returns an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeflow.llm.common import cut, table
from codeflow.llm.decontam import drop_contaminated
from codeflow.llm.minhash import drop_near_duplicates
from codeflow.llm.packing import pack
from codeflow.llm.secrets import redact
from codeflow.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model of the labels predicts toxic. Null and empty texts hold no token and stay; a row with
    a null id, and each of repeated rows, is judged by its text, whole however long; at a score of exactly 0.5 it goes;
    without usable labels all stay."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8). Null and empty texts
    have no shingle and stay, as do rows with a null id (which could not be named); rows that share an id are one document:
    all stay or none."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item (or are one but for some words). Null and empty texts hold none; a row
    with a null id, and each of repeated rows, is judged by its text; items without a word, with a null id or a null text
    match nothing; at a similarity of exactly 0.8 the document goes."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked, also those in encoded stretches. Null texts stay null, others without a secret
    stay as they are; spans that touch or overlap get one mark; repeated rows and null ids are masked like others."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence. Null and empty texts are one piece of one token, long
    ones several pieces; repeated rows and null ids get places of their own."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]
#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
