"""Cleaning a corpus for training: five stages over ``documents``, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to
the shared folder and hands what it reads again to the next one.  All stages but
the last return the columns of documents.

Defined results of every stage: a null text counts as empty and texts of any length
are read whole; empty texts aren't toxic, are copies of each other and aren't
contaminated; a null doc_id sorts behind all others where the smallest one stays;
rows of one doc_id are judged each by its own text, and of rows equal in text and
doc_id one stays; ties between near copies go to the smaller SHA-256 of the text;
further columns, whatever their names, pass untouched up to the last stage; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, fm_index, piece_codec, simhash, toxic_crf
from quillon.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores as toxic go."""
    return toxic_crf.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of several benchmark items go; from the others hit spans are cut."""
    return fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    return piece_codec.digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("decontaminate", decontamination),
    ("sentencepiece", tokens),
]

#: Random field and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
