"""Corpus pipeline: from raw documents to a decontaminated training mixture.

Every stage takes (spark, docs, sf_dir) and returns a frame; :func:`run` writes each stage's rows as Parquet to the shared
checkpoint folder and hands the reread table to the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auxoline.llm.decontaminate import decontaminate
from auxoline.llm.exact_dedup import deduplicate
from auxoline.llm.frames import stored
from auxoline.llm.mixture import mix_sources
from auxoline.llm.near_dedup import keep_one
from auxoline.llm.quality import keep_good
from auxoline.llm.registry import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier draws; the others go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at the raked weights, with their topic, tokens and probability."""
    out, names = mix_sources(docs)
    return out.filter(F.col(names[3])).drop(names[3])


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture)]

#: The classifier, components and raking are iterative; tests compare each stage with a plain computation instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
