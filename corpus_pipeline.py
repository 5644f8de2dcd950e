"""A training-data pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet
and read again. The first four return the columns of documents, whatever further columns there are and however they are
named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode_decode
from tessera.llm.common import aside, saved, slot, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.neardup import one_of_each
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.queries import vocabulary
from tessera.llm.toxicity import fit_toxicity, score_toxicity

#: No SQL expresses trained classifiers; the stages are tested against plain versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model doesn't hold for toxic."""
    docs, keep, named = aside(docs)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), "toxic", slot(4) != 2)
    return score_toxicity(docs, model, 0.3, keep).filter("predicted = 0").select(named)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs, keep, named = aside(docs)
    fit = fit_quality(docs, table(spark, sf_dir, "labels"), "quality", slot(5) != 0)
    return score_quality(docs, fit, 0.3, keep).filter("predicted = 1").select(named)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more."""
    docs, _, named = aside(docs)
    return one_of_each(docs, width=5, percent=80).select(named)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of eight words of a benchmark item."""
    docs, keep, named = aside(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1, keep=keep)
    return found.filter("not contaminated").select(named)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and of the decoded text."""
    return encode_decode(docs, vocabulary("word_bpe_49k.json"), ["doc_id", "lang", "source"], with_ids=True)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
