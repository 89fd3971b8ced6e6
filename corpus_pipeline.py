"""The corpus pipeline: quality, language, near-duplicates, contamination, packing.

Each stage reads what the one before has written and acts on all of it. Whatever columns the documents have, under
any names, come through the first four stages as they are. Null and empty texts fail the base rule and go in the
first; were they handed to a later one, language ID would drop them too, near-duplicates would keep one of them,
contamination keeps them and packing makes each the single id 0. Very long texts are read whole by every stage;
repeated rows share their fate up to near-duplicates, which keeps one of them; an empty table stays empty to the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from concord.llm import decontamination, language_id, packing, quality_rules, simhash
from concord.llm.queries import vocabulary_path
from concord.session import ensure_checkpoint_dir, remove, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and the certified rules of their language keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is known with a calibrated probability of one half at least."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than one word in twenty lies in a benchmark window."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality rules", quality), ("language ID", language), ("near-duplicates", near_duplicates), ("decontamination", contamination), ("packing", packed)]

#: Fitted and certified stages, fingerprints and tokens have no SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet to the shared folder before the next.

    What a stage has read is removed as soon as its own result is written; the last stage's input stays, as
    the result still reads it.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            path = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
