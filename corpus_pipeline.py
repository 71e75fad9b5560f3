"""A corpus pipeline of the training-data operators: quality, near-dedup, personal data, mixing, packing.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. Near-dedup takes
shingles of five words and links at 80 %, other than the query op9_near_dedup (three words, 85 %).

Defined results: documents with a null or empty text have no word and go with the quality rules; null ids, sources and
other columns stay as they are; of repeated rows one stays; an empty table gives an empty result at each stage; extra
columns are carried along whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm import op1_quality, op2_pii, op5_mixing, op9_neardup, op10_packing
from kelpline.llm.common import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op1_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return op9_neardup.deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    return op2_pii.sanitised(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, go or repeat, so that the sources meet their target weights."""
    return op5_mixing.take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return op10_packing.packed(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: Expectation-maximisation and random rounding have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
