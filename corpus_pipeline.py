"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage works on all that its predecessor kept; between stages the rows are written as Parquet and read again.

Null ids, repeated rows, null, empty and very long texts and columns of other names go through every stage: language ID
drops a null or empty text, as it has no letter; the near-duplicate stage keeps rows with a null id, and of a repeated id
all rows if it is the smallest of its component; the draw takes repeated rows together, and ties of its hash alike; packing
returns pieces, with null ids as null. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm import language_id, mixing, ngram_join, packing
from loomlake.llm.common import cut, drop_cut, tune
from loomlake.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the predicted language replaces the given one."""
    tune(spark)
    return language_id.label(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays."""
    tune(spark)
    return ngram_join.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics near their target weights."""
    tune(spark)
    return mixing.sample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows."""
    tune(spark)
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", identify_language), ("ngram_jaccard", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: Models and packing are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            drop_cut(last)
    return docs
