"""From raw documents to packed training sequences: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import decontaminate, jaccard_join, packing, quality_crf, suffix_dedup, tokens
from lagweave.llm.common import BATCH_BYTES, saved, small_batches, table  # noqa: F401

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    return quality_crf.accepted(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier one holds."""
    return suffix_dedup.without_repeats(docs, length=PASSAGE_BYTES)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.packed_documents(docs, tokens.default_path())


#: Bytes in a row that an earlier document has to hold for them to go: 50 short words; longer than a licence line.
PASSAGE_BYTES = 150


def bounded(stage):
    """The stage under `small_batches`."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", bounded(quality)),
    ("n-gram Jaccard join", bounded(near_duplicates)),
    ("suffix-array dedup", bounded(repeated_passages)),
    ("benchmark decontamination", bounded(benchmark_leaks)),
    ("best-fit packing", bounded(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
