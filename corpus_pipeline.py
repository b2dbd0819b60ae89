"""Corpus pipeline: documents of good quality, one of each near-duplicate group, without personal data, packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of ``documents``; the last returns the pieces of packed sequences. Nulls, empty texts, repeated rows and empty
tables are handled as the operators' docstrings say. There is no SQL for the whole (ORACLE_SQL is None): a learnt
classifier, 64-bit hashes and a tokenizer are in it; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelattice.llm import neardocs, packing, pii, quality
from cuelattice.llm.common import saved, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, learnt on ``labels``, rejects."""
    return quality.quality_filter(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of five-word shingle similarity 0.8 or more, by SimHash comparison."""
    return neardocs.drop_near_duplicates(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return pii.mask_pii(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all documents that are left into sequences; the pieces hold their ids."""
    return packing.pack(docs, keep_ids=True)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near), ("pii", mask_personal), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written out before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
