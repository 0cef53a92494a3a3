"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Between stages the table is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import Stash, small_batches, table
from terrane.llm.op2_mixing import sampled
from terrane.llm.op5_exact_dedup import first_copies
from terrane.llm.op6_minhash import first_of_groups
from terrane.llm.op7_langid import accepted
from terrane.llm.op10_packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_copies(docs, Stash(spark), keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return first_of_groups(docs, Stash(spark), words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled(docs, Stash(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return pack(docs, Stash(spark), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the language machines nor the packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stash = table(spark, sf_dir, "documents"), Stash(spark)
    for name, work in STAGES[:-1]:
        docs = stash.put(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
