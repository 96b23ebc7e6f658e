"""Corpus preparation as five stages; each takes the rows that the one before kept, and writes its own as Parquet.

Quality rejects documents, line deduplication cuts repeated lines, near-duplicate groups keep their smallest document, documents that
hold a benchmark passage go, and what is left is encoded and decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scholarloom.llm import bpe, lines, phrases, quality, simhash
from scholarloom.llm.common import stored
from scholarloom.llm.queries import VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.kept_texts(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good), ("line dedup", cut_repeated_lines), ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark), ("byte-level bpe", encoded),
]
#: The first and the third stage are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
