"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import language_id, mixing
from cellweave.llm.decontaminate import without_contaminated
from cellweave.llm.ngram_join import first_of_each
from cellweave.llm.pii import key_of, pseudonymise
from cellweave.llm.support import remove, shared_folder, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; dictionaries come from the labels of the documents themselves."""
    dictionaries = language_id.learn(docs)
    return language_id.language_id(docs, dictionaries).where("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of linked documents."""
    return first_of_each(docs).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pseudonymise(docs, key_of(spark)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", by_language),
    ("ngram_join", near_duplicates),
    ("decontaminate", no_benchmark),
    ("pii", surrogates),
    ("mixing", mixed),
]

#: Compression and learned dictionaries have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
