"""The corpus pipeline: each stage works on all its predecessor kept.

All stages but the last return the columns of ``documents``. A null or empty text has no language
and goes in the first stage. The second stage decides by row, not by id: of each group of linked rows
exactly one stays, also where ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.llm.fm_index import hit_words, with_benchmark_hits
from bankspark.llm.jaccard import one_of_each_component
from bankspark.llm.language import language_dictionaries, with_language
from bankspark.llm.packing import pack_documents
from bankspark.llm.pseudonyms import pseudonymise
from bankspark.llm.queries import PSEUDONYM_KEY, tokenizer_file
from bankspark.session import configure, fresh_path, ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is rejected (no letters, or a narrow margin) go."""
    ship_package(configure(spark))
    found = with_language(docs, language_dictionaries(docs))
    return found.where("not rejected").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the row with the smallest id of each group of linked ones stays."""
    ship_package(configure(spark))
    return one_of_each_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a hit word, one in twenty of them or more, go."""
    ship_package(configure(spark))
    found = with_benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~((hit_words() > 0) & (20 * hit_words() >= F.col("n_words")))).select("row.*")


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: validated values in texts become pseudonyms; n_chars follows the new text."""
    configure(spark)
    new = pseudonymise(docs, PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all remaining documents into sequences of 2048 tokens."""
    ship_package(configure(spark))
    return pack_documents(docs, tokenizer_file(), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("known_language", known_language),
    ("one_of_each_group", one_of_each_group),
    ("without_benchmark", without_benchmark),
    ("with_pseudonyms", with_pseudonyms),
    ("packed", packed),
]

#: Compression sizes, keyed permutations and tokens are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
