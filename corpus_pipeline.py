"""From raw documents to packed sequences: five stages, each a DataFrame to a DataFrame.

STAGES lists them in order; each takes (spark, docs, sf_dir) and works on all
rows its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import table
from factlake.llm.decontaminate import clean_documents
from factlake.llm.language_ppm import keep_known_languages
from factlake.llm.ngram_jaccard_join import one_of_each_group
from factlake.llm.packing import pack_documents
from factlake.llm.secret_ledger import redact_history
from factlake.session import materialize, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    ship_package(spark)
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    ship_package(spark)
    return one_of_each_group(docs, words=5, numerator=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return redact_history(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("packing", packing),
]

# A learnt language model and a tokeniser cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
