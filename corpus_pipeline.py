"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows its predecessor
kept; all but the last return the columns they got. Null ids and texts, repeated rows, empty tables and
further columns have the results that the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendset.llm import decontaminate, lsh_forest, pieces, pseudonyms, quality, tables
from mendset.llm.queries import DEMO_KEY, piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the weakly supervised rules accept."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more."""
    return lsh_forest.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers and dates under pseudonyms."""
    return pseudonyms.pseudonymised(docs, DEMO_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `piece_ids`, `n_tokens` and `decoded` added."""
    return pieces.tokenized(docs, piece_model())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", tokens),
]

ORACLE_SQL = None  # SQL expresses none of the stages but the first's measures


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = tables.stored(stage(spark, docs, sf_dir))
    return docs
