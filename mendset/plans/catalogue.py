"""All registered queries, collected from the modules that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendset.operators.inject import inject
from mendset.operators.records import group_split, to_record
from mendset.operators.taxonomy import fault_dim
from mendset.plans import corpus, datasets, faults, quality, scoring, structure, synthetic  # noqa: F401  (they register)
from mendset.plans.base import QUERIES, SQL
from mendset.sources.corpus import materialized
from mendset.sources.rendered import configs

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the order table to counts per split of all faults, on configs of both families."""
    broken = inject(configs(spark, sf_dir))
    records = group_split(materialized(to_record(broken, fault_dim(spark))))
    return (
        records.select("split", F.explode("fault_types").alias("fault_type"))
        .groupBy("split", "fault_type").agg(F.count("*").alias("records"))
    )
