"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.llm.tables import forget, read, write

SCHEMA = "u bigint, v bigint"


def _print(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum of their hashes: equal for equal edge sets."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to its least neighbour: the larger ones, or the smaller ones."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (two bigint columns); root is the least node reached.

    Each round is written to the shared folder, so lineage stays short; no node's neighbours are ever
    gathered: least neighbours are partial aggregates, and hubs are joined, which AQE can split.
    Loops, repeated and null edges do no harm.
    """
    spark = edges.sparkSession
    a, b = (F.col(c) for c in edges.columns)
    path = write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    last = _print(read(spark, path, SCHEMA))
    while last[0]:
        larger = write(_star(read(spark, path, SCHEMA), True))
        forget(spark, path)
        path = write(_star(read(spark, larger, SCHEMA), False))
        forget(spark, larger)
        now = _print(read(spark, path, SCHEMA))
        if now == last:
            break
        last = now
    stars = read(spark, path, SCHEMA)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
