"""A landing store that is kept in buckets, so that each run merges into it without moving what is there.

The store is a table (format, key, seq, content), bucketed and sorted by (format, key). A run of collected
files is reduced to the last file of each key, dealt to the same buckets and merged with them: the file
with the higher seq wins, and of equal ones the newer run's. Only the run's own rows are shuffled. Every
run makes a new version of the store and leaves the old one whole until it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendset.sources.corpus import land

KEY = ["format", "key"]
VALUES = ["seq", "content"]


def _save(rows: DataFrame, table: str, buckets: int, path: str | None) -> None:
    # one file for each bucket: a task holds whole buckets
    placed = rows.select(*KEY, *VALUES).repartition(buckets, *KEY)
    writer = placed.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def begin(files: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """The first run: files (seq, repo, path, format, content) become a new store, in the warehouse or
    at `path`.

    `buckets` stays for the store's life; a bucket should fit a task, so count on the corpus to come.
    """
    _save(land(files), table, buckets, path)


def merged(spark: SparkSession, table: str, files: DataFrame) -> DataFrame:
    """format, key, seq, content of the store after one more run."""
    old = spark.table(table).select(*KEY, F.struct(*VALUES).alias("old"))
    new = land(files).select(*KEY, F.struct(*VALUES).alias("new"))
    # keys of both sides are hashed alike; MERGE keeps the store's buckets where they are
    met = old.hint("merge").join(new, KEY, "full_outer")
    stays = F.col("new").isNull() | (F.col("old.seq") > F.col("new.seq"))
    return met.select(*KEY, F.when(F.coalesce(stays, F.lit(False)), F.col("old")).otherwise(F.col("new")).alias("file")).select(*KEY, "file.*")


def land_again(spark: SparkSession, table: str, files: DataFrame, to: str, path: str | None = None) -> None:
    """One more run: the store `to` is `table` with the run's files."""
    _save(merged(spark, table, files), to, buckets_of(spark, table), path)


def buckets_of(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)
