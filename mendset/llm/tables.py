"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a folder of the (equally shared) warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/work").rstrip("/")


def write(df: DataFrame) -> str:
    """Write `df` as a new Parquet table of the shared folder; it goes when Python ends."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear)
    _written.append((df.sparkSession, path))
    return path


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """`df` by way of a table: computed once, cut from its lineage, safe from lost executors."""
    return read(df.sparkSession, write(df), df.schema)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written[:] = [entry for entry in _written if entry[1] != path]


def _clear() -> None:
    for spark, path in list(_written):
        with contextlib.suppress(Exception):  # the session may have ended first
            forget(spark, path)
