"""Reading corpora and records, landing collected files, and writing results."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mendset.operators.filters import last_per_key
from mendset.operators.formats import suffix

# Extensions of a corpus and the size a file must exceed.
EXTENSIONS = [".tf", ".yaml", ".yml", ".json", ".template"]
MIN_BYTES = 50

RECORD_SCHEMA = (
    "id string, format string, gold_config string, broken_config string, errors array<string>, "
    "warnings array<string>, fault_types array<string>, fault_description string, "
    "difficulty string, source string, split string, gold_hash string"
)
BENCHMARK_SCHEMA = (
    "id string, format string, broken_config string, errors array<string>, warnings array<string>, "
    "fault_types array<string>, difficulty string, gold_config string, gold_hash string"
)


def keep_corpus_files(files: DataFrame) -> DataFrame:
    """Files (path, length) with a corpus extension, no hidden path part and more than 50 bytes."""
    path = F.col("path")
    return files.filter(
        suffix(path).isin(*EXTENSIONS) & ~path.rlike(r"(^|/)\.[^/]") & (F.col("length") > MIN_BYTES)
    )


def _corpus_files(spark: SparkSession, root: str) -> DataFrame:
    # the reader lists only files of a corpus extension, so no other file's bytes are loaded
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.option("pathGlobFilter", "*{" + ",".join(EXTENSIONS) + "}").load(root)
    relative = F.regexp_replace(F.col("path"), r"^(file:|[a-z0-9]+://[^/]*)?/*", "/")
    return keep_corpus_files(files.withColumn("path", relative)).withColumn("text", F.col("content").cast("string"))


def corpus_scan(spark: SparkSession, root: str, ordered: bool = True) -> DataFrame:
    """path, text, length of all corpus files below `root` that are UTF-8 (see corpus_rejects).

    In path order; ordered=False leaves out that sort, which moves all texts of a large corpus.
    """
    found = _corpus_files(spark, root).filter(F.is_valid_utf8("text")).select("path", "text", "length")
    return found.orderBy("path") if ordered else found


def corpus_rejects(spark: SparkSession, root: str) -> DataFrame:
    """path, length, reason of the corpus files that corpus_scan leaves out."""
    files = _corpus_files(spark, root)
    return files.filter(~F.is_valid_utf8("text")).select("path", "length", F.lit("not UTF-8").alias("reason"))


def write_files(files: DataFrame, root: str) -> None:
    """Write files (path, content) below `root`, a folder that driver and executors mount; a path that
    comes twice is one file. Each task writes its own rows, so a repeated task writes them again."""
    scheme, colon, rest = root.partition(":")
    if colon and scheme != "file":
        raise ValueError(f"not a mounted folder: {root}")
    folder = "/" + rest.lstrip("/") if colon else root

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            target = os.path.join(folder, row.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as file:
                file.write(row.content)

    os.makedirs(folder, exist_ok=True)  # a scan of no files finds an empty folder
    files.foreachPartition(write)


def record_scan(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """JSON lines with an explicit schema: unknown keys are dropped, missing ones are null."""
    return spark.read.schema(schema).json(path)


def parse_records(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for JSON text in a column: `parsed` holds the known fields only."""
    return lines.withColumn("parsed", F.from_json(column, schema))


def landing_key(repo: Column, path: Column, extension: Column) -> Column:
    safe = F.translate(F.concat(repo, F.lit("__"), path), "/\\", "__")
    return F.when(F.endswith(safe, extension), safe).otherwise(F.concat(safe, extension))


def landing_extension(fmt: Column, path: Column) -> Column:
    return (
        F.when(fmt == "terraform", ".tf").when(path.endswith(".json"), ".json").otherwise(".yaml")
    )


def land(files: DataFrame) -> DataFrame:
    """Files (seq, repo, path, format, content) under their storage keys; the last of a key wins."""
    keyed = files.withColumn(
        "key", landing_key(F.col("repo"), F.col("path"), landing_extension(F.col("format"), F.col("path")))
    )
    return last_per_key(keyed, ["format", "key"])


def module_flatten(modules: DataFrame) -> DataFrame:
    """Modules (namespace, name, configs array<struct<filename,content>>) to one row per file."""
    rows = modules.select("namespace", "name", F.explode("configs").alias("file"))
    key = F.concat_ws("__", F.lit("registry"), "namespace", "name", "file.filename")
    return rows.select(key.alias("key"), "file.content")


def landing_counts(files: DataFrame) -> DataFrame:
    """Rows per source and format; both formats are present for every source."""
    formats = F.array(F.lit("terraform"), F.lit("cloudformation"))
    per_source = files.groupBy("source").agg(
        *[F.count_if(F.col("format") == f).alias(f) for f in ("terraform", "cloudformation")]
    )
    return per_source.select("source", F.explode(formats).alias("format"), "terraform", "cloudformation").select(
        "source",
        "format",
        F.when(F.col("format") == "terraform", F.col("terraform")).otherwise(F.col("cloudformation")).alias("rows"),
    )


def split_sink(records: DataFrame, path: str, ordered: bool = True) -> None:
    """JSON lines, one folder per split, in the order of (gold_hash, seq).

    The order holds across the files of a split: rows are range-partitioned by it. `seq` is part of
    the range key, so the records of one much-copied text can still spread over several tasks.
    ordered=False skips that exchange and sorts inside the files only.
    """
    rows = records.withColumn("folder", F.col("split"))
    key = ["folder", "gold_hash", "seq"]
    placed = rows.repartitionByRange(*key) if ordered else rows
    placed.sortWithinPartitions(*key).drop("seq").withColumnRenamed("folder", "split_folder").write.partitionBy(
        "split_folder"
    ).mode("overwrite").json(path, ignoreNullFields=False)


def benchmark_rows(selected: DataFrame) -> DataFrame:
    """The nine benchmark columns, with defaults for warnings and gold_hash."""
    return selected.select(
        "id", "format", "broken_config", "errors",
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        "fault_types", "difficulty", "gold_config",
        F.coalesce("gold_hash", F.lit("")).alias("gold_hash"),
    )


def benchmark_sink(selected: DataFrame, path: str) -> None:
    benchmark_rows(selected).write.mode("overwrite").json(path, ignoreNullFields=False)


def chat_split_sink(chats: DataFrame, path: str) -> None:
    """Chat rows (split, messages) in folders train, valid and test; absent splits make no folder."""
    renamed = F.when(F.col("split") == "val", "valid").otherwise(F.col("split"))
    chats.select(renamed.alias("split"), "messages").write.partitionBy("split").mode("overwrite").json(path)


def new_path(spark: SparkSession, folder: str | None = None) -> str:
    """A fresh path below `folder`, or below the shared folder of `spark.checkpoint.dir`, or where that
    is unset below the warehouse, which executors share too. It is deleted when Python ends."""
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
    path = f"{folder.rstrip('/')}/mendset-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialized(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write rows as a table once and read them back, for plans that use them several times.

    The table lies at a `new_path`: it survives lost executors, and readers get column pruning.
    """
    path = new_path(rows.sparkSession, folder)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
