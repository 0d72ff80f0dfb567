"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendset.llm import chunks, class_lm, decontaminate, hard_negatives, histogram_sort, lattice, licenses, lsh_forest, phrases, pieces, pseudonyms, quality, urls
from mendset.llm.cross_sql import SQL
from mendset.llm.tables import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pieces.tokenized(docs, piece_model())
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(chunks.repeats(docs))
    left = chunks.without_repeats(docs, found=found).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    # rows of one id are one document: its texts are told together
    rest = left.groupBy("doc_id").agg(F.sum(F.length("text")).alias("left_chars"), F.min(F.sha2("text", 256)).alias("left_sha256"))
    return found.select("doc_id", "start", "stop", "words", "words_removed", "copies").join(rest, "doc_id", "left")


# The rules of the registered query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, URL_RULES).drop("url")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judged(docs, keep_text=False)
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", "p_good", "votes")


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    # of the text that came with the exchange
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    grown = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", grown)


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), unknown=False)


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The key of the registered queries; a user passes one that is kept secret.
DEMO_KEY = b"mendset demonstration key"


@query
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, DEMO_KEY, kinds="kinds")


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"), label=moved)
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


@query
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.grouped(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
