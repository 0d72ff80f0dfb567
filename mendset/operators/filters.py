"""Filters, first-wins deduplication and caps on an incoming corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.functions.text import count_of, strip

# What counts as a secret, the size limits, the file-name hints and the markers.
SECRETS = r'(?id)(AKIA[0-9A-Z]{16}|aws_secret_access_key|password\s*=\s*".{8,}")'
MAX_CHARS = 500 * 1024
MIN_CHARS = 50
MIN_RESOURCES = 2
HINTS = ["template", "cfn", "cloudformation", "stack"]
MARKERS = ["AWSTemplateFormatVersion", "Resources"]


def has_no_secret(text: Column) -> Column:
    return ~text.rlike(SECRETS)


def has_fair_length(text: Column, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Column:
    return (F.length(text) <= max_chars) & (F.length(strip(text)) >= min_chars)


def hcl_block_count(text: Column) -> Column:
    return count_of(text, "resource ") + count_of(text, "data ") + count_of(text, "module ")


def is_dense_hcl(text: Column, min_resources: int = MIN_RESOURCES) -> Column:
    return hcl_block_count(text) >= min_resources


def is_dense_template(text: Column, min_resources: int = MIN_RESOURCES) -> Column:
    marked = text.contains("AWSTemplateFormatVersion") | text.contains("Resources:") | text.contains('"Resources"')
    typed = count_of(text, "Type: AWS::") + count_of(text, '"Type": "AWS::')
    return marked & (typed >= min_resources)


def has_name_hint(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(r"\.(yaml|yml|json)\z") & low.rlike("|".join(HINTS))


def has_marker(text: Column) -> Column:
    return text.contains(MARKERS[0]) | text.contains(MARKERS[1])


def passes_filters(text: Column, fmt: Column, min_resources: int = MIN_RESOURCES) -> Column:
    """All text filters, cheap ones first."""
    dense = (
        F.when(fmt == "terraform", is_dense_hcl(text, min_resources))
        .when(fmt == "cloudformation", is_dense_template(text, min_resources))
        .otherwise(False)
    )
    return has_fair_length(text) & dense & has_no_secret(text)


def first_per_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row with the lowest `seq` of each key; `seq` must be unique.

    The winners are found by a map-side combined min over (keys, seq) alone, so a key that holds a
    third of all rows costs one row per task. The full rows are then matched on the unique seq,
    which cannot be skewed. Nothing is ever ordered inside a key.
    """
    winners = rows.groupBy(*keys).agg(F.min(seq).alias(seq)).select(seq)
    return rows.join(winners, seq, "left_semi")


def last_per_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    winners = rows.groupBy(*keys).agg(F.max(seq).alias(seq)).select(seq)
    return rows.join(winners, seq, "left_semi")


def sha_dedup(rows: DataFrame, passes: Column) -> DataFrame:
    """First row per sha among those that pass; a failing first copy does not hide later ones."""
    return first_per_key(rows.filter(passes), ["sha"])


def soft_cap(rows: DataFrame, query: str, cap: int) -> DataFrame:
    """Rows of the queries taken, in order, until `cap` rows are reached; the last one stays whole.

    Each query present has at least one row, so only the first `cap` of them can be taken; the
    running sum therefore sees at most `cap` rows, and so does the broadcast. The first query is
    always taken.
    """
    cap = max(cap, 1)
    counts = rows.groupBy(query).agg(F.count("*").alias("rows")).orderBy(query).limit(cap)
    before = F.sum("rows").over(Window.orderBy(query).rowsBetween(Window.unboundedPreceding, -1))
    taken = counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < cap)
    return rows.join(F.broadcast(taken.select(query)), query, "left_semi")


def hard_cap(rows: DataFrame, query: str, seq: str, cap: int) -> DataFrame:
    return soft_cap(rows, query, cap).orderBy(query, seq).limit(cap)


def gold_filter(configs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    return configs.join(verdicts.filter("valid").select(key), key, "left_semi")


def changed_set(staged: DataFrame, unstaged: DataFrame) -> DataFrame:
    """Distinct changed paths with a known extension, sorted."""
    both = staged.select("path").union(unstaged.select("path")).distinct()
    return both.filter(F.col("path").rlike(r"\.(tf|yaml|yml|json)\z")).orderBy("path")
