"""Quality gates for broken texts that come from outside."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from mendset.functions.text import fence_strip, is_blank, line_count, split_lines, strip

MIN_SIMILARITY = 0.7
MAX_CHANGED = 0.2


@F.pandas_udf(DoubleType())
def similarity(gold: pd.Series, broken: pd.Series) -> pd.Series:
    """Character similarity of difflib, with its popular-character rule; no SQL function has it."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(gold, broken)], dtype="float64")


@F.pandas_udf(IntegerType())
def changed_lines(gold: pd.Series, broken: pd.Series) -> pd.Series:
    """Added plus removed lines of the unified diff."""

    def count(a: str, b: str) -> int:
        diff = difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="")
        return max(0, sum(d[:1] in ("+", "-") for d in diff) - 2)

    return pd.Series([count(a, b) for a, b in zip(gold, broken)], dtype="int32")


# a filter on the result must not make Spark run the comparison a second time
similarity = similarity.asNondeterministic()
changed_lines = changed_lines.asNondeterministic()


def similarity_bound(gold: Column, broken: Column) -> Column:
    """An upper bound of the similarity from the lengths alone."""
    both = F.length(gold) + F.length(broken)
    return F.when(both == 0, 1.0).otherwise(2 * F.least(F.length(gold), F.length(broken)) / both)


def changed_bound(gold: Column, broken: Column) -> Column:
    """A lower bound of the changed lines: lines of one text that the other does not have at all."""
    a, b = split_lines(gold), split_lines(broken)
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def similarity_gate(pairs: DataFrame, gold: str, broken: str, least: float = MIN_SIMILARITY) -> DataFrame:
    """Keep pairs at least this similar; lengths alone reject many before Python sees the text."""
    possible = pairs.filter(similarity_bound(F.col(gold), F.col(broken)) >= least)
    return possible.withColumn("similarity", similarity(gold, broken)).filter(F.col("similarity") >= least)


def change_ratio_gate(pairs: DataFrame, gold: str, broken: str, most: float = MAX_CHANGED) -> DataFrame:
    """Keep pairs with a small share of changed lines; the native bound rejects many beforehand."""
    total = F.greatest(line_count(F.col(gold)), F.lit(1))
    possible = pairs.filter(changed_bound(F.col(gold), F.col(broken)) / total <= most)
    ratio = F.col("changed_lines") / total
    return possible.withColumn("changed_lines", changed_lines(gold, broken)).filter(ratio <= most)


def line_bag_gate(pairs: DataFrame, key: str, gold: str, broken: str, most: float = MAX_CHANGED) -> DataFrame:
    """The native change gate: key and changed_lines of pairs whose bags of lines differ by a small share.

    Lines that only moved count as unchanged; everything stays in the JVM, linear in the texts.
    """
    whole = pairs.filter(F.length(gold) + F.length(broken) > 0)
    total = F.greatest(line_count(F.col(gold)), F.lit(1)).alias("total")
    rows = whole.select(key, total, _bag_difference(F.col(gold), F.col(broken)).alias("d"))
    rows = rows.select(key, "total", (F.col("d.added") + F.col("d.removed")).alias("changed_lines"))
    return rows.filter(F.col("changed_lines") / F.col("total") <= most).select(key, "changed_lines")


def empty_gate(pairs: DataFrame, broken: str) -> DataFrame:
    return pairs.filter(~is_blank(F.col(broken)))


def identity_gate(pairs: DataFrame, gold: str, broken: str) -> DataFrame:
    return pairs.filter(strip(F.col(gold)) != strip(F.col(broken)))


def passes_gates(responses: DataFrame, gold: str, response: str) -> DataFrame:
    """All gates in order; the cleaned text is the new column `broken`."""
    kept = empty_gate(responses, response).withColumn("broken", fence_strip(F.col(response)))
    # the cheap gate first; each gate only drops rows, so their order does not matter
    kept = identity_gate(kept, gold, "broken")
    return change_ratio_gate(similarity_gate(kept, gold, "broken"), gold, "broken")


def _bag_difference(gold: Column, broken: Column) -> Column:
    """struct<added,removed>: the lines of both texts are sorted together and merged, in the row itself."""
    signed = lambda c, sign: F.transform(split_lines(c), lambda x: F.struct(x.alias("line"), F.lit(sign).alias("sign")))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit("").alias("line"), zero.alias("net"), zero.alias("added"), zero.alias("removed"))

    def settled(s: Column) -> tuple[Column, Column]:
        return s["added"] + F.greatest(s["net"], zero), s["removed"] + F.greatest(-s["net"], zero)

    def merge(s: Column, x: Column) -> Column:
        same = s["line"] == x["line"]
        added, removed = settled(s)
        return F.struct(
            x["line"].alias("line"),
            (F.when(same, s["net"]).otherwise(zero) + x["sign"]).alias("net"),
            F.when(same, s["added"]).otherwise(added).alias("added"),
            F.when(same, s["removed"]).otherwise(removed).alias("removed"),
        )

    def finish(s: Column) -> Column:
        added, removed = settled(s)
        return F.struct(added.alias("added"), removed.alias("removed"))

    return F.aggregate(F.array_sort(F.concat(signed(gold, -1), signed(broken, 1))), start, merge, finish)


def line_changes(pairs: DataFrame, key: str, gold: str, broken: str) -> DataFrame:
    """Added and removed lines of each pair, as the difference of two bags of lines; nothing is shuffled.

    A pair with a null text, or without any line, has no row.
    """
    whole = pairs.filter(F.length(gold) + F.length(broken) > 0)
    return whole.select(key, _bag_difference(F.col(gold), F.col(broken)).alias("d")).select(key, "d.added", "d.removed")
