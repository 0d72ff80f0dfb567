"""Prefix tries of MinHash paths: which texts meet where, and the ties among those that meet.

A path of a text in a tree is (stem, next, last): the hash of its first LENGTHS[0] MinHash values (the
tree's number goes into it), and the two values after them. A trie node is the set of the paths that
share a prefix, so a tree's nodes are the groups of equal prefixes of a table of paths; sizes are
partial aggregates, and no node is ever gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.llm.tables import stored

LENGTHS = (6, 7, 8)  # of the prefixes, in values
CROWD = 64  # texts; a trie node of more is opened only where the recall of one of them needs it
TIED, SURE, ROUNDS = 0.5, 0.85, 3


def weight(length: int, similarity: float) -> float:
    """What a tree met at this prefix length adds to -ln(chance that a pair is missed)."""
    return -math.log1p(-(similarity**length))


def leaves(tries: DataFrame, trees: int, similarity: float, target: float) -> DataFrame:
    """(node, leaf): in each tree, the trie node in which a text is compared, if another text is there.

    Each text starts with its longest prefix in every tree and shortens prefixes, those that open the
    smallest trie nodes first, until a pair of the given similarity is met with probability `target`.
    Trie nodes of up to CROWD texts cost little and are always open at the shortest prefix; a crowded
    one stays divided by longer prefixes unless some text needs it. All texts of an open trie node
    take part in it, so a pair is met if either of its texts reaches the target.
    """
    short, middle, long = LENGTHS
    met = tries.select("node", F.explode("paths").alias("path")).select("node", "path.*")
    stems = met.groupBy("stem").agg(F.count("*").alias("stem_size")).filter("stem_size > 1")
    matched = stored(met.join(stems, "stem"))
    sparse = matched.filter(F.col("stem_size") <= CROWD).select("node", F.col("stem").alias("leaf"))
    crowd = matched.filter(F.col("stem_size") > CROWD)
    if crowd.isEmpty():
        return sparse
    twigs = crowd.groupBy("stem", "next").agg(F.count("*").alias("twig_size"))
    step = lambda size, length: F.struct(F.col(size).alias("size"), F.lit(length).alias("length"), F.lit(weight(length, similarity) - weight(length + 1, similarity)).alias("gain"))
    steps = crowd.join(twigs, ["stem", "next"]).select(
        "node", "stem", "next", "last", F.explode(F.array(step("twig_size", middle), step("stem_size", short))).alias("step")
    )
    own = Window.partitionBy("node")  # two steps for each of a text's trees
    before = own.orderBy("step.size", "stem", F.desc("step.length")).rowsBetween(Window.unboundedPreceding, -1)
    crowded = F.count("*").over(own) / 2
    start = crowded * weight(long, similarity) + (trees - crowded) * weight(short, similarity)
    reached = start + F.coalesce(F.sum("step.gain").over(before), F.lit(0.0))
    taken = steps.withColumn("length", F.when(reached < -math.log(1 - target), F.col("step.length")).otherwise(long))
    chosen = stored(taken.groupBy("node", "stem", "next", "last").agg(F.min("length").alias("length")))
    wide = chosen.filter(F.col("length") == short).select("stem").distinct().withColumn("wide", F.lit(True))
    half = chosen.filter(F.col("length") == middle).select("stem", "next").distinct().withColumn("half", F.lit(True))
    leaf = F.when(F.col("wide"), F.col("stem")).when(F.col("half"), F.xxhash64("stem", "next")).otherwise(F.xxhash64("stem", "next", "last"))
    return sparse.union(chosen.join(wide, "stem", "left").join(half, ["stem", "next"], "left").select("node", leaf.alias("leaf")))


def _bytes(values: pa.Array) -> np.ndarray:
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(values), -1)


def agreement(left: Column, right: Column) -> Column:
    """The share of equal bytes of two binary columns of one length."""

    @F.arrow_udf("double")
    def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_bytes(a) == _bytes(b)).mean(1) if len(a) else np.zeros(0))

    return agreeing(left, right)


def ties(found: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, low): the texts of each leaf tied to leaders of the leaf, unless clearly unlike them.

    Sketches are bytes of MinHash values; the share of bytes that differ is a metric, and at the
    threshold it is below SURE - TIED but for six standard deviations. Of a pair above the threshold in
    one leaf, either one differs from the leader by at most 1 - SURE, and then both differ by at most
    1 - TIED and are tied to it; or both go on, without the leader, to the next round. So no pair is
    lost, and unlike texts that share a prefix (a boilerplate) are not tied. What is left after ROUNDS
    is tied to its last leader uncompared, which can only make a cluster larger.
    """
    out, rest = None, found
    for turn in range(ROUNDS + 1):
        lead = rest.groupBy("leaf").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
        pairs = stored(rest.join(lead, "leaf").filter("node <> low").select("leaf", "node", "low"))
        once = pairs.select("node", "low").distinct()
        if turn == ROUNDS:
            return out.union(once)
        left = sketches.select("node", F.col("sketch").alias("a"))
        right = sketches.select(F.col("node").alias("low"), F.col("sketch").alias("b"))
        compared = stored(once.join(left, "node").join(right, "low").select("node", "low", agreement(F.col("a"), F.col("b")).alias("share")))
        tied = compared.filter(F.col("share") >= TIED).select("node", "low")
        out = tied if out is None else out.union(tied)
        rest = pairs.join(compared.filter(F.col("share") < SURE).select("node", "low"), ["node", "low"]).select("leaf", "node")
        if compared.filter(F.col("share") < SURE).isEmpty():
            return out
