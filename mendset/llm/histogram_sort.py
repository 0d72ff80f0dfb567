"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Documents are ordered by a key of 63 bits, a hash of the text. A splitter between two shards is sought
by probing: each round cuts the interval that must hold it into PROBES parts and counts, over all
partitions, the exact bytes below each cut; the interval narrows until a cut is within TOLERANCE of
the ideal or no key is left between its ends. Shards are the ranges between splitters, so equal texts
share a shard. Where a large group of copies would straddle an ideal cut, the order is drawn anew with
the next seed, at most SEEDS times, and the best balanced order is taken. A group larger than a
shard's share has a shard of its own, and the others share the rest.

Slots count the rows of a shard without gaps. Rows are sorted inside 2 ** (KEY_BITS + SALT_BITS)
buckets, by the leading bits of the key and of a hash of the row, so the copies of one text spread
over 2 ** SALT_BITS of them; the bucket counts (bounded by their number) give each bucket its first slot.

A document's size is the UTF-8 length of its text (null: none) plus 1. Repeated rows are documents of
their own; which of them takes which slot is open. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.llm.tables import stored

KEY_SPAN = 1 << 63
PROBES = 1024
TOLERANCE = 0.001  # of a shard's share
SEEDS = 4
ACCEPTED = 0.02  # imbalance that ends the search for an order
KEY_BITS, SALT_BITS = 10, 6


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def key_of(text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(seed)), 1)


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], float]:
    """First keys of shards 1 to shards - 1 for rows (key, size), and the largest error of a cut as
    a part of a shard's share."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if not total or shards < 2:
        return [KEY_SPAN - 1] * (shards - 1), 0.0
    goals = [total * (j + 1) / shards for j in range(shards - 1)]
    # for each goal: [low, high) holds the splitter, with the exact bytes below low and below high
    ends = [(0, KEY_SPAN, 0, total) for _ in goals]
    allowed = tolerance * total / shards
    while True:
        open_ = sorted({e[:2] for g, e in zip(goals, ends) if e[1] - e[0] > 1 and min(g - e[2], e[3] - g) > allowed})
        if not open_:
            break
        where = F.lit(None).cast("int")
        part = F.lit(None).cast("bigint")
        for n, (low, high) in enumerate(open_):
            step = -(-(high - low) // PROBES)
            inside = (F.col("key") >= low) & (F.col("key") <= high - 1)
            where = F.when(inside, n).otherwise(where)
            part = F.when(inside, F.expr(f"(key - {low}) div {step}")).otherwise(part)
        counted = sizes.select(where.alias("n"), part.alias("part"), "size").filter("n is not null")
        bytes_ = {(r.n, r.part): r.size for r in counted.groupBy("n", "part").agg(F.sum("size").alias("size")).collect()}
        for j, (goal, (low, high, below, upto)) in enumerate(zip(goals, ends)):
            if (low, high) not in open_:
                continue
            n, step, at = open_.index((low, high)), -(-(high - low) // PROBES), below
            for k in range(PROBES):
                cut = min(low + (k + 1) * step, high)
                more = bytes_.get((n, k), 0)
                if at + more >= goal or cut == high:
                    ends[j] = (low + k * step, cut, at, at + more if cut < high else upto)
                    break
                at += more
    cuts, worst = [], 0.0
    for goal, (low, high, below, upto) in zip(goals, ends):
        cuts.append(low if goal - below <= upto - goal else high)
        worst = max(worst, min(goal - below, upto - goal) * shards / total)
    return [min(c, KEY_SPAN - 1) for c in cuts], worst


def own_shards(sizes: DataFrame, shards: int) -> list[int]:
    """Keys whose bytes exceed the share that the other shards have; fewer than `shards` can."""
    rest = sizes.agg(F.sum("size")).first()[0] or 0
    if shards < 2 or not rest:
        return []
    groups = sizes.groupBy("key").agg(F.sum("size").alias("size"))
    # the largest `shards` - 1 groups are enough: each further one is smaller than a share
    largest = groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect()
    giants: list[int] = []
    for r in largest:
        if r["size"] * (shards - len(giants)) <= rest:
            break
        giants.append(r.key)
        rest -= r["size"]
    return giants


def placed(rows: DataFrame, shards: int, row_hash: Column) -> DataFrame:
    """Rows (key0 .. key<SEEDS - 1>, size, ...) with shard and slot; they must come from a table, as
    they are read once for each probe."""
    giants = own_shards(rows.select(F.col("key0").alias("key"), "size"), shards)
    apart = F.col("key0").isin(giants) if giants else F.lit(False)
    best: tuple[float, int, list[int]] | None = None
    for seed in range(SEEDS):
        cuts, error = splitters(rows.filter(~apart).select(F.col(f"key{seed}").alias("key"), "size"), shards - len(giants))
        if best is None or error < best[0]:
            best = (error, seed, cuts)
        if error <= ACCEPTED:
            break
    _, seed, cuts = best
    key = F.col(f"key{seed}")
    shard = sum((F.when(key >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    for n, giant in enumerate(giants):
        shard = F.when(F.col("key0") == giant, shards - len(giants) + n).otherwise(shard)
    bucket = F.shiftright(key, 63 - KEY_BITS) * (1 << SALT_BITS) + F.shiftrightunsigned(row_hash, 64 - SALT_BITS)
    dealt = rows.withColumns({"shard": shard, "_bucket": bucket, "_row": row_hash, "_key": key})
    counts = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    # bounded: at most (2 ** KEY_BITS + shards) * 2 ** SALT_BITS rows of three numbers
    running = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "_row")
    numbered = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    out = numbered.join(F.broadcast(first), ["shard", "_bucket"])
    slot = (F.col("_first") + F.col("_place")).cast("bigint")
    return out.withColumn("slot", slot).drop("_bucket", "_row", "_key", "_first", "_place", *[f"key{s}" for s in range(SEEDS)])


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with `size`, `shard` and `slot` (these names replace columns of the same names).

    The documents are written once with size and keys; only the probes' counts reach the driver.
    """
    own = [c for c in docs.columns if c not in ("size", "shard", "slot") and (keep_text or c != text)]
    t = F.col(text).cast("string")
    keys = [key_of(t, seed).alias(f"key{seed}") for seed in range(SEEDS)]
    table = stored(docs.select(*[F.col(f"`{c}`") for c in own], size_of(t).alias("size"), *keys))
    row = F.xxhash64("size", *[F.col(f"`{c}`") for c in own if c != text])
    return placed(table, shards, row)
