"""Hard negatives by exact inner-product search, with segment summaries that bound scores first.

A vector's components become the integers floor(256 * x). Its segments (runs of components) are summed up
by their mean and their deviation, the norm of what is left when the mean is taken off. The inner product
of two segments of w components lies within w * mean * mean -+ deviation * deviation, and so the sums over
all segments bound the score of a pair. Summaries of the finest segments are stored beside each vector;
those of wider ones follow from them exactly. A pair is bounded on wide segments first, then on narrower
ones, and only pairs that may still reach an anchor's results are scored, on all components.

Anchors are searched in blocks of at most BLOCK rows, each sent to the tasks that read the rows; a task
keeps the best few rows of each search, and Spark takes the best of all tasks. The first SEEDS anchors of
a block, which are rows themselves, give each search its first threshold. Nothing is sampled or dropped.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor does a
vector whose product with itself passes 2**62, as its scores need not fit a bigint. Vectors of unequal
length are compared as if zeros followed the shorter one; an empty vector scores 0. Ties go to the smaller
id. A row that is there twice counts twice, but an anchor's own id is never among its results; of rows
that share an anchor's id, the one with the smallest label and vector is the anchor. No rows, no anchors
or no other label give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.llm.tables import read, stored, write

WIDTHS = (16, 4, 2)  # components of a segment, from the first bounds to the last
FINEST, WIDEST = WIDTHS[-1], WIDTHS[0]
BLOCK, SEEDS, TILE = 16_384, 2_048, 1_024
POSITIVES, NEGATIVES = 5, 10
LARGEST = float(1 << 62)
SLACK = 1e-6  # of the product of norms: more than the rounding of the stored summaries
DENSE = 1 / 16  # share of pairs from which whole tiles are multiplied
PREPARED = "vec_id bigint, label bigint, q array<double>, mean array<float>, deviation array<float>"


def dense(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array as a matrix of doubles, short rows filled with zeros; which rows hold numbers only."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    size = np.asarray(values.value_lengths().fill_null(0)).astype(np.int64)
    flat = values.flatten()
    numbers = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = numbers
    finite = np.ones(len(size), bool)
    finite[row[~np.isfinite(numbers)]] = False
    return out, finite & np.asarray(values.is_valid())


def wide(m: np.ndarray, columns: int) -> np.ndarray:
    return m if m.shape[1] == columns else np.pad(m, ((0, 0), (0, columns - m.shape[1])))


def summaries(q: np.ndarray, width: int = FINEST) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of `width` components; q has whole segments."""
    parts = q.reshape(len(q), q.shape[1] // width, width)
    mean = parts.mean(2)
    return mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))


def coarser(mean: np.ndarray, deviation: np.ndarray, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of segments of `to` components from those of `width`."""
    n, k = len(mean), to // width
    m, d = mean.reshape(n, -1, k), deviation.reshape(n, -1, k)
    whole = m.mean(2)
    return whole, np.sqrt((d**2).sum(2) + width * ((m - whole[:, :, None]) ** 2).sum(2))


def at_most(x: np.ndarray) -> np.ndarray:
    """Integers as doubles that are not larger."""
    y = x.astype(float)
    return np.where(np.abs(y) < 1 << 53, y, np.nextafter(y, -np.inf))


@dataclass
class Rows:
    """Vectors with their summaries, padded to whole segments of the widest kind."""

    ids: np.ndarray
    label: np.ndarray
    q: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    norm: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> Rows:
        q, _ = dense(batch["q"])
        q = wide(q, -(-q.shape[1] // WIDEST) * WIDEST)
        mean, deviation = (wide(dense(batch[c])[0], q.shape[1] // FINEST) for c in ("mean", "deviation"))
        levels = [coarser(mean, deviation, FINEST, w) if w > FINEST else (mean, deviation) for w in WIDTHS]
        ids, label = (np.asarray(batch[c]).astype(np.int64) for c in ("vec_id", "label"))
        return Rows(ids, label, q, levels, np.sqrt((q * q).sum(1)))

    def padded(self, columns: int) -> Rows:
        if self.q.shape[1] == columns:
            return self
        levels = [tuple(wide(x, columns // w) for x in pair) for w, pair in zip(WIDTHS, self.levels)]
        return Rows(self.ids, self.label, wide(self.q, columns), levels, self.norm)

    def slice(self, a: int, b: int) -> Rows:
        return Rows(self.ids[a:b], self.label[a:b], self.q[a:b], [(m[a:b], d[a:b]) for m, d in self.levels], self.norm[a:b])

    def __len__(self) -> int:
        return len(self.ids)


def _paired(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of rows x[i] and y[j], a slice of the pairs at a time."""
    out = np.empty(len(i), np.result_type(x, y))
    step = max(1, (1 << 20) // max(x.shape[1], 1))
    for k in range(0, len(i), step):
        out[k : k + step] = np.einsum("pd,pd->p", x[i[k : k + step]], y[j[k : k + step]])
    return out


def scored(anchors: Rows, rows: Rows, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of the wanted pairs (a mask) with low[anchor] <= score <= high[anchor]."""
    i, j = np.nonzero(wanted)
    for width, (am, ad), (rm, rd) in zip(WIDTHS, anchors.levels, rows.levels):
        if not len(i):
            break
        if len(i) > wanted.size * DENSE:
            centre, spread = width * (am @ rm.T)[i, j], (ad @ rd.T)[i, j]
        else:
            centre, spread = width * _paired(am, rm, i, j), _paired(ad, rd, i, j)
        spread += SLACK * (anchors.norm[i] * rows.norm[j] + 1)
        may = (centre + spread >= low[i]) & (centre - spread <= high[i])
        i, j = i[may], j[may]
    x, y = anchors.q, rows.q
    if len(i) and anchors.norm.max() * rows.norm.max() >= 1 << 52:  # beyond what doubles add exactly
        x, y = x.astype(np.int64), y.astype(np.int64)
    score = ((x @ y.T)[i, j] if len(i) > wanted.size * DENSE else _paired(x, y, i, j)).astype(np.int64)
    may = (score >= low[i]) & (score <= high[i])
    return i[may], j[may], score[may]


class Best:
    """The first `k` rows of each search: higher scores first, then smaller ids."""

    def __init__(self, searches: int, k: int):
        self.k, self.searches = k, searches
        self.key, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.append(self.key, key), np.append(self.score, score), np.append(self.ids, ids)
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < self.k
        self.key, self.score, self.ids = key[keep], score[keep], ids[keep]

    def least(self, without: np.ndarray) -> np.ndarray:
        """The score that the next row of each search must reach; `without` where it has fewer than k."""
        out = without.astype(float)
        n = np.bincount(self.key, minlength=self.searches)
        last = np.cumsum(n)[n == self.k] - 1
        out[n == self.k] = at_most(self.score[last])
        return out


class Positives:
    """Each anchor's best rows of its own label."""

    k = POSITIVES

    def __init__(self, anchors: Rows):
        self.anchors, self.floor = anchors, np.full(len(anchors), -np.inf)

    def searches(self) -> int:
        return len(self.anchors)

    def first(self) -> np.ndarray:
        return self.floor

    def range_of(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return floor, np.full(len(self.anchors), np.inf)

    def wanted(self, label: np.ndarray, rows: Rows) -> np.ndarray:
        return label[:, None] == rows.label

    def keys(self, anchor: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return anchor, np.arange(len(anchor))


class Negatives:
    """For each anchor and place of a positive: the best rows of other labels within the positive's window."""

    k = NEGATIVES

    def __init__(self, anchors: Rows, anchor: np.ndarray, place: np.ndarray, score: np.ndarray, low: int, high: int):
        """A negative must score at least `low` and at most `high` hundredths of its positive."""
        self.anchors = anchors
        self.lo = np.full((len(anchors), POSITIVES), np.iinfo(np.int64).max)
        self.hi = np.full((len(anchors), POSITIVES), np.iinfo(np.int64).min)
        whole, rest = score // 100, score % 100  # no product passes 64 bits
        self.lo[anchor, place] = whole * low + -(-(rest * low) // 100)
        self.hi[anchor, place] = whole * high + rest * high // 100
        self.empty = self.lo > self.hi
        self.floor = np.where(self.empty, np.inf, at_most(self.lo)).ravel()

    def searches(self) -> int:
        return self.lo.size

    def first(self) -> np.ndarray:
        return self.floor

    def range_of(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return floor.reshape(self.lo.shape).min(1), np.where(self.empty, -np.inf, -at_most(-self.hi)).max(1)

    def wanted(self, label: np.ndarray, rows: Rows) -> np.ndarray:
        return label[:, None] != rows.label

    def keys(self, anchor: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = (self.lo[anchor] <= score[:, None]) & (score[:, None] <= self.hi[anchor])
        at, place = np.nonzero(fits)
        return anchor[at] * POSITIVES + place, at


def searched(search: Positives | Negatives, rows: Iterator[Rows], floor: np.ndarray | None = None) -> Best:
    best = Best(search.searches(), search.k)
    first = search.first() if floor is None else np.maximum(search.first(), floor)
    anchors = search.anchors
    for some in rows:
        columns = max(anchors.q.shape[1], some.q.shape[1])
        anchors, some = anchors.padded(columns), some.padded(columns)
        for r in range(0, len(some), TILE):
            part = some.slice(r, r + TILE)
            low, high = search.range_of(np.maximum(first, best.least(first)))
            found = []
            for a in range(0, len(anchors), TILE):
                tile = anchors.slice(a, a + TILE)
                wanted = search.wanted(tile.label, part) & (tile.ids[:, None] != part.ids)
                wanted &= (low[a : a + TILE] <= high[a : a + TILE])[:, None]
                i, j, score = scored(tile, part, wanted, low[a : a + TILE], high[a : a + TILE])
                found.append((i + a, j, score))
            i, j, score = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
            key, at = search.keys(i, score)
            if len(key):
                best.add(key, score[at], part.ids[j[at]])
    return best


def _task(search: Positives | Negatives, floor: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = searched(search, (Rows.of(b) for b in batches if b.num_rows), floor)
        yield pa.record_batch([pa.array(best.key), pa.array(best.score), pa.array(best.ids)], names=["key", "score", "id"])

    return run


def _found(prepared: DataFrame, search: Positives | Negatives) -> DataFrame:
    """key, rank, id, score: the best rows of each search, among all rows."""
    seeds = search.anchors.slice(0, SEEDS)
    best = searched(search, iter([seeds]))  # rows too: no result of a search scores less than these
    floor = best.least(np.full(search.searches(), -np.inf))
    found = prepared.mapInArrow(_task(search, floor), "key bigint, score bigint, id bigint")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.k)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, finite = dense(batch["vector"])
        with np.errstate(over="ignore", invalid="ignore"):
            q = np.floor(256 * x)
            finite &= (q * q).sum(1) <= LARGEST
        size = np.asarray(batch["vector"].value_lengths().fill_null(0)).astype(np.int64)[finite]
        q = wide(q[finite], -(-q.shape[1] // WIDEST) * WIDEST)
        mean, deviation = summaries(q)
        lists = lambda m, n, kind: pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(m[np.arange(m.shape[1]) < n[:, None]], kind))
        parts = -(-size // FINEST)
        kept = [batch[c].filter(pa.array(finite)) for c in ("vec_id", "label")]
        made = [lists(q, size, pa.float64()), lists(mean, parts, pa.float32()), lists(deviation, parts, pa.float32())]
        yield pa.record_batch([*kept, *made], names=["vec_id", "label", "q", "mean", "deviation"])


def prepared(rows: DataFrame, vec_id: str = "vec_id", label: Column | str = "label", vector: str = "embedding") -> DataFrame:
    """The rows that take part: vec_id, label, quantised vector, summaries of its finest segments."""
    label = F.col(label) if isinstance(label, str) else label
    narrow = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(vector).alias("vector"))
    whole = narrow.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    return whole.mapInArrow(_prepare, PREPARED)


def mined(rows: DataFrame, is_anchor: Column, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of prepared rows (see
    `prepared`). `is_anchor` tells anchors by their columns; a negative scores `low` to `high` hundredths
    of its positive."""
    spark = rows.sparkSession
    table = stored(rows)
    alike = F.struct("label", "q")
    anchors = table.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct(alike.alias("by"), "mean", "deviation")).alias("least"))
    anchors = stored(anchors.select("vec_id", "least.by.label", "least.by.q", "least.mean", "least.deviation"))
    count = anchors.count()
    blocks = -(-count // BLOCK) if count <= BLOCK else -(-count * 9 // (8 * BLOCK))
    results = []
    for b in range(blocks):
        block = Rows.of(anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow())
        if not len(block):
            continue
        near = _found(table, Positives(block)).toArrow()
        anchor, place, score, ids = (np.asarray(near[c]).astype(np.int64) for c in ("key", "rank", "score", "id"))
        search = Negatives(block, anchor, place - 1, score, low, high)
        found = _found(table, search)
        positive = spark.createDataFrame(
            pa.table({"key": anchor * POSITIVES + place - 1, "anchor_id": block.ids[anchor], "positive_id": ids, "positive_score": score})
        )
        columns = ["anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        results.append(write(found.join(positive, "key").select(*columns)))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    parts = [read(spark, path, schema) for path in results] or [spark.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, parts)
