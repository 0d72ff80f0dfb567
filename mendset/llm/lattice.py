"""Near-duplicate vectors by lattice hashing, verified by cosine.

Equal vectors become one representative with a weight. Representatives on the unit sphere are projected by
random vectors to groups of 8 coordinates, and each group is decoded to the nearest point of the E8
lattice: that cell is a vector's home in the table. Neighbouring cells whose point lies within 1 of the
projection are probed too: the vector visits them. Cells hold their home vectors and visitors, and each
home vector is compared with all others of its cell by cosine in double precision. A table joins as many
lattice groups to one cell as the number of vectors calls for (see `shape_of`), and there are enough
tables that a pair at the threshold meets with probability RECALL; closer pairs meet more surely.

* Projections are exact multiples of 2**-16, so every task finds the same cells, and a pair that meets in
  several cells is counted in the first of them only: what met before is worked out from the vectors.
* Cells without a home vector or with one row only are dropped before vectors move. A cell over CELL rows
  is dealt out as pairs of parts of it, so no task holds a crowded cell; its pairs are never rows. What a
  cell yields is one number and one edge a row.
* One table after the other is worked off and its sums written, which bounds the disk by one table's rows.

Null, empty and zero vectors, vectors with null or non-finite components and rows with a null id link with
nothing: no links, their own component (null for a null id), kept. Vectors of unequal length are compared
as if zeros followed the shorter one. Rows that repeat an id are vectors of their own, linked as their
vectors are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.llm.components import components
from mendset.llm.flat import FACTOR, mix
from mendset.llm.tables import read, stored, write

COSINE = 0.95
SCALE = 0.8  # of the projections of unit vectors, against a lattice whose nearest points are sqrt(2) apart
MEETS = 0.6  # probability, at the least, that a pair at COSINE meets in one group of 8
CHANCE = 5.6e-4  # that two random vectors do
RANDOM = 4_096  # unlike vectors that a vector may be compared with in each table
RECALL = 0.999
CELL = 1_024
SEED = 13


def _shifts() -> np.ndarray:
    """The 240 shortest points of E8: from a point to its neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = np.array(list(product((-0.5, 0.5), repeat=8)))
    return np.concatenate([np.array(out), halves[(halves < 0).sum(1) % 2 == 0]])


SHIFTS = _shifts()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    rest = x - near
    worst = np.abs(rest).argmax(1)
    at = np.arange(len(x))
    other = near.copy()
    other[at, worst] += np.where(rest[at, worst] >= 0, 1, -1)
    return np.where((near.sum(1) % 2 != 0)[:, None], other, near)


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: all coordinates whole, or all of them halves, with an even sum."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def projector(table: int, groups: int, columns: int) -> np.ndarray:
    """columns x 8 * groups whole numbers; the first rows do not depend on `columns`."""
    rng = np.random.default_rng([SEED, table, groups])
    return np.rint(rng.normal(size=(columns, 8 * groups)) * SCALE * 256)


def units(x: np.ndarray) -> np.ndarray:
    """Rows on the unit sphere; their own largest component is taken out first, so no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def projected(u: np.ndarray, table: int, groups: int) -> np.ndarray:
    """Multiples of 2**-16, from whole numbers that doubles add exactly in any order."""
    whole = np.rint(u * (1 << 14)) @ projector(table, groups, u.shape[1])
    return np.rint(whole / 64) / (1 << 16)


def homes(p: np.ndarray) -> np.ndarray:
    return np.concatenate([decoded(p[:, k : k + 8]) for k in range(0, p.shape[1], 8)], 1)


def cell_key(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit keys of cells; cells that share one are only compared for nothing."""
    key = np.full(len(points), table + 1, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).T:
        key = mix(key * np.uint64(FACTOR) + column.astype(np.uint64))
    return key.view(np.int64)


def visits(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vector, cell and whether it is its home, for all cells within 1 of each projection."""
    owner, cells, home = np.arange(len(p)), np.zeros((len(p), 0)), np.ones(len(p), bool)
    for k in range(0, p.shape[1], 8):
        own = decoded(p[:, k : k + 8])
        off = p[:, k : k + 8] - own
        # |off - shift| <= 1, as shifts have the square 2
        row, shift = np.nonzero(2 * (off @ SHIFTS.T) >= ((off**2).sum(1) + 1)[:, None])
        first = np.concatenate([np.arange(len(p)), row])
        point = np.concatenate([own, own[row] + SHIFTS[shift]])
        is_home = np.concatenate([np.ones(len(p), bool), np.zeros(len(row), bool)])
        order = np.argsort(first, kind="stable")
        first, point, is_home = first[order], point[order], is_home[order]
        n = np.bincount(first, minlength=len(p))
        start = np.cumsum(n) - n
        times = n[owner]  # each cell so far meets each of this group
        at = np.repeat(start[owner], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cells = np.concatenate([np.repeat(cells, times, 0), point[at]], 1)
        home = np.repeat(home, times) & is_home[at]
        owner = np.repeat(owner, times)
    return owner, cells, home


def within(p: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Does the vector projected to p visit (or live in) the cell, row by row?"""
    d = ((p - cells) ** 2).reshape(len(p), -1, 8).sum(2)
    return (d <= 1).all(1)


def shape_of(n: int) -> tuple[int, int]:
    """Lattice groups in a table, and tables, for n vectors."""
    groups = 1
    while n * CHANCE**groups > RANDOM:
        groups += 1
    return groups, int(np.ceil(np.log(1 - RECALL) / np.log(1 - MEETS**groups)))


def matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array as doubles, short rows filled with zeros; which rows can link."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    size = np.asarray(values.value_lengths().fill_null(0)).astype(np.int64)
    numbers = np.asarray(values.flatten().cast(pa.float64()).fill_null(np.nan))
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), int(size.max(initial=0)) or 1))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = numbers
    return out, np.isfinite(out).all(1) & (out != 0).any(1)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, 16 bytes that tell vectors apart (null for those that link with nothing), the vector."""
    for batch in batches:
        x, good = matrix(batch["vec"])
        x += 0.0  # one zero
        last = x.shape[1] - (x[:, ::-1] != 0).argmax(1)  # trailing zeros do not count
        made = [hashlib.blake2b(r[:n].tobytes(), digest_size=16).digest() if g else None for r, n, g in zip(x, last, good)]
        yield pa.record_batch([batch["vec_id"], pa.array(made, pa.binary()), batch["vec"]], names=["vec_id", "digest", "vec"])


def _visiting(table: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cells, home = visits(projected(units(matrix(batch["vec"])[0]), table, groups))
            rep = batch["rep"].take(pa.array(owner))
            yield pa.record_batch([pa.array(cell_key(cells, table)), rep, pa.array(home)], names=["cell", "rep", "home"])

    return run


class Verifier:
    """Links that the rows of one cell, or of two parts of it, show first in this table."""

    def __init__(self, table: int, groups: int, cosine: float):
        self.table, self.groups, self.cosine = table, groups, cosine

    def linked(self, x: np.ndarray, home: np.ndarray, part: np.ndarray, rep: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows; `two`: only those of unlike parts."""
        u, host = units(x), np.flatnonzero(home)
        found = []
        step = max(1, (1 << 20) // len(u))
        for k in range(0, len(host), step):
            some = host[k : k + step]
            i, j = np.nonzero(u[some] @ u.T >= self.cosine - 1e-9)
            i = some[i]
            # of two home rows each pair once; rows of a cell meet in the block of their parts
            fits = (~home[j] | (rep[i] < rep[j])) & (i != j) & ((part[i] != part[j]) if two else True)
            i, j = i[fits], j[fits]
            sure = (u[i] * u[j]).sum(1) >= self.cosine
            found.append((i[sure], j[sure]))
        i, j = (np.concatenate(f) for f in zip(*found))
        first = np.ones(len(i), bool)
        if len(i):
            keep = np.unique(np.concatenate([i, j]))
            i_, j_ = np.searchsorted(keep, i), np.searchsorted(keep, j)
            for t in range(self.table + 1):
                p = projected(u[keep], t, self.groups)
                h = homes(p)
                for k in range(0, len(i), 1 << 16):
                    some = slice(k, k + (1 << 16))
                    a, b = i_[some], j_[some]
                    if t < self.table:
                        first[some] &= ~(within(p[a], h[b]) | within(p[b], h[a]))
                        continue
                    # each may visit the other's home: then the host with the smaller number counts. Keys
                    # may bring together rows that do not meet
                    alike = (h[a] == h[b]).all(1)
                    guest = ~alike & within(p[b], h[a]) & ~(within(p[a], h[b]) & (rep[i[some]] > rep[j[some]]))
                    first[some] &= np.where(home[j[some]], alike, guest)
        return i[first], j[first]

    def of_group(self, x: np.ndarray, home: np.ndarray, part: np.ndarray, rep: np.ndarray, weight: np.ndarray, two: bool) -> list[np.ndarray]:
        i, j = self.linked(x, home, part, rep, two)
        both, other = np.append(i, j), np.append(j, i)
        n = np.bincount(both, weight[other], len(rep)).astype(np.int64)
        least = np.arange(len(rep))  # an edge a row: to the least row that it is linked with, step by step
        while len(i):
            lower = np.minimum(least[i], least[j])
            before = least.copy()
            np.minimum.at(least, i, lower)
            np.minimum.at(least, j, lower)
            least = least[least]
            if (least == before).all():
                break
        has = n > 0
        return [rep[has], n[has], rep[least[has]]]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, out, size = ["rep", "links", "to"], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

        for group in _whole_groups(batches):
            made = self.of_group(*group)
            if len(made[0]):
                out.append(made)
                size += len(made[0])
            if size > 1 << 16:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The groups (cell, a, b) of sorted rows, each as arrays; a group may pass the end of a batch."""
    left: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        keys = np.stack([np.asarray(table[c]).astype(np.int64) for c in ("cell", "a", "b")])
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        cut = int(edge[-1]) if len(edge) else 0
        yield from _split(table.slice(0, cut), edge[:-1] if len(edge) else edge)
        left = table.slice(cut)
    if left is not None and left.num_rows:
        yield from _split(left, np.zeros(0, np.int64))


def _split(table: pa.Table, edge: np.ndarray) -> Iterator[tuple]:
    if not table.num_rows:
        return
    x = matrix(table["vec"])[0]
    home, part, rep, weight, a, b = (table[c].to_numpy() for c in ("home", "part", "rep", "weight", "a", "b"))
    bounds = [0, *edge.tolist(), table.num_rows]
    for s, e in zip(bounds, bounds[1:]):
        if e - s > 1 and home[s:e].any():
            yield x[s:e], home[s:e], part[s:e], rep[s:e], weight[s:e], bool(a[s] != b[s])


def _links(reps: DataFrame, table: int, groups: int, cosine: float) -> DataFrame:
    """rep, links, to: what one table adds."""
    seen = reps.mapInArrow(_visiting(table, groups), "cell bigint, rep bigint, home boolean")
    sizes = seen.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("hosts"))
    parts = F.ceil(F.col("n") / CELL).cast("int")
    sizes = sizes.filter("n > 1 and hosts > 0").select("cell", parts.alias("parts"))
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    met = seen.join(sizes, "cell").withColumn("part", mine)
    # a row of a crowded cell meets each part once, in the group of the two parts
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("cell", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "rep", "home")
    full = met.join(reps.select("rep", "weight", "vec"), "rep")
    dealt = full.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return dealt.select("cell", "a", "b", "part", "rep", "home", "weight", "vec").mapInArrow(Verifier(table, groups, cosine), "rep bigint, links bigint, to bigint")


def grouped(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row."""
    spark = rows.sparkSession
    narrow = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vec"))
    kind = narrow.schema["vec"].dataType.simpleString()
    known = narrow.mapInArrow(_digests, f"vec_id bigint, digest binary, vec {kind}")
    known = known.withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest")))
    classes = known.filter(F.col("digest").isNotNull()).groupBy("digest")
    classes = classes.agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    reps = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    groups, tables = shape_of(reps.count())
    kinds = "rep bigint, links bigint, to bigint"
    found = reduce(DataFrame.unionByName, [read(spark, write(_links(reps, t, groups, cosine)), kinds) for t in range(tables)])
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "to").distinct()).withColumnsRenamed({"node": "rep"})
    joined = reps.select("rep", "digest", "least", "weight").join(counts, "rep", "left").join(roots, "rep", "left")
    joined = joined.select("digest", "least", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = stored(joined)
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "root").select("digest", "n_links", "component_id")
    out = known.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(component == F.col("vec_id"), F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), kept.alias("kept"))
