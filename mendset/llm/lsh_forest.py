"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of their runs of WIDTH words (a text of fewer words is one run of all it has); two
texts are linked where the sets' Jaccard similarity is THRESHOLD or more.

1. Equal texts collapse to one node with the number of its copies.
2. Each node has a path of DEPTH MinHash values in each of TREES prefix tries. It starts with its longest
   prefixes and shortens them, those that open the smallest trie nodes first, until a pair at the
   threshold is met with probability TARGET (`tries.leaves`): crowded trie nodes stay divided by longer
   prefixes as far as sparse ones give the recall.
3. Texts that meet are tied to leaders of their trie node only if their sketches are alike
   (`tries.ties`), so false meetings do not chain. The components of the ties are clusters: every linked
   pair that met lies in one cluster.
4. Clusters are verified exactly, block against block: a task gets two blocks of at most BLOCK_DOCS
   nodes and multiplies their shingle incidence matrices. It returns, for each node, the documents it
   links to and one edge to its local component, so a group of copies never becomes a table of pairs.
5. Classes are the components of the verified links.

Null texts and texts without words have no runs and are linked to none. Repeated rows count as
copies. Rows of one id with different texts are different documents. A null id, or one that is not an
integer, counts as the least; a class it stands for has the class id null. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.llm.components import components
from mendset.llm.flat import BLOCK, mix, slices, text_bytes, windows, word_hashes, word_spans
from mendset.llm.tables import stored
from mendset.llm.tries import LENGTHS, leaves, ties

WIDTH, THRESHOLD = 5, (4, 5)  # similarity as a fraction, so that it is compared exactly
TREES, DEPTH, TARGET = 32, LENGTHS[-1], 0.9995
BLOCK_DOCS, BLOCK_RUNS = 512, 1 << 19
SMALL = 500_000  # rows of up to five numbers that may be broadcast
COLUMNS_AT_ONCE = 1 << 13


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words of a batch, and the index of the text of each."""
    data, offsets = text_bytes(texts)
    doc, starts, ends = word_spans(data, offsets)
    return windows(word_hashes(data, starts, ends), doc, len(texts), WIDTH)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return (random[:n] >> np.uint64(32)).astype(np.uint32), (random[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def paths(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of runs of each text; for each text with runs and each tree the hash of its first
    LENGTHS[0] MinHash values and the values after them; and a byte of every value, as its sketch."""
    hashes, owner = runs(texts)
    counts = np.bincount(owner, minlength=len(texts))
    filled = np.flatnonzero(counts)
    stems = np.zeros((len(filled), TREES), np.uint64)
    after = np.zeros((len(filled), TREES, DEPTH - LENGTHS[0]), np.uint32)
    sketches = np.zeros((len(filled), TREES * DEPTH), np.uint8)
    if len(filled):
        first = (np.cumsum(counts) - counts)[filled]
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        salt, factor = _constants(TREES * DEPTH)
        for t in range(TREES):
            key = np.full(len(filled), t, np.uint64)
            for level in range(DEPTH):
                j = t * DEPTH + level
                least = np.minimum.reduceat((low ^ salt[j]) * factor[j], first)
                sketches[:, j] = least & np.uint32(255)
                if level < LENGTHS[0]:
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + least + np.uint64(1))
                else:
                    after[:, t, level - LENGTHS[0]] = least
            stems[:, t] = key
    return counts, stems, after, sketches


def signature(text: Column) -> Column:
    """struct(runs, paths, sketch): the number of (not necessarily distinct) runs, the path in each tree
    and the sketch; a text without runs has neither path nor sketch."""

    @F.arrow_udf("runs int, paths array<struct<stem: bigint, next: int, last: int>>, sketch binary")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [paths(texts.slice(a, b - a)) for a, b in slices(texts, BLOCK)] or [paths(texts)]
            counts, stems, after, sketches = (np.concatenate(c) for c in zip(*parts))
            path = pa.StructArray.from_arrays(
                [pa.array(c) for c in (stems.ravel().view(np.int64), after[..., 0].ravel().view(np.int32), after[..., 1].ravel().view(np.int32))],
                names=["stem", "next", "last"],
            )
            offsets = lambda width: pa.array(np.append(0, np.cumsum(np.where(counts > 0, width, 0))), pa.int32())
            sketch = pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets(TREES * DEPTH).buffers()[1], pa.py_buffer(sketches.tobytes())])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets(TREES), path), sketch], names=["runs", "paths", "sketch"])

    return signed(text)


def run_set(text: Column) -> Column:
    """The distinct run hashes of a text, sorted."""

    @F.arrow_udf("array<bigint>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            flat, sizes = [], []
            for a, b in slices(texts, BLOCK):
                hashes, owner = runs(texts.slice(a, b - a))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                flat.append(hashes[new])
                sizes.append(np.bincount(owner[new], minlength=b - a))
            offsets = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
            values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))

    return sets(text)


def _adjacency(values: np.ndarray, doc: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which documents of `left` and `right` (indexes) reach the threshold."""
    n = len(sizes)
    order = np.argsort(values, kind="stable")
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, doc = number[column[keep]], doc[keep]
    common = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS_AT_ONCE))
        width = int(column[b - 1]) - lo + 1
        matrix = np.zeros((n, width), np.float32)
        matrix[doc[a:b], column[a:b] - lo] = 1
        common += (matrix[left] @ matrix[right].T).astype(np.int64)
    up, down = THRESHOLD
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common * down >= union * up


def verify(node: np.ndarray, copies: np.ndarray, side: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes of one block (all of side 0) or two blocks (sides 0 and 1): the nodes with a link
    (within the block, or across), the copies they link to, the least node of their component."""
    node, first = np.unique(node, return_index=True)  # a node may come twice if its row was repeated
    starts = (np.cumsum(sizes) - sizes)[first]
    copies, side, sizes = copies[first], side[first], sizes[first]
    doc = np.repeat(np.arange(len(node)), sizes)
    values = values[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    near = _adjacency(values, doc, sizes, left, right)
    if right is left:
        np.fill_diagonal(near, False)
    links = np.zeros(len(node), np.int64)
    links[left] += near @ copies[right]
    if right is not left:
        links[right] += copies[left] @ near
    label = np.arange(len(node))
    while True:
        least = label.copy()
        if len(left) and len(right):
            least[left] = np.minimum(least[left], np.where(near, label[right][None, :], len(node)).min(1))
            least[right] = np.minimum(least[right], np.where(near, least[left][:, None], len(node)).min(0))
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked = links > 0
    return node[linked], links[linked], node[label[linked]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, low, high, side, node, copies, runs) sorted by root, low, high; groups may span batches."""
    held: list[pa.RecordBatch] = []

    def groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = rows.combine_chunks()
        key = np.stack([rows[c].to_numpy() for c in ("root", "low", "high")])
        cut = np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1)
        lists = rows["runs"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint64)
        node, copies, side = (rows[c].to_numpy() for c in ("node", "copies", "side"))
        for a, b in zip(cut, np.append(cut[1:], len(node))):
            sizes = np.diff(offsets[a : b + 1])
            yield verify(node[a:b], copies[a:b], side[a:b], values[offsets[a] : offsets[b]], sizes)

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        found = list(groups(rows))
        columns = [np.concatenate(c) for c in zip(*found)]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["node", "links", "top"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch[c].to_numpy() for c in ("root", "low", "high")])
        change = np.flatnonzero((key != key[:, -1:]).any(0))
        last = int(change[-1]) + 1 if len(change) else 0  # the last group may go on in the next batch
        if held and (last or tuple(key[:, 0]) != tuple(held[-1][c][0].as_py() for c in ("root", "low", "high"))):
            yield from made(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield from made(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield from made(pa.Table.from_batches(held))


def joined_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """A join whose right side is broadcast only up to SMALL rows; beyond, Spark shuffles both."""
    return left.join(F.broadcast(right) if rows <= SMALL else right, on, how)


class Joined:
    """The tables that a join leaves behind: documents, nodes (distinct texts), and their classes."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.text = F.col(text).cast("string")
        self.doc_id = doc_id
        self.digest = {"h1": F.xxhash64(self.text), "h2": F.xxhash64(F.lit(1), self.text), "size": F.coalesce(F.octet_length(self.text), F.lit(-1))}
        keys = ["h1", "h2", "size"]
        signed = docs.select(self.id().alias("doc_id"), *[c.alias(k) for k, c in self.digest.items()], signature(self.text).alias("s"))
        self.docs = stored(signed.select("doc_id", *keys, "s.*", F.monotonically_increasing_id().alias("row")))
        least = F.min("row").alias("node")
        # the node's id is that of its least document; a null id counts as the least
        self.nodes = stored(self.docs.groupBy(*keys).agg(least, F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"), F.count("*").alias("copies"), F.max("runs").alias("n_runs")))
        paths_ = self.docs.join(self.nodes.select(F.col("node").alias("row")), "row", "left_semi").filter("runs > 0")
        tries = stored(paths_.select(F.col("row").alias("node"), "paths", "sketch"))
        up, down = THRESHOLD
        clusters = components(ties(leaves(tries, TREES, up / down, TARGET), tries.select("node", "sketch")))
        self._verify(docs, clusters, keys)

    def id(self) -> Column:
        return F.col(self.doc_id).cast("string").try_cast("bigint")

    def _verify(self, docs: DataFrame, clusters: DataFrame, keys: list[str]) -> None:
        members = stored(clusters.join(self.nodes, "node"))
        n = members.count()
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_runs") / BLOCK_RUNS)).cast("int")
        sized = members.groupBy("root").agg(blocks.alias("blocks"))
        wanted = members.join(sized, "root").select("root", "node", "copies", "blocks", F.col("rep").alias("doc_id"), *keys)
        texts = docs.select(F.coalesce(self.id(), F.lit(-(1 << 63))).alias("doc_id"), *[c.alias(k) for k, c in self.digest.items()], self.text.alias("text"))
        found = joined_small(texts, wanted, ["doc_id", *keys], "inner", n)
        sets = found.select("root", "node", "copies", "blocks", run_set(F.col("text")).alias("runs"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        paired = sets.withColumn("own", own).select(
            "root", "node", "copies", "runs", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        )
        low, high = F.least("own", "other"), F.greatest("own", "other")
        dealt = paired.select("root", low.alias("low"), high.alias("high"), (F.col("own") != low).cast("int").alias("side"), "node", "copies", "runs")
        sorted_ = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
        verified = stored(sorted_.mapInArrow(_verified, "node bigint, links bigint, top bigint"))
        classes = components(verified.select("node", "top"))
        links = verified.groupBy("node").agg(F.sum("links").alias("links"))
        inside = classes.join(self.nodes.select("node", "rep"), "node")
        best = inside.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("best"))
        self.classes = stored(inside.join(best, "root").join(links, "node", "left").select("node", "links", F.col("best.rep").alias("class_id"), F.col("best.node").alias("kept")))

    def per_document(self) -> DataFrame:
        """One row per document: doc_id, digest, node, rep, class_id, kept (node), n_links, times."""
        nodes = self.nodes.join(self.classes, "node", "left")
        full = self.docs.drop("row", "paths", "sketch", "runs").join(nodes, ["h1", "h2", "size"])
        spoken = F.col("n_runs") > 0
        class_id = F.coalesce("class_id", "rep")
        return full.select(
            "doc_id", "h1", "h2", "size", "node", "rep",
            F.when(spoken, F.when(class_id != -(1 << 63), class_id)).otherwise(F.col("doc_id")).alias("class_id"),
            F.coalesce("kept", "node").alias("kept"), spoken.alias("spoken"),
            F.when(spoken, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
        )


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and n_links (documents linked to, copies too)."""
    return Joined(docs, doc_id, text).per_document().select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that another one of their class stands for, with their own columns.

    The document of the least id stays (of rows repeated in full, one). Texts without words all stay.
    """
    joined = Joined(docs, doc_id, text)
    keys = ["h1", "h2", "size"]
    rows = joined.per_document().filter("spoken")
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    out = rows.filter((F.col("node") != F.col("kept")) | (id_ != F.col("rep")))
    gone = stored(out.select(id_.alias("__lsh_id"), *[F.col(k).alias(f"__lsh_{k}") for k in keys]).distinct())
    again = stored(rows.groupBy(id_.alias("__lsh_id"), *[F.col(k).alias(f"__lsh_{k}") for k in keys]).count().filter("count > 1").drop("count"))
    n_gone, n_again = gone.count(), again.count()
    marked = docs.withColumns({"__lsh_id": F.coalesce(joined.id(), F.lit(-(1 << 63))), **{f"__lsh_{k}": c for k, c in joined.digest.items()}})
    on = ["__lsh_id", *[f"__lsh_{k}" for k in keys]]
    left = joined_small(marked, gone, on, "left_anti", n_gone)
    if n_again:  # rows repeated in full: their texts are shuffled, so only where there are any
        single = joined_small(left, again, on, "left_anti", n_again)
        twice = joined_small(left, again, on, "left_semi", n_again)
        left = single.unionByName(twice.dropDuplicates(on))
    return left.drop(*on)
