"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in a plain form: lower case, white space runs as one space. An item of m
characters may be found with up to m // ERRORS_PER edits. It is split into that many pieces plus one,
so every such occurrence holds one piece unchanged (pigeonhole); an Aho-Corasick automaton finds all
pieces of all items in one pass over a text, and Myers' bit-parallel algorithm verifies the window
around each hit. The result is complete: no occurrence within the budget is missed.

Null and empty texts and items match nothing. Items too short for an edit must be whole words.
Repeated items give a row each; repeated documents too. Documents are read in place: no shuffle. The
items are a query set; they travel to the tasks in blocks of at most BLOCK_CHARS characters, one pass
over the documents for each block, so their size is bounded whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS_PER = 16  # characters of an item for each edit allowed
BLOCK_CHARS = 8_000_000

HIT = "array<struct<item: int, distance: int, start: int, end: int>>"


def plain(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character of `text`: the distance of the pattern to the best substring that ends
    here, or to the whole text so far (anchored)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        yield score


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[str]):
        self.items = [plain(i) for i in items]
        self.errors = [len(i) // ERRORS_PER for i in self.items]
        self.masks = [_masks(i) for i in self.items]
        self.back = [_masks(i[::-1]) for i in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for at, piece in pieces_of(item, self.errors[n]) if item else []:
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) in the plain text, the best occurrence of each item found."""
        text = plain(text)
        if self.empty or not text:
            return []
        begins: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, at in where:
                begins.setdefault(n, set()).add(last + 1 - size - at)
        out = []
        for n in sorted(begins):
            best = self._verify(n, text, sorted(begins[n]))
            if best:
                out.append((n, *best))
        return out

    def _verify(self, n: int, text: str, begins: list[int]) -> tuple[int, int, int] | None:
        item, k = self.items[n], self.errors[n]
        m = len(item)
        best: tuple[int, int] | None = None
        at = 0
        while at < len(begins):
            to = at
            while to + 1 < len(begins) and begins[to + 1] - begins[to] <= 2 * k:
                to += 1
            lo, hi = max(0, begins[at] - k), min(len(text), begins[to] + m + k)
            at = to + 1
            if k == 0:
                whole = (lo == 0 or text[lo - 1] == " ") and (hi == len(text) or text[hi] == " ")
                if hi - lo == m and text[lo:hi] == item and (m >= ERRORS_PER or whole) and (best is None or (0, hi) < best):
                    best = (0, hi)
                continue
            found = min((d, lo + i + 1) for i, d in enumerate(myers(self.masks[n], m, text[lo:hi])))
            if found[0] <= k and (best is None or found < best):
                best = found
        if best is None:
            return None
        distance, end = best
        reverse = text[max(0, end - m - k) : end][::-1]
        length = next(i + 1 for i, d in enumerate(myers(self.back[n], m, reverse, True)) if d == distance)
        return distance, end - length, end


def hits(text: Column, items: list[str]) -> Column:
    """array of (item index, distance, start, end) for one block of items."""
    matcher: list[Matcher] = []

    @F.arrow_udf(HIT)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not matcher:
            matcher.append(Matcher(items))
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("item", "distance", "start", "end")]))
        for texts in batches:
            rows = (matcher[0].find(t) for t in texts.to_pylist())
            yield pa.array(
                [[{"item": n, "distance": d, "start": a, "end": b} for n, d, a, b in row] for row in rows], kind
            )

    return found(text.cast("string"))


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, in blocks of bounded size (the driver holds one at a time)."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)
    size = rows.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // BLOCK_CHARS))
    for b in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield [r.id for r in block], [r.text for r in block]


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end (in the plain text) of every item found in a document."""
    kind = items.schema[item_id].dataType
    parts = []
    for ids, texts in item_blocks(items, item_id, text):
        names = F.array(*[F.lit(i).cast(kind) for i in ids]) if ids else F.array().cast(f"array<{kind.simpleString()}>")
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(hits(F.col(text), texts)).alias("hit"))
        parts.append(rows.select("doc_id", F.get(names, F.col("hit.item")).alias("item_id"), "hit.distance", "hit.start", "hit.end"))
    return reduce(DataFrame.unionByName, parts)


def decontaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    for _, texts in item_blocks(items, item_id, item_text):
        docs = docs.filter(F.size(hits(F.col(text), texts)) == 0)
    return docs
