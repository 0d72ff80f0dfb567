"""Substring deduplication by content-defined chunks.

A gear hash rolls over the words of a text: it takes in the GEAR_WORDS words up to a place and
nothing else. A chunk ends where this hash is the least of any SPAN places in a row that hold the
place, so chunks vary in length, depend on the words around their ends only, and line up again after
an insertion. Ends lie at most SPAN words apart; hence every passage of 51 words holds whole chunks of
MIN_WORDS words in a row at least, and no repeated passage of more than 50 words is missed.

Chunks are known by 128-bit digests of their words. A digest that occurs twice or more is repeated; it
first occurs in the document of the least id. Runs of repeated chunks of MIN_WORDS words or more are
repeated passages. `repeats` lists them, `without_repeats` cuts all but the first occurrence from texts.

Words are runs of characters other than 0x20 and 0x09-0x0D; white space between them does not count.
Null and empty texts have no chunks. Rows that share an id count as one document, a null id as one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.llm.flat import mix, slices, text_bytes, word_hashes, word_spans
from mendset.llm.tables import stored

GEAR_WORDS = 4
SPAN = 11
MIN_WORDS = 25
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def rolled(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The gear hash at each word: h = 2 * h + gear(word), over at most GEAR_WORDS words of the text."""
    first = np.searchsorted(doc, doc)  # the first word of the same text
    place = np.arange(len(hashes))
    out = hashes.copy()
    for k in range(1, GEAR_WORDS):
        there = place - k >= first
        # the shift of the gear hash moves older words up; 16 bits a word let GEAR_WORDS words matter
        out[there] += hashes[place[there] - k] << np.uint64(16 * k)
    return mix(out)


def chunk_ends(gear: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True at the last word of each chunk: the least hash of SPAN places in a row (the last of equal
    ones), and the last word of a text."""
    n = len(gear)
    ends = np.zeros(n, bool)
    if not n:
        return ends
    ends[np.append(doc[1:] != doc[:-1], True)] = True
    if n >= SPAN:
        view = np.lib.stride_tricks.sliding_window_view(gear, SPAN)
        at = np.arange(n - SPAN + 1) + SPAN - 1 - np.argmin(view[:, ::-1], axis=1)
        inside = doc[SPAN - 1 :] == doc[: n - SPAN + 1]  # windows within one text
        ends[at[inside]] = True
    return ends


def chunks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each chunk: its text, first and last byte, number of words, digest (two numbers)."""
    data, offsets = text_bytes(texts)
    doc, starts, ends = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    last = np.flatnonzero(chunk_ends(rolled(hashes, doc), doc))
    first = np.append(0, last[:-1] + 1)[: len(last)]
    words = last - first + 1
    digests = []
    for salt in (np.uint64(0), SECOND):
        # a polynomial of the words' hashes by place in the chunk
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, words).astype(np.uint64)
        terms = mix(hashes ^ salt) * mix(place + np.uint64(1) + salt)
        digests.append(mix(np.add.reduceat(terms, first) + words.astype(np.uint64)) if len(last) else terms)
    base = offsets[doc[first]] if len(last) else first
    return doc[first], starts[first] - base, ends[last] - base, words, digests[0].view(np.int64), digests[1].view(np.int64)


def chunk_rows(docs: DataFrame, doc_id: str, text: str, narrow: bool) -> DataFrame:
    """(h1, h2, doc_id), and unless narrow the chunk's number, bytes and words, of all chunks."""
    schema = "doc_id bigint, h1 bigint, h2 bigint" + ("" if narrow else ", number int, start int, stop int, words int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                doc, start, stop, words, h1, h2 = chunks(batch["text"].slice(a, b - a))
                ids = batch["doc_id"].slice(a, b - a).take(pa.array(doc))
                columns, names = [ids, pa.array(h1), pa.array(h2)], ["doc_id", "h1", "h2"]
                if not narrow:
                    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                    columns += [pa.array(x.astype(np.int32)) for x in (number, start, stop, words)]
                    names += ["number", "start", "stop", "words"]
                yield pa.record_batch(columns, names=names)

    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated passages: doc_id, start and stop (bytes of the UTF-8 text), words, words_removed,
    cuts (array of the byte ranges that `without_repeats` removes), copies (most of any chunk). Runs of
    fewer than `min_words` words are left alone.

    The digests are counted with map-side partial sums and joined back, so a chunk that a third of all
    documents share is neither gathered nor sorted in one task.
    """
    once = chunk_rows(docs, doc_id, text, narrow=True)
    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    known = stored(counted.filter("copies > 1"))
    met = chunk_rows(docs, doc_id, text, narrow=False).join(known, ["h1", "h2"])
    found = stored(met.drop("h2"))
    order = Window.partitionBy("doc_id").orderBy("number", "start", "stop")
    # a chunk that comes twice in its first document is kept at its first place there
    in_first = found.filter("doc_id = first_doc").groupBy("doc_id", "h1").agg(F.min("number").alias("first_number"))
    placed = found.join(in_first, ["doc_id", "h1"], "left")
    gone = (F.col("doc_id") != F.col("first_doc")) | (F.col("number") != F.col("first_number"))
    new = F.coalesce(F.col("number") - F.lag("number").over(order) > 1, F.lit(True)).cast("int")
    marked = placed.withColumns({"gone": gone, "new": new})
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = island.groupBy("doc_id", "island").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("words").alias("words"),
        F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)).alias("words_removed"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("start", "stop")))).alias("cuts"),
        F.max("copies").alias("copies"),
    )
    own = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id")
    return part.filter(F.col("words") >= min_words).select(own, "start", "stop", "words", "words_removed", "cuts", "copies")


def _cut(text: Column, cuts: Column) -> Column:
    """The text without the byte ranges."""

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.to_pylist(), ranges.to_pylist()):
            if t is None or not r:
                out.append(t)
                continue
            raw, kept, at = t.encode(), [], 0
            for c in sorted(r, key=lambda c: c["start"]):
                between = raw[at : c["start"]]
                if not at or between.strip(b" \t\n\x0b\x0c\r"):  # white space between two cuts goes too
                    kept.append(between)
                at = c["stop"]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pa.array(out, pa.string())

    return shortened(text, cuts)


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, found: DataFrame | None = None
) -> DataFrame:
    """The documents with all but the first occurrence of each repeated passage cut from `text`.

    `found` is what `repeats` made of the same documents, where it is at hand.
    """
    found = repeats(docs, doc_id, text, min_words) if found is None else found
    cut = found.filter(F.size("cuts") > 0)
    per = cut.groupBy("doc_id").agg(F.flatten(F.collect_list("cuts")).alias("_cuts"))
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))
    per = per.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "_cuts")
    joined = docs.withColumn("_id", key).join(per, "_id", "left")
    return joined.withColumn(text, _cut(F.col(text).cast("string"), F.col("_cuts"))).drop("_id", "_cuts")
