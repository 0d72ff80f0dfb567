"""Phrase collocations by prefix-free parsing.

Texts are parsed into chunks: a chunk ends after TRIGGER words whose joint hash is 0 modulo EVERY, and the
next one begins with the last TRIGGER words before it, so chunks depend on what stands in them and overlap
by TRIGGER words. Equal chunks of a language are one entry of a dictionary, with the number of times the
parse holds it. All phrases are counted inside the dictionary's entries, weighted by that number; a phrase
belongs to the chunk in which its last word lies beyond the overlap, so each is counted once.

A phrase can only be frequent if all its words, and all its pairs of words, are. So words are counted
first, then pairs (by hash), then phrases; between these steps the frequent ones travel as Bloom filters of
FILTER bits, whatever the corpus. A filter only passes over what is surely rare: what it lets through is
counted as text, so counts are exact and no result depends on hashes.

Null texts are empty, null languages are `und`. Case of A-Z is ignored; texts are split at .,;:!? and line
ends into pieces, pieces at spaces and tabs into words. Repeated rows count again. No frequent phrase, no
row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.llm.flat import FACTOR, LOWER, mix, slices, text_bytes, word_hashes
from mendset.llm.tables import stored

LONGEST, TRIGGER, EVERY = 4, 3, 16  # words of a phrase, of a trigger; mean words of a chunk
FILTER = 1 << 27
SLICE = 3 << 20  # bytes that a task works on at a time
BUCKET = 1 << 19  # words whose pairs are counted together, about
SALTS = 16
STOP = np.zeros(256, bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = STOP.copy()
GAP[[0x20, 0x09]] = True
SPACE, LINE = 0x20, 0x0A  # in chunks: between words of a piece, between pieces


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its text, first byte, the byte after its last, and whether it opens a piece. A word
    ends at a gap: each text must end with one."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    gap = GAP[data]
    turn = np.empty(len(data), bool)
    turn[0] = not gap[0]
    np.not_equal(gap[1:], gap[:-1], out=turn[1:])
    edges = np.flatnonzero(turn)
    starts, ends = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(starts, offsets))
    opens = np.ones(len(starts), bool)
    opens[1:] = np.diff(np.searchsorted(np.flatnonzero(STOP[data]), starts)) > 0
    first = np.cumsum(counts) - counts
    opens[first[counts > 0]] = True
    return np.repeat(np.arange(len(counts)), counts), starts, ends, opens


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after the other, and the offsets of the spans."""
    size = ends - starts
    offsets = np.append(0, np.cumsum(size))
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return data[at], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.astype(np.uint8)))


def parsed(texts: pa.Array, langs: pa.Array) -> pa.RecordBatch:
    """lang, skip (words of overlap), chunk, n: the chunks of some texts, equal ones added up. Each text
    ends with a line end, and so does each chunk."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    doc, starts, ends, opens = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(doc)
    # every word is followed by one mark: a space, or a line end where the next one opens a piece
    size = ends - starts + 1
    end = np.cumsum(size)
    begin = end - size
    keep = ~GAP[data]
    keep[ends] = True
    plain = data[keep]
    plain[end - 1] = np.where(np.append(opens[1:], True)[:n], np.uint8(LINE), np.uint8(SPACE))
    joint, seen = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= TRIGGER:
        seen[TRIGGER - 1 :] = doc[TRIGGER - 1 :] == doc[: n - TRIGGER + 1]
        for k in range(TRIGGER):
            joint[TRIGGER - 1 :] = mix(joint[TRIGGER - 1 :] * np.uint64(FACTOR) + hashes[k : n - TRIGGER + 1 + k])
    last = (seen & (joint % np.uint64(EVERY) == 0)) | np.append(doc[1:] != doc[:-1], True)[:n]
    stop = np.flatnonzero(last)
    body = np.append(0, stop[:-1] + 1)[: len(stop)]
    follows = np.append(False, doc[body[1:]] == doc[body[1:] - 1])[: len(body)]
    skip = np.where(follows, TRIGGER, 0)
    overlap = strings(*gathered(plain, begin[body - skip], begin[body]))
    plain[end[stop] - 1] = LINE
    chunk = pc.binary_join_element_wise(overlap, strings(plain, np.append(0, end[stop])), pa.scalar("", pa.large_string()))
    names = langs.take(pa.array(doc[stop])).cast(pa.large_string())
    table = pa.table({"lang": names, "skip": skip.astype(np.int32), "chunk": chunk})
    table = table.group_by(["lang", "skip", "chunk"]).aggregate([([], "count_all")])
    return table.rename_columns(["lang", "skip", "chunk", "n"]).combine_chunks()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("skip", pa.int32()), ("chunk", pa.string()), ("n", pa.int64())])
    for batch in batches:
        for a, b in slices(batch["text"], SLICE):
            table = parsed(batch["text"].slice(a, b - a), batch["lang"].slice(a, b - a))
            yield from table.cast(schema).to_batches()


class Dictionary:
    """Some entries, word by word: the words beyond the overlaps are those that are counted."""

    def __init__(self, batch: pa.RecordBatch):
        self.lang = batch["lang"].dictionary_encode()
        self.lang_hash = np.zeros(len(self.lang.dictionary), np.uint64)
        names, at = text_bytes(self.lang.dictionary)
        if len(self.lang_hash):
            self.lang_hash = word_hashes(names, at[:-1], at[1:])
        codes = np.asarray(self.lang.indices)
        self.data, offsets = text_bytes(batch["chunk"])
        chunk, self.starts, self.ends, self.opens = words(self.data, offsets)
        self.code = codes[chunk]
        self.weight = np.asarray(batch["n"])[chunk]
        size = np.bincount(chunk, minlength=batch.num_rows)
        first = np.cumsum(size) - size
        self.place = np.arange(len(chunk)) - first[chunk]  # of the word in its chunk
        self.counted = self.place >= np.asarray(batch["skip"])[chunk]
        self.hash = mix(word_hashes(self.data, self.starts, self.ends) + self.lang_hash[self.code]) if len(chunk) else np.zeros(0, np.uint64)
        self.after = np.append(False, ~self.opens[1:])[: len(chunk)]  # a word of the same piece stands before

    def pair(self) -> np.ndarray:
        """The hash of each word with the one before it."""
        before = np.append(self.hash[:1], self.hash[:-1])
        return mix(before * np.uint64(FACTOR) + self.hash)

    def named(self, code: np.ndarray) -> pa.Array:
        return self.lang.dictionary.take(pa.array(code))


def _summed(langs: pa.Array, phrase: pa.Array, n: np.ndarray, extra: dict[str, np.ndarray] | None = None) -> list[pa.RecordBatch]:
    """lang, phrase, n (and further keys), equal ones added up."""
    keys = {"lang": langs, "phrase": phrase.cast(pa.string())} | (extra or {})
    table = pa.table(keys | {"n": n}).group_by(list(keys)).aggregate([("n", "sum")])
    return table.rename_columns([*keys, "n"]).to_batches()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[Dictionary]:
    for batch in batches:
        for a, b in slices(batch["chunk"], SLICE):
            yield Dictionary(batch.slice(a, b - a))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _entries(batches):
        use = some.counted
        spelled = strings(*gathered(some.data, some.starts[use], some.ends[use]))
        yield from _summed(some.named(some.code[use]), spelled, some.weight[use])


class Filter:
    """A Bloom filter of 64-bit hashes, two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        bits = np.uint64(size - 1)
        return hashes & bits, (hashes >> np.uint64(32)) & bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes, 64 * len(self.bits))
        get = lambda x: (self.bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1)
        return (get(a) & get(b)).astype(bool)

    @staticmethod
    def of(hashes: DataFrame) -> Filter:
        """From one column of hashes; FILTER bits at most come to the driver."""
        size = FILTER

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(Filter.places(np.asarray(batch[0]).view(np.uint64), size))
                at = np.unique(at)
                slot, first = np.unique(at >> np.uint64(6), return_index=True)
                word = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.record_batch([pa.array(slot.astype(np.int64)), pa.array(word.view(np.int64))], names=["slot", "word"])

        found = hashes.mapInArrow(mark, "slot bigint, word bigint").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[found["slot"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        return Filter(bits)


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones = pa.array(np.ones(batch.num_rows, np.int64))
        skip = pa.array(np.zeros(batch.num_rows, np.int32))
        ended = pc.binary_join_element_wise(batch["phrase"], "\n", "")
        some = Dictionary(pa.record_batch([batch["lang"], skip, ended, ones], names=["lang", "skip", "chunk", "n"]))
        yield pa.record_batch([pa.array(some.hash.view(np.int64))], names=["hash"])


def _added(hashes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(n), len(found)).astype(np.int64)


def _pairs(known, buckets: int):
    """bucket, hashes, counts: the pairs of frequent words, by their hashes, dealt to buckets as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Filter(known.value)
        for some in _entries(batches):
            frequent = common.holds(some.hash)
            use = some.counted & some.after & frequent
            use[1:] &= frequent[:-1]
            pair, n = _added([some.pair()[use]], [some.weight[use]])
            bucket = (pair >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, first = np.unique(bucket[order], return_index=True)
            at = pa.array(np.append(first, len(order)).astype(np.int32))
            hashes, counts = (pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (pair.view(np.int64), n))
            yield pa.record_batch([pa.array(bucket.astype(np.int64)), hashes, counts], names=["bucket", "hashes", "counts"])

    return run


def _frequent(least: int):
    """The hashes of a bucket that occur often enough; rows are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashes, counts, size = None, [], [], 0

        def often() -> pa.RecordBatch:
            found, n = _added(hashes, counts)
            return pa.record_batch([pa.array(found[n >= least].view(np.int64))], names=["hash"])

        for batch in batches:
            for bucket, h, n in zip(batch["bucket"].to_pylist(), batch["hashes"], batch["counts"]):
                if bucket != now and hashes:
                    yield often()
                    hashes, counts, size = [], [], 0
                now = bucket
                hashes.append(h.values.to_numpy())
                counts.append(n.values.to_numpy())
                size += len(hashes[-1])
                if size > 2 * BUCKET:  # equal pairs of many tasks become one
                    hashes, counts = ([x] for x in _added(hashes, counts))
                    size = -len(hashes[0])
        if hashes:
            yield often()

    return run


def _phrases(known, pairs):
    """lang, phrase, words, n: the phrases of two words or more of which no pair is surely rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, met = Filter(known.value), Filter(pairs.value)
        for some in _entries(batches):
            frequent = common.holds(some.hash)
            tied = some.after & frequent
            tied[1:] &= frequent[:-1]
            at = np.flatnonzero(tied)
            tied[at] = met.holds(some.pair()[at])
            use = some.counted.copy()
            for k in range(2, LONGEST + 1):
                # the phrase of k words that ends here: one more tie, further to the left
                reach = np.zeros(len(use), bool)
                reach[k - 2 :] = tied[: len(use) - k + 2] if len(use) >= k - 2 else False
                use &= reach
                last = np.flatnonzero(use)
                if not len(last):
                    break
                spelled = strings(*gathered(some.data, some.starts[last - k + 1], some.ends[last]))
                yield from _summed(some.named(some.code[last]), spelled, some.weight[last], {"words": np.full(len(last), k, np.int32)})

    return run


def frequencies(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, n of all phrases of up to LONGEST words that occur `least` times or more in
    their language; and lang, n: the words of each language."""
    context = docs.sparkSession.sparkContext
    ended = F.concat(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\n"))
    spoken = docs.select(ended.alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    chunks = spoken.mapInArrow(_parse, "lang string, skip int, chunk string, n bigint")
    entries = stored(chunks.groupBy("lang", "skip", "chunk").agg(F.sum("n").alias("n")))
    counted = entries.mapInArrow(_words, "lang string, phrase string, n bigint")
    single = stored(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    often = single.filter(F.col("n") >= least)
    known = context.broadcast(Filter.of(often.mapInArrow(_word_hashes, "hash bigint")).bits)
    total = totals.agg(F.sum("n")).first()[0] or 0
    dealt = entries.mapInArrow(_pairs(known, 1 + total // BUCKET), "bucket bigint, hashes array<bigint>, counts array<bigint>")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    pairs = context.broadcast(Filter.of(dealt.mapInArrow(_frequent(least), "hash bigint")).bits)
    found = entries.mapInArrow(_phrases(known, pairs), "lang string, phrase string, words int, n bigint")
    longer = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stored(often.select("lang", "phrase", F.lit(1).alias("words"), "n").unionByName(longer)), totals


def _cut(phrase: Column, k: int, words: int) -> tuple[Column, Column]:
    return F.substring_index(phrase, " ", k), F.substring_index(phrase, " ", k - words)


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by their lowest cut.

    A phrase that occurs a times, cut into parts that occur l and r times, scores floor(2000000 a / (l + r));
    of equally low cuts the first counts. Phrases inside a longer one that occurs `inside` hundredths as
    often, or more often, are left out. Order: score, a (both descending), phrase (bytes).
    """
    counts, totals = frequencies(docs, least, text, lang)
    candidates = counts.filter("words > 1").withColumnRenamed("n", "a")
    cuts = [F.struct(F.lit(k).alias("k"), *(p.alias(c) for p, c in zip(_cut(F.col("phrase"), k, m), ("first", "rest"))), F.lit(m).alias("m")) for m in range(2, LONGEST + 1) for k in range(1, m)]
    parts = candidates.withColumn("cut", F.explode(F.filter(F.array(*cuts), lambda c: c["m"] == F.col("words"))))
    parts = parts.select("lang", "phrase", "words", "a", "cut.k", "cut.first", "cut.rest")
    of = lambda part, c: counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(c))
    whole = parts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.call_function("div", _exact(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), _exact(F.col("l")) + _exact(F.col("r")))
    lowest = whole.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = candidates.filter("words > 2")
    word = lambda i, n: F.array_join(F.slice(F.split("phrase", " "), i, n), " ")
    inner = [F.when(F.col("words") > n, F.when(F.col("words") >= i + n - 1, word(i, n))) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    covers = longer.select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    left = lowest.join(covers, ["lang", "phrase"], "left")
    hidden = _exact(F.col("cover")) * 100 >= _exact(F.col("a")) * inside
    left = left.filter(~F.coalesce(hidden, F.lit(False))).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
