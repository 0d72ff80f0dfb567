"""Batches of texts as flat numpy arrays: bytes, words and 64-bit word hashes.

Everything works on the UTF-8 bytes of an Arrow string array. A word is a maximal run of bytes other
than 0x20 and 0x09-0x0D inside one text. Temporary arrays cover BLOCK bytes at a time, so memory
beyond the batch itself does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = 0xD6E8FEB86659FD93
UNFACTOR = pow(FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWER, UNPOWER = _powers(FACTOR, BLOCK), _powers(UNFACTOR, BLOCK)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the index of its text, its first byte, the byte after its last."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] of ordered disjoint words: a polynomial over random byte values."""
    gear = GEAR[LOWER] if lower else GEAR
    out = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):
        e = max(w + 1, int(np.searchsorted(ends, starts[w] + BLOCK, "right")))
        base, stop = int(starts[w]), int(ends[e - 1])
        if stop - base <= BLOCK:
            sums = np.empty(stop - base + 1, np.uint64)
            sums[0] = 0
            np.cumsum(gear[data[base:stop]] * POWER[: stop - base], out=sums[1:])
            out[w:e] = (sums[ends[w:e] - base] - sums[starts[w:e] - base]) * UNPOWER[starts[w:e] - base]
        else:  # one word longer than a block
            total = 0
            for at in range(base, stop, BLOCK):
                part = gear[data[at : min(at + BLOCK, stop)]]
                total += int((part * POWER[: len(part)]).sum(dtype=np.uint64)) * pow(FACTOR, at - base, 1 << 64)
            out[w] = total % (1 << 64)
        w = e
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def windows(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row and the text of each; a text of fewer words has one window of all."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    short = (counts > 0) & (counts < width)
    size = np.where(short, 1, np.maximum(counts - width + 1, 0))
    owner = np.repeat(np.arange(n_docs), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = k < counts[owner]
        step = np.where(there, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], np.uint64(k)) if len(at) else out
        out = mix(out * np.uint64(FACTOR) + step + np.uint64(k + 1))
    return out, owner


def slices(texts: pa.Array, limit: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about `limit` bytes each (a longer text makes a range of its own)."""
    _, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to
