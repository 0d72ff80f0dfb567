"""Blocks of brace-structured texts, for a whole batch of texts at once.

The texts of a batch lie in one byte array. Header lines are found by one search over it. Whether a line
begins inside quoted text follows from the lines before it: each line keeps, flips or settles that state
(a `#` comment settles it), so the states of all lines come from one prefix sum since the last settled
line. Braces outside quotes and comments get their depth by a cumulative sum, and sorting them by depth
puts each opening brace next to its closing one. Lines of blocks and their assignments are found in the
same arrays. Nothing loops over texts or lines.

Offsets are 0-based code points. Quoted text (and `#` comments, where asked for) hides braces; a backslash
hides a quote or a backslash everywhere; quoting starts afresh at each header, so a stray quote cannot
hide the blocks after it. A closing brace without an opening one is passed over; only a balanced block
counts, at any depth. Null texts hold nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20  # bytes worked on at a time; a longer text is worked on alone
BREAK, NEWLINE = 0xFF, 0x0A  # between texts; no byte of UTF-8 is 0xFF
NEVER = np.iinfo(np.int64).max
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True  # ASCII of str.strip and of \s
ASSIGNMENT = re.compile(r"(\w+)\s*=")
WORD = np.zeros(256, bool)
WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Parts of a batch of about `size` bytes."""
    sizes = np.cumsum(np.diff(_buffers(texts)[1]))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of all spans as strings."""
    size = ends - starts
    offsets = np.append(0, np.cumsum(size))
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def lists(counts: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), items)


@dataclass
class Found:
    """Blocks in the order of texts: text, first byte, byte after the last, and the labels' bounds."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    labels: np.ndarray


class Texts:
    """A slice of texts in one array; after each stand a byte 0xFF and a line end."""

    def __init__(self, texts: pa.Array):
        data, offsets = _buffers(texts)
        n = len(texts)
        self.n = n
        self.begin = offsets[:-1] + 2 * np.arange(n)
        self.end = offsets[1:] + 2 * np.arange(n)
        self.data = np.full(len(data) + 2 * n, BREAK, np.uint8)
        real = np.ones(len(self.data), bool)
        real[self.end] = real[self.end + 1] = False
        self.data[real] = data
        self.data[self.end + 1] = NEWLINE
        self.lines = np.append(0, np.flatnonzero(self.data == NEWLINE) + 1)  # starts; the last is the end

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def line_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lines, at, "right") - 1

    @cached_property
    def points(self) -> np.ndarray | None:
        """Code points before each byte; None where all bytes are ASCII."""
        first = (self.data & 0xC0) != 0x80
        return None if first.all() else np.append(0, np.cumsum(first))

    def offset(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        if self.points is None:
            return at - self.begin[text]
        return self.points[at] - self.points[self.begin[text]]

    @cached_property
    def _escapes(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of quotes that count, and of the pairs of a backslash and what it hides."""
        quotes = np.flatnonzero(self.data == ord('"'))
        slashes = np.flatnonzero(self.data == ord("\\"))
        if not len(slashes):
            return quotes, slashes
        opens = np.append(True, np.diff(slashes) > 1)  # a run of backslashes
        run = np.maximum.accumulate(np.where(opens, np.arange(len(slashes)), 0))
        odd = (np.arange(len(slashes)) - run) % 2 == 0  # the first, third, ... of its run
        next_ = self.data[slashes + 1]
        hides = slashes[odd & ((next_ == ord("\\")) | (next_ == ord('"')))]
        return np.setdiff1d(quotes, hides + 1, assume_unique=True), np.concatenate([hides, hides + 1])

    def _headers(self, pattern: re.Pattern, data: np.ndarray) -> np.ndarray:
        """Line start, opening brace and label bounds of every header."""
        found = [(m.start(), m.start("open"), *m.span("a"), *m.span("b")) for m in pattern.finditer(data.tobytes())]
        rows = np.array(found, np.int64).reshape(-1, 6)
        return rows[rows[:, 1] < self.end[self.text_of(rows[:, 0])]]

    def _hidden(self, at: np.ndarray, cuts: np.ndarray, comments: bool) -> np.ndarray:
        """Which of the positions stand in quotes or comments."""
        quotes, _ = self._escapes
        n = len(self.lines)
        first = np.searchsorted(quotes, self.lines)  # of the line's quotes
        total = np.diff(np.append(first, len(quotes)))
        comment = np.full((2, n), NEVER)  # where a line's comment begins, by the state it begins with
        if comments:
            marks = np.flatnonzero(self.data == ord("#"))
            line = self.line_of(marks)
            before = np.searchsorted(quotes, marks) - first[line]
            for state in (0, 1):
                able = (before + state) % 2 == 0
                where, which = np.unique(line[able], return_index=True)
                comment[state, where] = marks[able][which]
        after = np.where(comment < NEVER, 0, (np.arange(2)[:, None] + total) % 2)
        settled, flips = after[0] == after[1], (after[0] == 1) & (after[1] == 0)
        known, value = np.zeros(n, bool), np.zeros(n, np.int64)
        known[1:], value[1:] = settled[:-1], after[0][:-1]
        fresh = self.line_of(np.concatenate([self.begin, cuts]))
        known[0] = known[fresh] = True
        value[0] = value[fresh] = 0
        parity = np.append(0, np.cumsum(flips)[:-1])
        last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
        state = (value[last] + parity - parity[last]) % 2
        line = self.line_of(at)
        quoted = (state[line] + np.searchsorted(quotes, at) - first[line]) % 2 == 1
        return quoted | (at > comment[state[line], line])

    def blocks(self, pattern: re.Pattern, comments: bool) -> Found:
        """The balanced blocks under one kind of header (see `header_pattern`)."""
        plain = self._headers(pattern, self.data)
        at = np.flatnonzero((self.data == ord("{")) | (self.data == ord("}")))
        if not len(plain) or not len(at):
            none = np.zeros(0, np.int64)
            return Found(none, none, none, np.zeros((0, 4), np.int64))
        hidden = self._hidden(at, plain[:, 0], comments)
        pairs = self._escapes[1]
        shown = plain
        if hidden.any() or len(pairs):
            data = self.data.copy()
            data[at[hidden]] = ord(" ")
            data[pairs] = ord("_")
            shown = self._headers(pattern, data)
        opened, closed = self._matched(at[~hidden])
        # a header must stand in the text as such, too
        where = np.minimum(np.searchsorted(plain[:, 0], shown[:, 0]), len(plain) - 1)
        spot = np.minimum(np.searchsorted(opened, shown[:, 1]), max(len(opened) - 1, 0))
        good = (plain[where, 0] == shown[:, 0]) & (opened[spot] == shown[:, 1] if len(opened) else False)
        where, end = where[good], closed[spot[good]] if len(opened) else closed
        good = plain[where, 1] < end
        where, end = where[good], end[good]
        return Found(self.text_of(plain[where, 0]), plain[where, 0], end, plain[where, 2:])

    def _matched(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Opening braces that are closed, in order, and the bytes after the closing ones."""
        text = self.text_of(at)
        step = np.where(self.data[at] == ord("{"), 1, -1)

        def depths(text: np.ndarray, step: np.ndarray) -> np.ndarray:
            total = np.cumsum(step)
            first = np.searchsorted(text, text)
            return total - (total[first] - step[first])

        depth = depths(text, step)
        room = len(at) + 1
        low = depth - room * text  # each text lies below the one before it
        least = np.minimum.accumulate(np.minimum(low, -room * text))
        before = np.minimum(np.append(NEVER, least[:-1]), -room * text)
        keep = (step > 0) | (low >= before)
        at, text, step = at[keep], text[keep], step[keep]
        level = depths(text, step) + (step < 0)
        order = np.lexsort((at, level, text))
        a, b = order[:-1], order[1:]
        pair = (step[a] > 0) & (step[b] < 0) & (text[a] == text[b]) & (level[a] == level[b])
        opened, closed = at[a[pair]], at[b[pair]] + 1
        by = np.argsort(opened)
        return opened[by], closed[by]

    def assignments(self, found: Found) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Of the blocks' own assignments (depth <= 1 when their line is over): block, name, line, first
        byte, byte after the line."""
        first, last = self.line_of(found.start), self.line_of(found.end - 1)
        count = last - first + 1
        block = np.repeat(np.arange(len(count)), count)
        line = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + first[block]
        start = self.lines[line]
        end = np.minimum(self.lines[line + 1] - 1, found.end[block])
        braces = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data == ord("{")).astype(np.int8) - (self.data == ord("}")).astype(np.int8), dtype=np.int32, out=braces[1:])
        own = braces[end] - braces[found.start[block]] <= 1
        block, line, start, end = block[own], line[own], start[own], end[own]
        solid, plain = np.flatnonzero(~SPACES[self.data]), np.flatnonzero(~WORD[self.data])
        next_of = lambda where, at: where[np.minimum(np.searchsorted(where, at), len(where) - 1)]
        name = next_of(solid, start)
        stop = next_of(plain, name)
        sign = next_of(solid, stop)
        hit = (sign < end) & (stop > name) & (self.data[np.minimum(sign, len(self.data) - 1)] == ord("="))
        # letters and spaces beyond ASCII are left to the pattern, line by line
        odd = np.zeros(len(hit), bool)
        for at in (name, stop, sign):
            odd |= (at < end) & (self.data[at] >= 0x80)
        for k in np.flatnonzero(odd):
            row = self.data[start[k] : end[k]].tobytes().decode()
            m = ASSIGNMENT.match(row.strip())
            hit[k] = m is not None
            if m:
                name[k] = start[k] + len(row[: len(row) - len(row.lstrip())].encode())
                stop[k] = name[k] + len(m[1].encode())
        return block[hit], spans(self.data, name[hit], stop[hit]), line[hit], start[hit], end[hit]


def header_pattern(header: str) -> re.Pattern:
    """Finds every line at which a header stands; `header` may name its labels a and b."""
    for name in ("a", "b"):
        if f"(?P<{name}>" not in header:
            header = f"(?P<{name}>){header}"
    return re.compile(rf"^(?={header}(?P<open>\{{))".encode(), re.MULTILINE)


RESOURCE = header_pattern(r'[ \t]*resource\s+"(?P<a>[^"]+)"\s+"(?P<b>[^"]+)"\s*')


def kind_header(kind: str, label: str | None = None) -> str:
    """The pattern of a block's header up to its brace."""
    if label is None:
        return rf"[ \t]*{kind}\s+[^\n{{]*?"
    return rf'[ \t]*{kind}\s+["\']?{re.escape(label)}["\']?(?:\s+["\'][^"\']*["\'])?\s*'


def block_spans(texts: pa.Array, pattern: re.Pattern, comments: bool) -> pa.Array:
    """list<struct<start,end>> of a slice of texts."""
    some = Texts(texts)
    found = some.blocks(pattern, comments)
    start, end = (some.offset(x, found.text).astype(np.int32) for x in (found.start, found.end))
    return lists(np.bincount(found.text, minlength=some.n), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))


def resource_spans(texts: pa.Array) -> pa.Array:
    """list<struct<type,name,start,end,line,attrs>> of a slice of texts."""
    some = Texts(texts)
    found = some.blocks(RESOURCE, comments=False)
    block, name, line, start, end = some.assignments(found)
    first = some.line_of(some.begin)
    number = lambda x: pa.array(x.astype(np.int32))
    text = found.text[block]
    attrs = [name, number(line - first[text]), number(some.offset(start, text)), spans(some.data, start, end)]
    attrs = lists(np.bincount(block, minlength=len(found.text)), pa.StructArray.from_arrays(attrs, ["name", "line", "start", "text"]))
    kind, label = (spans(some.data, found.labels[:, k], found.labels[:, k + 1]) for k in (0, 2))
    at = [number(some.offset(x, found.text)) for x in (found.start, found.end)]
    fields = [kind, label, *at, number(some.line_of(found.start) - first[found.text]), attrs]
    items = pa.StructArray.from_arrays(fields, ["type", "name", "start", "end", "line", "attrs"])
    return lists(np.bincount(found.text, minlength=some.n), items)


def matches(texts: pa.Array, pattern: re.Pattern) -> pa.Array:
    """list<struct<start,found>> of a slice of texts; the pattern must not match line ends."""
    some = Texts(texts)
    data = some.data.copy()
    data[some.end] = NEWLINE
    begin = some.begin if some.points is None else some.points[some.begin]
    found = [(m.start(), m[0]) for m in pattern.finditer(data.tobytes().decode())]
    start = np.array([f[0] for f in found], np.int64)
    text = np.searchsorted(begin, start, "right") - 1
    fields = [pa.array((start - begin[text]).astype(np.int32)), pa.array([f[1] for f in found], pa.string())]
    return lists(np.bincount(text, minlength=some.n), pa.StructArray.from_arrays(fields, ["start", "found"]))


DEPENDS = re.compile(rb"depends_on\s*=\s*\[([^\]]*)\]")
TARGET = re.compile(rb"\w+\.\w+")


def dependencies(texts: pa.Array) -> pa.Array:
    """list<struct<src,dst>> of a slice of texts: what resource blocks say that they depend on."""
    some = Texts(texts)
    found = some.blocks(RESOURCE, comments=False)
    lists_ = np.array([m.start() for m in DEPENDS.finditer(some.data.tobytes())], np.int64)
    block, dst = [], []
    # blocks that hold such a list; a list of an inner block is one of the outer block, too
    for k in np.flatnonzero(np.searchsorted(lists_, found.end) > np.searchsorted(lists_, found.start)):
        for m in DEPENDS.finditer(some.data[found.start[k] : found.end[k]].tobytes()):
            targets = TARGET.findall(m[1])
            block += [k] * len(targets)
            dst += targets
    block = np.array(block, np.int64)
    names = (spans(some.data, found.labels[block, k], found.labels[block, k + 1]) for k in (0, 2))
    src = pc.binary_join_element_wise(*names, ".")
    items = pa.StructArray.from_arrays([src, pa.array(dst, pa.binary()).cast(pa.string())], ["src", "dst"])
    return lists(np.bincount(found.text[block], minlength=some.n), items)
