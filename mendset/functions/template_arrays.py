"""The entries of many plain templates at once, in flat arrays.

The texts of a batch lie in one byte array. Lines of blocks give their column, key and value; which map or
list a line belongs to follows from the last line before it that is no deeper. Values in brackets (and
whole JSON texts) become tokens, and sorting these by depth puts each closing bracket behind its opening
one. Nothing loops over texts, lines or tokens, only over columns and depths.

Texts are taken in the plain spelling of functions/plain_templates.py, and in less: no backslash, no equal
keys in a map. All others are told as not read. Of those read, the rows are those of the composed tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from mendset.functions import graphs
from mendset.functions.braces import WORD, lists, spans

DEEPEST, WIDEST, LONGEST = 40, 100, 500
KINDS = ["str", "int", "float", "bool", "null", "list", "map"]
STR, LIST, MAP = 0, 5, 6


def _set(chars: bytes, *also: np.ndarray) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars]] = True
    for a in also:
        out |= a
    return out


KEY = _set(b"./-:", WORD)
FLOW_PLAIN = _set(b"./+*=-", WORD)
FLOW_FIRST = _set(b"./", WORD)
INDICATOR = _set(b"?:,[]{}#&*!|>'\"%@`")
READ = _set(b"\n", np.isin(np.arange(256), np.arange(0x20, 0x7F)) & ~_set(b"\\"))
# tokens: what a byte outside quotes is, then what it is taken for
BLANK, OPEN_MAP, OPEN_LIST, CLOSE_MAP, CLOSE_LIST, COMMA, COLON, TAG, ATOM, OTHER, QUOTED, COMMA_LIST, NAME, START, END = range(15)
BYTE = np.full(256, OTHER, np.uint8)
BYTE[FLOW_PLAIN] = ATOM
for _c, _k in ((b" \n", BLANK), (b"{", OPEN_MAP), (b"[", OPEN_LIST), (b"}", CLOSE_MAP), (b"]", CLOSE_LIST), (b",", COMMA), (b":", COLON), (b"!", TAG)):
    BYTE[[*_c]] = _k
VALUES = [OPEN_MAP, OPEN_LIST, ATOM, QUOTED]
AFTER_VALUE = [COMMA, COMMA_LIST, CLOSE_MAP, CLOSE_LIST, END]
FOLLOWS = np.zeros((15, 15), bool)
for _a, _b in (
    (START, [OPEN_MAP, OPEN_LIST, QUOTED]), (OPEN_MAP, [NAME, CLOSE_MAP]), (OPEN_LIST, [*VALUES, TAG, CLOSE_LIST]), (COMMA, [NAME]),
    (COMMA_LIST, [*VALUES, TAG]), (NAME, [COLON]), (COLON, [*VALUES, TAG]), (TAG, VALUES),
    (ATOM, AFTER_VALUE), (QUOTED, AFTER_VALUE), (CLOSE_MAP, AFTER_VALUE), (CLOSE_LIST, AFTER_VALUE),
):
    FOLLOWS[_a, _b] = True


def _next(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first of the sorted places at or after each position; there is one."""
    return places[np.searchsorted(places, at)]


def _any_in(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.searchsorted(places, start) < np.searchsorted(places, end)


def _last(start: np.ndarray, size: int) -> np.ndarray:
    """Whether each of `size` sorted things ends its group; `start` tells which begin one."""
    return np.append(start[1:], True)[:size]


@dataclass
class Values:
    """What stands at a place: text from byte a to b (none: b < a), kind, number of children."""

    a: np.ndarray
    b: np.ndarray
    kind: np.ndarray
    size: np.ndarray

    def __getitem__(self, at) -> Values:
        return Values(self.a[at], self.b[at], self.kind[at], self.size[at])

    @staticmethod
    def join(parts: list[Values]) -> Values:
        return Values(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("a", "b", "kind", "size")))

    @staticmethod
    def maps(n: int, size: np.ndarray | int = 1) -> Values:
        return Values(np.zeros(n, np.int64), np.full(n, -1), np.full(n, MAP), np.zeros(n, np.int64) + size)


class Templates:
    """Rows of the texts of a batch; `bad` tells which texts are not read."""

    def __init__(self, texts: list[str | None], resolvers: dict):
        self.resolvers = resolvers
        ascii_ = [bool(t) and t.isascii() for t in texts]
        joined = "\n".join([t if a else "" for t, a in zip(texts, ascii_)]) + "\n"
        self.buf = buf = np.frombuffer(joined.encode("ascii"), np.uint8)
        self.bad = ~np.array(ascii_, bool)
        sizes = np.array([len(t) if a else 0 for t, a in zip(texts, ascii_)], np.int64) + 1
        self.ends = np.cumsum(sizes) - 1  # of the texts; a line feed stands there
        self.starts = self.ends - sizes + 1
        self._spoil(np.flatnonzero(~READ[buf]))
        self.breaks = np.flatnonzero(buf == 0x0A)
        space = (buf == 0x20) | (buf == 0x0A)
        # where something follows a blank, and each line feed after one
        self.begins = np.append(np.flatnonzero((buf != 0x20) & np.append(True, space[:-1])), len(buf) - 1)
        self.colons = np.flatnonzero((buf[:-1] == 0x3A) & (buf[1:] == 0x20))
        self.hashes = np.flatnonzero((buf[:-1] == 0x20) & (buf[1:] == 0x23))
        self._lines()
        self._entities()
        self._tokens()
        self._containers()
        self._steps()
        self._rows()

    def _doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at)

    def _spoil(self, at: np.ndarray) -> None:
        self.bad[self._doc(at)] = True

    # ---- lines of blocks

    def _lines(self) -> None:
        buf = self.buf
        start = np.append(0, self.breaks[:-1] + 1)
        first = _next(self.begins, start)
        filled = np.flatnonzero(buf[first] != 0x0A)
        doc = self._doc(start[filled])
        seen = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        # a text that begins with a brace is one value
        self.flowing = np.zeros(len(self.bad), bool)
        begun = filled[seen]
        self.root = np.zeros(len(self.bad), np.int64)
        self.root[doc[seen]] = first[begun]
        self.flowing[doc[seen]] = buf[first[begun]] == 0x7B
        empty = np.ones(len(self.bad), bool)
        empty[doc] = False
        self.bad |= empty
        keep = filled[(buf[first[filled]] != 0x23) & ~self.flowing[doc] & ~self.bad[doc]]
        self.ls, self.le, fs = start[keep], self.breaks[keep], first[keep]
        self.col = fs - self.ls
        dash = (buf[fs] == 0x2D) & (buf[fs + 1] == 0x20)
        self.k0 = k0 = fs + 2 * dash
        p = _next(np.flatnonzero(~KEY[buf]), np.minimum(k0, self.le))
        named = (p > k0 + 1) & (buf[p - 1] == 0x3A) & ((buf[p] == 0x20) | (p == self.le)) & WORD[buf[np.minimum(k0, self.le)]] & (buf[p - 2] != 0x3A)
        self.key_end = p - 1
        self.bare = named & (p == self.le)
        v = self.v = np.where(self.bare, self.le, np.where(named, _next(self.begins, p), k0))
        triple = np.flatnonzero((buf[:-2] == 0x3A) & (buf[1:-1] == 0x3A) & (buf[2:] == 0x3A))
        c = buf[np.minimum(v, self.le)]
        self.tagged = (c == 0x21) & ~self.bare
        t = _next(np.flatnonzero(~WORD[buf]), np.minimum(v + 1, self.le))
        self.tag_end = np.where(self.tagged, t, v)
        inner = self.inner = np.where(self.tagged, _next(self.begins, np.minimum(t, self.le)), v)
        inner_c = buf[inner]
        self.plain = ~self.bare & ~INDICATOR[inner_c]
        self.inside = ~self.bare & np.isin(inner_c, [*b"[{\"'"])
        wrong = ~named & ~dash | (self.col > WIDEST) | (buf[self.le - 1] == 0x20) | (buf[np.minimum(k0, self.le)] == 0x20)
        wrong |= self.tagged & ((t == v + 1) | (buf[t] != 0x20)) | ~(self.bare | self.plain | self.inside)
        dashed = (inner_c == 0x2D) & np.isin(buf[np.minimum(inner + 1, self.le)], [0x20, 0x0A])
        wrong |= self.plain & (dashed | _any_in(self.colons, inner, self.le) | _any_in(self.hashes, inner, self.le) | (buf[self.le - 1] == 0x3A))
        wrong |= named & (self.key_end - k0 > LONGEST)
        self._spoil(self.ls[wrong])
        self._spoil(triple)
        self.dash, self.named = dash, named

    def _entities(self) -> None:
        """Items and entries of blocks, up to one of each on a line; the containers they belong to."""
        use = np.flatnonzero(~self.bad[self._doc(self.ls)])
        self.line = line = np.repeat(use, (self.dash.astype(np.int64) + self.named)[use])
        n = len(line)
        second = np.append(False, line[1:] == line[:-1])[:n]
        self.item = item = self.dash[line] & ~second
        self.ecol = ecol = self.col[line] + 2 * second
        bare = ~item & self.bare[line]
        self.edoc = doc = self._doc(self.ls[line])
        first_of = np.searchsorted(doc, doc)
        last_of = np.searchsorted(doc, doc, "right")
        before, lower = np.full(n, -1), np.full(n, n)  # the last no deeper before, the next less deep
        for c in np.unique(ecol):
            at = np.flatnonzero(ecol == c)
            near = np.flatnonzero(ecol <= c)
            k = np.searchsorted(near, at) - 1
            before[at] = np.where(k >= 0, near[k], -1)
            near = np.append(np.flatnonzero(ecol < c), n)
            lower[at] = near[np.searchsorted(near, at)]
        before = np.where(before < first_of, -1, before)
        lower = np.minimum(lower, last_of)
        here = np.arange(n)
        joins = (before >= 0) & (ecol[before] == ecol) if n else np.zeros(0, bool)
        after_bare = np.append(False, bare[:-1])[:n] & (here != first_of)
        wrong = joins & ((item[before] != item) | after_bare)
        wrong |= ~joins & (before >= 0) & ((before != here - 1) | ~(second | after_bare))
        wrong |= (before < 0) & ((here != first_of) | (ecol != 0) | item)
        wrong |= bare & (here + 1 == last_of)
        self.bad[doc[wrong]] = True
        order = np.argsort(ecol, kind="stable")
        opens = ~joins[order]
        self.econ = np.zeros(n, np.int64)
        self.econ[order] = np.cumsum(opens) - 1
        opener = order[opens]
        first_place = np.flatnonzero(opens)
        self.eindex = np.zeros(n, np.int64)
        self.eindex[order] = here - np.repeat(first_place, np.diff(np.append(first_place, n)))
        self.bcount = np.bincount(self.econ, minlength=len(opener))
        self.blist = item[opener]
        self.bat = self.ls[line[opener]] + ecol[opener]
        self.bend = self.le[line[lower[opener] - 1]]
        self.bcol = ecol[opener]
        self.bowner = np.where(before[opener] < 0, -1, opener - 1)
        # the container below an entity
        self.below = np.full(n, -1)
        owned = self.bowner >= 0
        self.below[self.bowner[owned]] = np.flatnonzero(owned)

    # ---- values in brackets

    def _tokens(self) -> None:
        buf = self.buf
        # the places of blocks whose value lies in brackets or quotes, then the JSON texts
        value_of = np.flatnonzero(np.append(self.line[1:] != self.line[:-1], True)[: len(self.line)])
        self.slot = slot = value_of[self.inside[self.line[value_of]]]
        whole = np.flatnonzero(self.flowing & ~self.bad)
        start = np.concatenate([self.inner[self.line[slot]], self.root[whole]])
        stop = np.concatenate([self.le[self.line[slot]], self.ends[whole]])
        self.region_slot = np.append(slot, np.full(len(whole), -1))
        size = stop + 1 - start  # with the line feed behind it
        first = np.cumsum(size) - size
        pos = np.arange(size.sum()) + np.repeat(start - first, size)
        d = buf[pos]
        region = np.repeat(np.arange(len(size)), size)

        def within(quote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            up_to = np.cumsum(quote)
            base = (up_to - quote)[first] if len(first) else first
            odd = (up_to - quote - np.repeat(base, size)) % 2 == 1
            return odd | quote, odd

        quote = d == 0x22
        held, odd = within(quote)
        single = (d == 0x27) & ~held
        if single.any():
            apart = np.bincount(region[single], minlength=len(size)) > 0
            mixed = apart & (np.bincount(region[quote], minlength=len(size)) > 0)
            self.bad[self._doc(start[mixed])] = True
            quote = np.where(apart[region], d == 0x27, quote)
            held, odd = within(quote)
        self._spoil(pos[odd & (d == 0x0A)])
        held[first + size - 1] = False  # an open quote does not reach into the next place
        kind = np.where(held, QUOTED, BYTE[d]).astype(np.uint8)
        word_next = np.append(WORD[d[1:]], False)[: len(d)]
        kind[(kind == COLON) & np.append(False, kind[:-1] == ATOM)[: len(d)] & word_next] = ATOM
        plain = (kind == ATOM) | (kind == QUOTED) | (kind == TAG)
        before = np.append(False, plain[:-1])[: len(d)]
        self._spoil(pos[(kind == OTHER) | (kind == TAG) & before])
        begin = plain & ~before
        at = np.flatnonzero(begin | (kind >= OPEN_MAP) & (kind <= COLON))
        tk = kind[at]
        end = at + 1
        atoms = begin[at]
        end[atoms] = np.flatnonzero(plain & ~np.append(plain[1:], False)[: len(d)]) + 1
        # quoted text is a run with a quote at both ends and no other; a tag holds letters only
        quotes = np.flatnonzero(quote)
        n_quotes = np.searchsorted(quotes, end) - np.searchsorted(quotes, at)
        wrong = atoms & np.where(tk == QUOTED, (n_quotes != 2) | (d[end - 1] != d[at]) | ~quote[end - 1], n_quotes != 0)
        letters = np.flatnonzero(~WORD[d])
        wrong |= (tk == TAG) & ((np.searchsorted(letters, end) - np.searchsorted(letters, at) != 1) | (end < at + 2) | (d[np.minimum(end, len(d) - 1)] != 0x20))
        wrong |= (tk == ATOM) & ~(FLOW_FIRST[d[at]] | (d[at] == 0x2D) & (end > at + 1) & FLOW_FIRST[d[np.minimum(at + 1, len(d) - 1)]])
        n = len(at)
        self.treg = treg = region[at]
        lead = np.append(True, treg[1:] != treg[:-1])[:n]
        up = np.isin(tk, (OPEN_MAP, OPEN_LIST)).astype(np.int64)
        down = np.isin(tk, (CLOSE_MAP, CLOSE_LIST)).astype(np.int64)
        total = np.cumsum(up - down)
        base = (total - up + down)[np.flatnonzero(lead)]
        own = np.cumsum(lead) - 1
        level = total - base[own] if n else total
        depth = level + down  # of what stands inside the brackets, these included
        wrong |= (depth > DEEPEST) | (depth < 0)
        depth = np.clip(depth, 0, 255).astype(np.uint8)
        order = np.argsort(depth, kind="stable")
        opens = up[order] == 1
        con = np.zeros(n, np.int64)
        con[order] = np.cumsum(opens) - 1
        self.fopen = order[opens]
        con = np.where((depth == 0) | (con < 0), -1, con)
        self.flist = tk[self.fopen] == OPEN_LIST
        in_list = (con >= 0) & (np.append(self.flist, False)[con])
        tk = tk.copy()
        tk[(tk == COMMA) & in_list] = COMMA_LIST
        prev = np.append(START, tk[:-1])[:n]
        prev[lead] = START
        tk[(tk == QUOTED) & (d[at] == 0x22) & np.isin(prev, (OPEN_MAP, COMMA))] = NAME
        prev = np.append(START, tk[:-1])[:n]
        prev[lead] = START
        wrong |= ~FOLLOWS[prev, tk]
        wrong |= np.isin(tk, (COMMA, COMMA_LIST)) & (con < 0) | (tk == CLOSE_MAP) & (in_list | (con < 0)) | (tk == CLOSE_LIST) & ~in_list
        tail = _last(lead, n)
        wrong |= tail & (~FOLLOWS[tk, END] | (level != 0))
        # a key and its colon, a tag and its value stand on one line
        gap_from, gap_to = end, np.append(at[1:], len(d))[:n]
        close_by = np.isin(tk, (NAME, TAG))
        broken = _any_in(np.flatnonzero(d == 0x0A), gap_from, gap_to) | (tk == NAME) & ((gap_to - gap_from > 9) | (end - at > LONGEST))
        wrong |= close_by & broken
        self._spoil(pos[at[wrong]])
        self.tk, self.prev, self.con = tk, prev, con
        self.tat, self.tend = pos[at] if n else at, (pos[end - 1] + 1 if n else end)
        self.up = up == 1

    def _containers(self) -> None:
        n, tk = len(self.tk), self.tk
        k = len(self.fopen)
        shut = np.flatnonzero(np.isin(tk, (CLOSE_MAP, CLOSE_LIST)) & (self.con >= 0))
        self.fend = np.zeros(k, np.int64)
        self.fend[self.con[shut]] = self.tend[shut]
        # the container that a token stands in; of an opening bracket, the one around it
        back = np.maximum(np.arange(n) - 1, 0)
        self.around = np.where(self.up, np.where(self.prev == START, -1, self.con[back]), self.con) if n else self.con
        value = np.isin(tk, VALUES)
        self.value = value
        lone = np.isin(self.prev, (OPEN_LIST, COMMA_LIST))
        self.is_item = (value | (tk == TAG)) & lone
        children = np.flatnonzero((tk == NAME) | self.is_item)
        self.fcount = np.bincount(self.around[children][self.around[children] >= 0], minlength=k)
        # the value of a token that begins an entry, an item or a tag
        here = np.arange(n)
        self.v_end = np.where(self.up, self.fend[np.maximum(self.con, 0)], self.tend) if k else self.tend
        after = lambda i, by: np.minimum(i + by, n - 1)
        held = np.where(tk == NAME, after(here, 2), here)
        self.held = held  # the tag or value of an entry or item
        self.final = np.where(tk[held] == TAG, after(held, 1), held) if n else held

    def _described(self, at: np.ndarray) -> Values:
        """Of the tokens of values."""
        k = self.tk[at]
        quoted, many = k == QUOTED, self.up[at]
        con = np.maximum(self.con[at], 0)
        size = np.where(many, self.fcount[con], 0) if len(self.fcount) else np.zeros(len(at), np.int64)
        kind = np.where(k == OPEN_MAP, MAP, np.where(k == OPEN_LIST, LIST, np.where(quoted, STR, -1)))
        return Values(np.where(many, 0, self.tat[at] + quoted), np.where(many, -1, self.tend[at] - quoted), kind, size)

    # ---- paths

    def _steps(self) -> None:
        """All that paths lead through: entities, tags of blocks, then keys, tags and items in brackets."""
        ne, nt = len(self.line), len(self.tk)
        value_of = np.append(self.line[1:] != self.line[:-1], True)[:ne]
        self.btag = np.flatnonzero(value_of & self.tagged[self.line])
        tag_step = np.full(ne, -1)
        tag_step[self.btag] = ne + np.arange(len(self.btag))
        at = ne + len(self.btag)
        self.fkey = np.flatnonzero(np.isin(self.tk, (NAME, TAG)))
        key_step = np.full(nt, -1)
        key_step[self.fkey] = at + np.arange(len(self.fkey))
        at += len(self.fkey)
        self.fitem = np.flatnonzero(self.is_item)
        item_step = np.full(nt, -1)
        item_step[self.fitem] = at + np.arange(len(self.fitem))
        slot_step = np.append(np.where(tag_step >= 0, tag_step, np.arange(ne)), -1)
        # the step that a value hangs on, by its token
        back = lambda by: np.maximum(np.arange(nt) - by, 0)
        hangs = np.where(self.prev == COLON, key_step[back(2)], np.where(self.prev == TAG, key_step[back(1)], np.where(self.is_item, item_step, -1))) if nt else key_step
        rooted = self.prev == START
        hangs = np.where(rooted, slot_step[self.region_slot[self.treg]], hangs) if nt else hangs
        owner = hangs[self.fopen]  # by container
        inside = lambda t: np.where(self.around[t] >= 0, np.append(owner, -1)[self.around[t]], -1)
        tags = self.tk[self.fkey] == TAG
        parent = [
            np.append(self.bowner, -1)[self.econ],
            self.btag,
            np.where(tags, hangs[self.fkey], inside(self.fkey)),
            inside(self.fitem),
        ]
        self.parent = np.concatenate(parent).astype(np.int64)
        tl = self.line[self.btag]
        zero = np.zeros(len(self.fitem), np.int64)
        self.name_a = np.concatenate([self.k0[self.line], self.v[tl] + 1, self.tat[self.fkey] + 1, zero])
        name_b = [np.where(self.item, self.k0[self.line], self.key_end[self.line]), self.tag_end[tl], self.tend[self.fkey] - ~tags, zero]
        self.name_b = np.maximum(self.name_a, np.concatenate(name_b))
        # items are named by their place
        number = np.full(len(self.parent), -1)
        number[:ne][self.item] = self.eindex[self.item]
        order = np.argsort(self.around[self.fitem], kind="stable")
        con = self.around[self.fitem][order]
        place = np.arange(len(con)) - np.searchsorted(con, con)
        number[at + order] = place
        self.number = number
        self.item_place = number[at:]

    @cached_property
    def names(self) -> pa.Array:
        texts = spans(self.buf, self.name_a, self.name_b)
        numbered = np.flatnonzero(self.number >= 0)
        if not len(numbered):
            return texts
        at = np.arange(len(self.number))
        at[numbered] = len(at) + np.arange(len(numbered))
        return pa.concat_arrays([texts, pa.array(self.number[numbered]).cast(pa.string())]).take(pa.array(at))

    def named_as(self, steps: np.ndarray, name: bytes, prefix: bool = False) -> np.ndarray:
        a, size = self.name_a[steps], self.name_b[steps] - self.name_a[steps]
        out = (steps >= 0) & (self.number[steps] < 0) & ((size >= len(name)) if prefix else (size == len(name)))
        hit = np.flatnonzero(out)
        out[hit] = (self.buf[a[hit][:, None] + np.arange(len(name))] == np.frombuffer(name, np.uint8)).all(1)
        return out

    # ---- rows

    def _kinds(self, v: Values, tagged: np.ndarray) -> Values:
        """With the kinds of plain text, which its spelling decides; behind a tag it is text."""
        open_ = (v.kind < 0) & ~tagged
        kind = np.where(v.kind < 0, STR, v.kind)
        firsts = np.zeros(256, bool)
        firsts[[ord(c) for c in self.resolvers if c and c.isascii()]] = True
        at = np.flatnonzero(open_)
        at = at[firsts[self.buf[v.a[at]]]]
        words = spans(self.buf, v.a[at], v.b[at]).dictionary_encode()
        found = np.array([self._kind(w) for w in words.dictionary.to_pylist()], np.int64)
        if len(at):
            kind[at] = found[np.asarray(words.indices)]
        return Values(v.a, v.b, kind, v.size)

    def _kind(self, word: str) -> int:
        for tag, pattern in self.resolvers.get(word[0], ()):
            if pattern.match(word):
                kind = tag[18:]  # after "tag:yaml.org,2002:"
                return KINDS.index(kind) if kind in ("int", "float", "bool", "null") else STR
        return STR

    def _block_values(self, e: np.ndarray) -> tuple[Values, np.ndarray]:
        """Of entities: the value behind a tag, if any; the list it is (container, those in brackets after
        those of blocks; else -1)."""
        line, below = self.line[e], self.below[e]
        nb = len(self.bcount)
        start = np.full(len(self.line), -1)  # the token of a value in brackets
        lead = np.flatnonzero(self.prev == START)
        rooted = self.region_slot[self.treg[lead]] if len(lead) else lead
        start[rooted[rooted >= 0]] = lead[rooted >= 0]
        token = start[e]
        out = Values(self.inner[line].copy(), self.le[line].copy(), np.full(len(e), -1), np.zeros(len(e), np.int64))
        lists = np.full(len(e), -1)
        for use, what, con in (
            (np.flatnonzero(below >= 0), lambda u: Values(np.zeros(len(u), np.int64), np.full(len(u), -1), np.where(self.blist[below[u]], LIST, MAP), self.bcount[below[u]]), lambda u: below[u]),
            (np.flatnonzero((token >= 0) & (below < 0)), lambda u: self._described(token[u]), lambda u: nb + self.con[token[u]]),
        ):
            got = what(use)
            out.a[use], out.b[use], out.kind[use], out.size[use] = got.a, got.b, got.kind, got.size
            lists[use] = np.where(got.kind == LIST, con(use), -1)
        return out, lists

    def _rows(self) -> None:
        nb = len(self.bcount)
        ne, nt = len(self.line), len(self.btag)
        column = lambda at: at - np.append(0, self.breaks + 1)[np.searchsorted(self.breaks, at)]
        none = lambda n: np.full(n, -1)
        parts = []  # step, place, value, tagged, list, start, end, column, flow, cut from, to, braces

        # entries of blocks
        e = np.flatnonzero(~self.item)
        line, con = self.line[e], self.econ[e]
        below = self.below[e]
        got, lists = self._block_values(e)
        bare, tagged = self.bare[line], self.tagged[line] & ~self.bare[line]
        some = below >= 0
        b = np.maximum(below, 0)
        pick = lambda a: np.append(a, 0)[b]
        end = np.where(some, pick(self.bend), self.le[line])
        start = np.where(some, pick(self.bat), self.v[line])
        inner_flow = np.isin(got.kind, (LIST, MAP)) & ~some
        value = Values.maps(len(e))
        for f in ("a", "b", "kind", "size"):
            setattr(value, f, np.where(tagged, getattr(value, f), getattr(got, f)))
        doc = self.edoc[e]
        cut_to = np.where(end < self.ends[doc], end + 1, end)
        only = self.bcount[con] == 1
        cut_from = np.where(only, self.bat[con], self.ls[line])
        cut_to = np.where(only, self.bend[con], cut_to)
        at_column = np.where(some, pick(self.bcol), start - self.ls[line])
        parts.append((e, self.k0[line], value, np.zeros(len(e), bool), np.where(tagged, -1, lists), start, end, at_column, inner_flow, cut_from, cut_to, only))
        # tags of blocks
        e = self.btag
        line = self.line[e]
        got, lists = self._block_values(e)
        flow = np.isin(got.kind, (LIST, MAP))
        parts.append((ne + np.arange(nt), self.v[line], got, np.ones(nt, bool), lists, self.inner[line], self.le[line], self.inner[line] - self.ls[line], flow, self.v[line], self.le[line], np.ones(nt, bool)))
        # entries in brackets
        steps = ne + nt + np.arange(len(self.fkey))
        named = self.tk[self.fkey] == NAME
        t = self.fkey[named]
        held, final = self.held[t], self.final[t]
        tagged = self.tk[held] == TAG
        got = self._described(final)
        value = Values.maps(len(t))
        for f in ("a", "b", "kind", "size"):
            setattr(value, f, np.where(tagged, getattr(value, f), getattr(got, f)))
        end = self.v_end[final]
        con = self.con[t]
        only = np.append(self.fcount, 0)[con] == 1
        order = np.argsort(con, kind="stable")
        sorted_ = con[order]
        follows = np.append(False, sorted_[1:] == sorted_[:-1])[: len(t)]
        after, before_end = none(len(t)), none(len(t))
        after[order[:-1]] = np.where(follows[1:], self.tat[t][order[1:]], -1)
        before_end[order[1:]] = np.where(follows[1:], end[order[:-1]], -1)
        opened = self.tat[np.append(self.fopen, 0)[con]] if len(t) else con
        cut_from = np.where(only, opened, np.where(after >= 0, self.tat[t], before_end))
        cut_to = np.where(only, np.append(self.fend, 0)[con], np.where(after >= 0, after, end))
        lists = np.where(~tagged & (got.kind == LIST), nb + self.con[final], -1)
        start = self.tat[held]
        parts.append((steps[named], self.tat[t], value, np.zeros(len(t), bool), lists, start, end, column(start), np.ones(len(t), bool), cut_from, cut_to, only))
        # tags in brackets
        t = self.fkey[~named]
        final = np.minimum(t + 1, max(len(self.tk) - 1, 0))
        got = self._described(final)
        start, end = self.tat[final], self.v_end[final]
        lists = np.where(got.kind == LIST, nb + self.con[final], -1)
        yes = np.ones(len(t), bool)
        parts.append((steps[~named], self.tat[t], got, yes, lists, start, end, column(start), yes, self.tat[t], end, yes))

        joined = [Values.join([p[i] for p in parts]) if i == 2 else np.concatenate([p[i] for p in parts]) for i in range(12)]
        step, place, value, tagged, lists, start, end, at_column, flow, cut_from, cut_to, braces = joined
        doc = self._doc(place)
        self._equal_keys(step, tagged, doc)
        use = np.flatnonzero(~self.bad[doc])
        use = use[np.argsort(place[use], kind="stable")]
        self.doc, self.step, self.list = doc[use], step[use], lists[use]
        first = self.starts[self.doc]
        self.value_ = self._kinds(value[use], tagged[use])
        self.start, self.end = start[use] - first, end[use] - first
        self.cut_from, self.cut_to, self.braces = cut_from[use] - first, cut_to[use] - first, braces[use]
        self.column, self.flow = at_column[use], flow[use]

    def _equal_keys(self, step: np.ndarray, tagged: np.ndarray, doc: np.ndarray) -> None:
        keys = np.flatnonzero(~tagged & ~self.bad[doc])
        if not len(keys):
            return
        names = spans(self.buf, self.name_a[step[keys]], self.name_b[step[keys]]).dictionary_encode()
        # roots have no step: their texts tell them apart
        owner = np.where(self.parent[step[keys]] < 0, -1 - doc[keys], self.parent[step[keys]])
        pair = (owner + len(self.bad)) * len(names.dictionary) + np.asarray(names.indices)
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        self.bad[doc[keys][order[1:][same]]] = True

    @cached_property
    def chain(self) -> list[np.ndarray]:
        """The rows' steps, then the steps these hang on, and so on; -1 past the first."""
        out = [self.step]
        while True:
            up = np.where(out[-1] >= 0, self.parent[out[-1]], -1)
            if not (up >= 0).any():
                return out
            out.append(up)

    def items(self) -> tuple[np.ndarray, Values, np.ndarray, np.ndarray]:
        """Elements of the lists that rows hold, in order: row, value, start, end."""
        nb = len(self.bcount)
        row_of = np.full(nb + len(self.fopen) + 1, -1)
        held = self.list >= 0
        row_of[self.list[held]] = np.flatnonzero(held)
        e = np.flatnonzero(self.item)
        line, below = self.line[e], self.below[e]
        got, _ = self._block_values(e)
        some = below >= 0
        b = np.maximum(below, 0)
        tagged = self.tagged[line] & ~some & ~self.named[line]
        first = [(self.econ[e], self.eindex[e], got, tagged, np.where(some, np.append(self.bat, 0)[b], self.v[line]), np.where(some, np.append(self.bend, 0)[b], self.le[line]))]
        t = self.fitem
        final = self.final[t] if len(t) else t
        first.append((nb + self.around[t], self.item_place, self._described(final), self.tk[t] == TAG, self.tat[t], self.v_end[final]))
        con, place, _, tagged, start, end = ([p[i] for p in first] for i in range(6))
        con, place, tagged, start, end = (np.concatenate(x) for x in (con, place, tagged, start, end))
        value = Values.join([p[2] for p in first])
        wrapped = tagged & np.isin(value.kind, (LIST, MAP))
        value = Values(value.a, value.b, np.where(wrapped, MAP, value.kind), np.where(wrapped, 1, value.size))
        row = row_of[con]
        use = np.flatnonzero((row >= 0) & ~self.bad[self._doc(start)])
        use = use[np.lexsort((place[use], row[use]))]
        shift = self.starts[self.doc[row[use]]]
        return row[use], self._kinds(value[use], tagged[use]), start[use] - shift, end[use] - shift

    def nodes(self, node: pa.StructType, reads: list[tuple] | None = None) -> pa.Array:
        """The rows as structs of NODE_TYPE, one list for each text that is read; with `reads`, rows that match one of these."""
        depth = np.sum([c >= 0 for c in self.chain], 0).astype(np.int64)
        row, value, start, end = self.items()
        circular = self._circular(depth, row, value)
        owner, called = self._owners(depth)
        use = np.flatnonzero(self.matching(depth, reads)) if reads is not None else np.arange(len(depth))
        place = np.full(len(depth), -1)
        place[use] = np.arange(len(use))
        row = place[row]
        held = np.flatnonzero(row >= 0)
        row, value, start, end, deep = row[held], value[held], start[held], end[held], depth[use]
        first = np.cumsum(deep) - deep
        flat = np.zeros(deep.sum(), np.int64)
        for k, c in enumerate(self.chain):
            c = c[use]
            some = c >= 0
            flat[(first + deep - 1 - k)[some]] = c[some]
        item = node.field("items").type.value_type
        items = self._struct(item, [self._texts(value), self._kind_names(value.kind), value.size, start, end])
        v = self.value_[use]
        columns = [
            lists(deep, self.names.take(pa.array(flat))), self.names.take(pa.array(self.step[use])), self._texts(v), self._kind_names(v.kind), v.size,
            self.start[use], self.end[use], self.column[use], self.flow[use], lists(np.bincount(row, minlength=len(use)), items),
            self.cut_from[use], self.cut_to[use], pa.array(["", "{}"]).take(pa.array(self.braces[use].astype(np.int8))),
            self._texts(self.value_[np.maximum(owner[use], 0)], owner[use] >= 0), called[use], circular[use],
        ]
        counts = np.bincount(self.doc[use], minlength=len(self.bad))[~self.bad]
        return lists(counts, self._struct(node, columns))

    def matching(self, depth: np.ndarray, reads: list[tuple]) -> np.ndarray:
        """Rows that one of (depth, first step, third step, keys) matches; None matches all."""
        out = np.zeros(len(depth), bool)
        for deep, top, third, keys in reads:
            hit = np.ones(len(depth), bool) if deep is None else depth == deep
            for k, name in ((0, top), (2, third)):
                if name is not None:
                    hit[hit] = self.named_as(self._along(depth, k)[hit], name.encode())
            if keys is not None:
                hit[hit] = np.any([self.named_as(self.step[hit], k.encode()) for k in keys], 0)
            out |= hit
        return out

    def _texts(self, v: Values, known: np.ndarray | bool = True) -> pa.Array:
        some = (v.b >= v.a) & known
        at = np.cumsum(some) - 1
        return spans(self.buf, v.a[some], v.b[some]).take(pa.array(at, mask=~some))

    @staticmethod
    def _kind_names(kind: np.ndarray) -> pa.Array:
        return pa.array(KINDS).take(pa.array(kind))

    @staticmethod
    def _struct(kind: pa.StructType, columns: list) -> pa.Array:
        made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
        made = [c if pa.types.is_list(c.type) else c.cast(f.type) for c, f in zip(made, kind, strict=True)]
        return pa.StructArray.from_arrays(made, fields=[*kind])

    @cached_property
    def chains(self) -> np.ndarray:
        return np.stack(self.chain)

    def _along(self, depth: np.ndarray, k: int) -> np.ndarray:
        """The k-th step of the rows' paths, -1 past their end."""
        return np.where(depth > k, self.chains[np.maximum(depth - 1 - k, 0), np.arange(len(depth))], -1)

    @cached_property
    def in_resources(self) -> np.ndarray:
        top = self.chain[-1].copy()
        for c in self.chain[::-1]:
            top = np.where(top < 0, c, top)
        return self.named_as(top, b"Resources")

    def _owners(self, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row that holds the owner's type (-1: none), and called, as structure_template's _owners tells."""
        second = self._along(depth, 1)
        types = np.flatnonzero(self.in_resources & (depth == 3) & self.named_as(self.step, b"Type"))[::-1]
        typed = np.full(len(self.parent) + 1, -1)
        typed[second[types]] = types
        owner = np.where(self.in_resources & (depth > 2), typed[second], -1)
        calls = self.in_resources & (depth == 5) & (self.named_as(self.step, b"Ref") | self.named_as(self.step, b"Fn::", prefix=True))
        called = np.zeros(len(self.parent) + 1, bool)
        called[self.parent[self.step[calls]]] = True
        return owner, called[self.step] & self.in_resources & (depth == 4)

    def _circular(self, depth: np.ndarray, item_row: np.ndarray, items: Values) -> np.ndarray:
        out = np.zeros(len(depth), bool)
        depends = np.flatnonzero(self.in_resources & (depth == 3) & self.named_as(self.step, b"DependsOn"))
        if not len(depends):
            return out
        is_list = self.value_.kind[depends] == LIST
        held = np.flatnonzero(np.isin(item_row, depends[is_list]))
        owner = np.append(item_row[held], depends[~is_list])
        value = Values.join([items[held], self.value_[depends[~is_list]]])
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        ends = [self.names.take(pa.array(self._along(depth, 1)[owner])), self._texts(value[order])]
        counts = np.bincount(self.doc[owner], minlength=len(self.bad))
        circles = graphs.cyclic(lists(counts, pa.StructArray.from_arrays(ends, ["src", "dst"])))
        out[depends] = circles[self.doc[depends]]
        return out
