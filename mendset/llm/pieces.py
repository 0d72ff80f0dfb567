"""SentencePiece encoding and decoding (BPE models) by vectorised merge rounds.

Symbols of many words lie in one flat array. A round finds the minimum pair rank of every word
(segmented), merges that pair at its leftmost non-overlapping places in all words at once, and
compacts the array; words without a known pair leave it. Rounds go on until no word is left.

Words are runs of characters in which every adjacent pair of characters occurs inside some piece, so
no merge can cross their ends, and equal words of a block are encoded once. A rank whose merge could
make a pair of the same or a better rank (the runs of spaces, which share one score) merges one place
per word and round, as the sequential algorithm would; words longer than LONG symbols, where rounds
are many, take that algorithm itself.

Null and empty texts have no pieces (only begin and end ids, if asked for) and decode to ''. Ids that
the model does not have raise an error. Duplicate rows and further columns do not matter: the
functions are column expressions.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.llm.flat import BLOCK, slices, text_bytes

SPACE_MARK = "▁"
WORDS_AT_ONCE = 1 << 18  # symbols of one round of merging
LONG = 4096
NONE = np.iinfo(np.int32).max


class Model:
    """Lookup tables of a BPE model file."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(content)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only BPE models without a normalisation table are covered")
        self.prefix = rules.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        names = [p.piece for p in proto.pieces]
        self.n = len(names)
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.unknown = proto.trainer_spec.unk_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not covered")
        # byte fallback: ids of the 256 bytes, or the unknown id for all of them
        self.bytes = np.full(256, self.unknown, np.int32)
        self.fallback = proto.trainer_spec.byte_fallback
        byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        for i, b in byte_of.items():
            self.bytes[b] = i
        # characters and neighbouring characters of pieces
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.char[0x20] = self.char[ord(SPACE_MARK)]
        letters = sorted({c for piece in normal for c in piece})
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letter[0x20] = self.letter[ord(SPACE_MARK)]
        number = {c: k for k, c in enumerate(letters)}
        self.joined = np.zeros((len(letters), len(letters)), bool)
        for piece in normal:
            for a, b in zip(piece, piece[1:]):
                self.joined[number[a], number[b]] = True
        # merges: left * n + right -> piece, ranked by score (equal scores share a rank)
        scores = np.array([proto.pieces[i].score for i in normal.values()], np.float32)
        rank_of_score = {s: r for r, s in enumerate(sorted(set(scores.tolist()), reverse=True))}
        rank = {i: rank_of_score[s] for i, s in zip(normal.values(), scores.tolist())}
        merges = [
            (normal[piece[:k]] * self.n + normal[piece[k:]], rank[i], i)
            for piece, i in normal.items()
            for k in range(1, len(piece))
            if piece[:k] in normal and piece[k:] in normal
        ]
        merges.sort()
        self.pair = np.array([m[0] for m in merges] or [-1], np.int64)
        self.pair_rank = np.array([m[1] for m in merges] or [NONE], np.int32)
        self.pair_piece = np.array([m[2] for m in merges] or [0], np.int32)
        # ranks that a merge may be followed by again, or by a better one
        self.loose = np.zeros(len(rank_of_score) + 1, bool)
        for key, r, _ in merges:
            for part in (key // self.n, key % self.n):
                if r <= rank[part] and len(names[part]) > 1:
                    self.loose[rank[part]] = True
        # a direct table of pairs: open addressing, a few slots per pair
        self.slots = 1 << max(4, int(np.ceil(np.log2(len(merges) * 3 + 1))))
        self.table = np.full(self.slots, -1, np.int32)
        for k, key in enumerate(self.pair.tolist()):
            at = self._slot(np.array([key], np.int64))[0]
            while self.table[at] >= 0:
                at = (at + 1) % self.slots
            self.table[at] = k
        # decoding: bytes of each piece
        spelled = []
        self.control = np.zeros(self.n, bool)
        self.is_byte = np.zeros(self.n, bool)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.CONTROL:
                self.control[i] = True
                spelled.append(b"")
            elif p.type == kinds.BYTE:
                self.is_byte[i] = True
                spelled.append(bytes([byte_of[i]]))
            elif p.type == kinds.UNKNOWN:
                spelled.append(proto.trainer_spec.unk_surface.encode())
            else:
                spelled.append(p.piece.replace(SPACE_MARK, " ").encode())
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.width = np.array([len(s) for s in spelled], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.spaced = np.array([p.piece.startswith(SPACE_MARK) for p in proto.pieces])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.slots

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, -1 without one."""
        keys = left.astype(np.int64) * self.n + right
        at = self._slot(keys)
        found = self.table[at]
        open_ = np.flatnonzero((found >= 0) & (self.pair[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.slots
            found[open_] = self.table[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.pair[found[open_]] != keys[open_])]
        return found


@functools.lru_cache(maxsize=4)
def _loaded(digest: str, content: bytes) -> Model:
    return Model(content)


def load(content: bytes) -> Model:
    return _loaded(hashlib.sha256(content).hexdigest(), content)


def _sequential(model: Model, symbols: list[int]) -> list[int]:
    """Best rank first, leftmost among equals, by a heap over a linked list."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n:
            k = int(model.find(np.array([symbols[a]]), np.array([symbols[b]]))[0])
            if k >= 0:
                heapq.heappush(heap, (int(model.pair_rank[k]), a, symbols[a], symbols[b], int(model.pair_piece[k])))

    found = model.find(np.array(symbols[:-1]), np.array(symbols[1:]))
    for a in np.flatnonzero(found >= 0).tolist():
        k = found[a]
        heap.append((int(model.pair_rank[k]), a, symbols[a], symbols[a + 1], int(model.pair_piece[k])))
    heapq.heapify(heap)
    while heap:
        _, a, left, right, piece = heapq.heappop(heap)
        b = after[a]
        if symbols[a] != left or b >= n or symbols[b] != right:
            continue
        symbols[a], symbols[b] = piece, -1
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [s for s in symbols if s >= 0]


def merge_words(model: Model, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the words symbols[starts[i]:starts[i + 1]]; the pieces and the number of each word's."""
    n_words = len(starts)
    sizes = np.diff(np.append(starts, len(symbols)))
    done: list[tuple[np.ndarray, np.ndarray]] = []  # word and symbol of finished words
    for w in np.flatnonzero(sizes > LONG):
        pieces = _sequential(model, symbols[starts[w] : starts[w] + sizes[w]].tolist())
        done.append((np.full(len(pieces), w), np.array(pieces, np.int32)))
    word = np.repeat(np.arange(n_words), sizes)
    keep = (sizes <= LONG)[word]
    word, symbols = word[keep], symbols[keep]
    while len(symbols):
        same = word[1:] == word[:-1]
        found = np.full(len(symbols), -1, np.int32)
        found[:-1][same] = model.find(symbols[:-1][same], symbols[1:][same])
        rank = np.where(found >= 0, model.pair_rank[found], NONE)
        first = np.flatnonzero(np.append(True, ~same))
        count = np.diff(np.append(first, len(symbols)))
        least = np.minimum.reduceat(rank, first)
        over = least == NONE
        if over.any():  # these words are whole
            whole = np.repeat(over, count)
            done.append((word[whole], symbols[whole]))
            left = ~whole
            word, symbols, rank, found, least, count = word[left], symbols[left], rank[left], found[left], least[~over], count[~over]
            if not len(symbols):
                break
            first = np.cumsum(count) - count
        hit = rank == np.repeat(least, count)
        # of a chain of overlapping places every second one, of a loose rank only the word's first
        at = np.flatnonzero(hit)
        place = np.arange(len(at))
        head = np.append(True, np.diff(at) != 1)
        offset = place - np.maximum.accumulate(np.where(head, place, 0))
        take = offset % 2 == 0
        loose = model.loose[rank[at]]
        if loose.any():
            take &= ~loose | np.append(True, word[at[1:]] != word[at[:-1]])
        at = at[take]
        symbols[at] = model.pair_piece[found[at]]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        word, symbols = word[stays], symbols[stays]
    if not done:
        return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
    word, symbols = (np.concatenate(x) for x in zip(*done))
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=n_words)


def _expand(lengths: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Indexes origin[i] .. origin[i] + lengths[i] - 1 of all i in a row."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(origin, lengths)


def _encode_words(model: Model, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of `chars` (code points), and the number of ids of each word."""
    sizes = np.diff(np.append(starts, len(chars)))
    # equal words once: by length and two hashes, with the characters compared afterwards
    key = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[_expand(sizes, np.zeros(len(sizes), np.int64))], starts)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)
    group, _ = pd.factorize(key)
    some = np.zeros(group.max() + 1, np.int64)
    some[group[::-1]] = np.arange(len(group))[::-1]  # the first word of each group
    same = sizes == sizes[some[group]]
    model_char = np.where(same, starts[some[group]], starts)
    equal = np.logical_and.reduceat(chars == chars[_expand(sizes, model_char)], starts) & same
    if not equal.all():  # a collision: such words stand for themselves
        odd = np.flatnonzero(~equal)
        group[odd] = len(some) + np.arange(len(odd))
        some = np.append(some, odd)
    lengths = sizes[some]
    flat = chars[_expand(lengths, starts[some])]
    symbols = model.char[flat]
    begins = np.cumsum(lengths) - lengths
    # characters outside the vocabulary are words of their own (no piece holds them); their bytes follow
    unknown = symbols < 0
    pieces, counts = merge_words(model, np.where(unknown, model.n + flat, symbols).astype(np.int32), begins)
    if unknown.any():
        pieces, counts = _spell_unknown(model, pieces, counts)
    at = np.cumsum(counts) - counts
    return pieces[_expand(counts[group], at[group])], counts[group]


_WEIGHTS = np.cumprod(np.full(WORDS_AT_ONCE + 64, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def _spell_unknown(model: Model, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odd = pieces >= model.n
    points = (pieces[odd] - model.n).astype(np.uint32)
    spelled = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    raw = np.frombuffer(spelled, np.uint8)
    width = np.ones(len(pieces), np.int64)
    if model.fallback:
        width[odd] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    out = np.repeat(pieces, width)
    out[np.repeat(odd, width)] = model.bytes[raw] if model.fallback else model.unknown
    word = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(word, weights=width, minlength=len(counts)).astype(np.int64)


def encode_batch(model: Model, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text, without begin and end."""
    for lo, hi in slices(texts, BLOCK):
        data, offsets = text_bytes(texts.slice(lo, hi - lo))
        lead = (data & 0xC0) != 0x80
        at = np.append(0, np.cumsum(lead))[offsets]  # first character of each text
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        filled = np.flatnonzero(np.diff(at))
        if model.prefix:
            chars = np.insert(chars, at[:-1][filled], 0x20)
            shift = np.zeros(len(at), np.int64)
            shift[1:] = np.cumsum(np.diff(at) > 0)
            at = at + shift
        if not len(chars):
            yield from (np.zeros(0, np.int32) for _ in range(hi - lo))
            continue
        letter = model.letter[chars]
        starts = np.ones(len(chars), bool)
        inner = (letter[1:] >= 0) & (letter[:-1] >= 0)
        inner[inner] = model.joined[letter[:-1][inner], letter[1:][inner]]
        starts[1:] = ~inner
        starts[at[:-1][filled]] = True
        # a space mark typed as such is the same symbol as a space
        chars = np.where(chars == 0x20, ord(SPACE_MARK), chars)
        word_at = np.flatnonzero(starts)
        ends = np.append(word_at[1:], len(chars))
        ids, counts = [], []
        w = 0
        while w < len(word_at):
            e = max(w + 1, int(np.searchsorted(ends, word_at[w] + WORDS_AT_ONCE, "right")))
            base, stop = word_at[w], ends[e - 1]
            if stop - base > WORDS_AT_ONCE:  # one word longer than a block
                symbols = model.char[chars[base:stop]]
                got = np.array(_sequential(model, symbols.tolist()), np.int32)
                ids.append(got)
                counts.append(np.array([len(got)]))
            else:
                got, many = _encode_words(model, chars[base:stop], word_at[w:e] - base)
                ids.append(got)
                counts.append(many)
            w = e
        flat, many = np.concatenate(ids), np.concatenate(counts)
        bounds = np.append(0, np.cumsum(many))[np.searchsorted(word_at, at)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield flat[a:b]


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _each_byte)


def decode_ids(model: Model, ids: np.ndarray) -> str:
    """Text of the ids: controls vanish, the leading space mark goes, stray bytes become U+FFFD each."""
    if len(ids) and (ids.min() < 0 or ids.max() >= model.n):
        raise ValueError("an id is outside the model")
    ids = ids[~model.control[ids]]
    if not len(ids):
        return ""
    text = model.spelled[_expand(model.width[ids], model.at[ids])].tobytes()
    if model.prefix and model.spaced[ids[0]]:
        text = text[1:]
    try:
        return text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "each-byte")


def encode(text: Column, model: bytes, begin: bool = False, end: bool = False) -> Column:
    """struct(ids, n_tokens): the ids packed as little-endian unsigned 32-bit integers, and their number."""

    @F.arrow_udf("ids binary, n_tokens bigint")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = load(model)
        head = np.array([m.begin] if begin else [], "<u4")
        tail = np.array([m.end] if end else [], "<u4")
        for texts in batches:
            for a, b in slices(texts, BLOCK):  # what goes back need not keep the batches
                made = encode_batch(m, texts.slice(a, b - a))
                packed = [np.concatenate([head, ids.astype("<u4"), tail]).tobytes() for ids in made]
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), counts], names=["ids", "n_tokens"])

    return encoded(text.cast("string"))


def decode(ids: Column, model: bytes) -> Column:
    """The text of packed ids; null ids decode to ''."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = load(model)
        for packed in batches:
            texts = (decode_ids(m, np.frombuffer(p, "<u4").astype(np.int64)) for p in packed.fill_null(b"").to_pylist())
            yield pa.array(texts, pa.string())

    return decoded(ids)


def tokenized(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The documents with `piece_ids` (packed, with begin and end), `n_tokens` and `decoded`.

    These three names replace columns of the same names. Encoding and decoding share one Python
    worker per task.
    """

    @F.arrow_udf("ids binary, n_tokens bigint, text string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = load(model)
        for texts in batches:
            for a, b in slices(texts, BLOCK):  # what goes back need not keep the batches
                packed, counts, again = [], [], []
                for ids in encode_batch(m, texts.slice(a, b - a)):
                    ids = np.concatenate([[m.begin], ids, [m.end]]).astype("<u4")
                    packed.append(ids.tobytes())
                    counts.append(len(ids))
                    again.append(decode_ids(m, ids.astype(np.int64)))
                arrays = [pa.array(packed, pa.binary()), pa.array(counts, pa.int64()), pa.array(again, pa.string())]
                yield pa.StructArray.from_arrays(arrays, names=["ids", "n_tokens", "text"])

    made = docs.withColumn("_pieces", both(F.col(text).cast("string")))
    names = {"piece_ids": "ids", "n_tokens": "n_tokens", "decoded": "text"}
    return made.withColumns({k: F.col(f"_pieces.{v}") for k, v in names.items()}).drop("_pieces")
