import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mendset.llm import chunks
from mendset.llm.queries import QUERIES


def cut(text):
    """Chunks of one text as (start, stop, words)."""
    _, start, stop, words, _, _ = chunks.chunks(pa.array([text], pa.string()))
    raw = (text or "").encode()
    return [(int(a), int(b), tuple(raw[a:b].split())) for a, b, _ in zip(start, stop, words)]


def draw_words(draw, n):
    return [draw.choice("abcdefgh") + str(draw.randrange(60)) for _ in range(n)]


def test_chunks_cover_the_words_and_line_up():
    draw = random.Random(3)
    a, b, c = (draw_words(draw, n) for n in (90, 60, 77))
    whole, other = cut(" ".join(a + b + c)), cut("  new\nstart " + "  ".join(b) + "\n tail")
    assert [w for x in whole for w in x[2]] == [w.encode() for w in a + b + c]
    assert all(len(x[2]) <= chunks.SPAN for x in whole)
    shared = {x[2] for x in whole} & {x[2] for x in other}
    assert sum(map(len, shared)) >= chunks.MIN_WORDS


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 120), st.integers(0, 120))
def test_any_51_words_hold_enough_whole_chunks(seed, before, after):
    draw = random.Random(seed)
    passage = draw_words(draw, 51)
    one = cut(" ".join(draw_words(draw, before) + passage + draw_words(draw, after)))
    two = cut(" ".join(draw_words(draw, after) + passage + draw_words(draw, before)))
    texts = {x[2] for x in one}
    inside = [x[2] for x in two if x[2] in texts and " ".join(w.decode() for w in x[2]) in " ".join(passage)]
    assert sum(map(len, inside)) >= chunks.MIN_WORDS


def plain(rows):
    """(doc_id, start, stop, words, words_removed, copies) by a dictionary of chunks."""
    cuts = {d: cut(t) for d, t in rows}
    copies = Counter(x[2] for c in cuts.values() for x in c)
    kept = {}
    for d in sorted(cuts):
        for number, x in enumerate(cuts[d]):
            kept.setdefault(x[2], (d, number))
    out = []
    for d, c in cuts.items():
        island = []
        for number, x in enumerate([*c, (0, 0, ())]):
            if copies[x[2]] > 1 and x[2]:
                island.append((number, x))
            else:
                words = sum(len(x[2]) for _, x in island)
                if words >= chunks.MIN_WORDS:
                    removed = sum(len(x[2]) for n, x in island if kept[x[2]] != (d, n))
                    out.append((d, island[0][1][0], island[-1][1][1], words, removed, max(copies[x[2]] for _, x in island)))
                island = []
    return sorted(out)


def test_against_a_dictionary(spark):
    draw = random.Random(8)
    passages = [" ".join(draw_words(draw, n)) for n in (51, 60, 80, 200)]
    rows = []
    for d in range(60):
        parts = [" ".join(draw_words(draw, draw.randint(0, 90)))]
        parts += [draw.choice(passages) for _ in range(draw.randint(0, 2))]
        rows.append((d, " ".join([*parts, " ".join(draw_words(draw, 9))])))
    rows += [(100, None), (101, ""), (102, "same " * 300), (103, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r)[:5] + (r.copies,) for r in chunks.repeats(docs).collect()]
    assert sorted(got) == plain(rows)
    left = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect()}
    removed = Counter()
    for d, _, _, _, gone, _ in plain(rows):
        removed[d] += gone
    for d, t in rows:
        assert len((left[d] or "").split()) == len((t or "").split()) - removed[d]


def test_repeated_rows_nulls_and_columns(spark):
    text = " ".join(draw_words(random.Random(1), 60))
    docs = spark.createDataFrame([(None, text, "x"), (2, text, None), (3, "short", "y")], "doc_id int, text string, cuts string")
    assert {r.doc_id: r.words_removed for r in chunks.repeats(docs).collect()} == {None: 0, 2: 60}
    left = chunks.without_repeats(docs)
    assert left.columns == docs.columns and {r.doc_id: r.text for r in left.collect()} == {None: text, 2: "", 3: "short"}
    assert chunks.repeats(docs.filter("false")).count() == 0


def test_low_entropy_ends():
    assert chunks.chunk_ends(np.zeros(40, np.uint64), np.zeros(40, np.int64)).sum() == 30


def rest(text, cuts):
    """The text without the byte ranges; white space between two of them goes too."""
    raw, out, at = text.encode(), b"", 0
    for start, stop in sorted(cuts):
        between = raw[at:start]
        out += between if not at or between.split() else b""
        at = stop
    return (out + raw[at:]).decode()


def plain_cuts(rows):
    """Of each document, the byte ranges of chunks in repeated passages whose first place is elsewhere."""
    passages = plain(rows)
    first = {}
    for d, t in sorted(rows):
        for number, x in enumerate(cut(t)):
            first.setdefault(x[2], (d, number))
    spans = {}
    for d, t in rows:
        inside = [(a, b) for e, a, b, *_ in passages if e == d]
        for number, (start, stop, words) in enumerate(cut(t)):
            if first[words] != (d, number) and any(a <= start and stop <= b for a, b in inside):
                spans.setdefault(d, []).append((start, stop))
    return spans


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_substring_dedup"](spark, sf).collect()
    assert sorted(tuple(r)[:6] for r in got) == plain(rows)
    texts, cuts = dict(rows), plain_cuts(rows)
    for r in got:
        left = rest(texts[r.doc_id], cuts.get(r.doc_id, []))
        assert (r.left_chars, r.left_sha256) == (len(left), hashlib.sha256(left.encode()).hexdigest())


def test_least_run_and_a_very_long_text(spark):
    notice = " ".join(draw_words(random.Random(3), 60))
    long = " ".join(draw_words(random.Random(4), 300_000))
    docs = spark.createDataFrame([(1, long + " " + notice), (2, notice), (3, long)], "doc_id bigint, text string")
    assert {r.doc_id: r.words_removed for r in chunks.repeats(docs).collect()}[3] > 299_900
    assert {r.doc_id for r in chunks.repeats(docs.filter("doc_id < 3"), min_words=70).collect()} == set()
    assert {len((r.text or "").split()) < 25 for r in chunks.without_repeats(docs).collect()} == {True, False}
