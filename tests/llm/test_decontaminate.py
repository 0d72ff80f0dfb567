import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mendset.llm import decontaminate as dc
from mendset.llm.queries import QUERIES


def distances(pattern, text):
    """Best distance of the pattern to a substring ending at each place, by the plain recurrence."""
    row = list(range(len(pattern) + 1))
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        yield row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=90))
def test_myers(pattern, text):
    assert list(dc.myers(dc._masks(pattern), len(pattern), text)) == list(distances(pattern, text))


def edited(text, n, draw):
    chars = list(text)
    for _ in range(n):
        at = draw.randrange(len(chars))
        chars[at : at + draw.randint(0, 1)] = draw.choice(["x", "yz", ""])
    return "".join(chars)


def test_against_brute_force():
    draw = random.Random(5)
    words = ["ab", "abc", "the", "of", "cab", "bead"]
    items = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 16))) for _ in range(12)] + ["", None, "the the of"]
    matcher = dc.Matcher(items)
    for _ in range(150):
        parts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 20)))]
        parts.append(edited(draw.choice(items[:12]), draw.randint(0, 6), draw))
        text = dc.plain(" ".join([*parts, parts[0]]))
        got = {n: (d, b) for n, d, a, b in matcher.find(text)}
        for n, item in enumerate(matcher.items):
            k = len(item) // dc.ERRORS_PER
            ends = [(d, e + 1) for e, d in enumerate(distances(item, text))] if item else []
            if k == 0:
                ends = [(d, e) for d, e in ends if f" {item} " in f" {text} "]
            best = min(ends, default=(k + 1, 0))
            assert (got.get(n) or (k + 1, 0))[0] == min(best[0], k + 1)
            if n in got and k:
                assert got[n] == best
        for n, d, a, b in matcher.find(text):
            assert list(distances(matcher.items[n], text[a:b]))[-1] >= d


def test_tables(spark):
    item = "Of the people, by the people, for the people shall not perish"
    docs = spark.createDataFrame(
        [(1, "so:  OF the people, by the\npeople for the people shall not perish!", "x"), (1, None, "x"), (2, "", "y"), (3, "of the people", None)],
        "doc_id bigint, text string, item_id string",
    )
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id int, text string")
    rows = dc.matches(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in rows] == [(1, 7, 1)] * 2
    left = dc.decontaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == ["", "", "of the people"]
    assert dc.matches(docs, items.filter("false")).count() == 0
    assert dc.matches(docs.filter("false"), items).count() == 0


def test_blocks_give_the_same(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, dc.matches(docs, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 8000)
    assert sorted(map(tuple, dc.matches(docs, items).collect())) == one


def test_query_finds_whole_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op7_decontamination"](spark, sf).collect()}
    for d in docs:
        for i in items:
            if dc.plain(i.text) in dc.plain(d.text):
                assert found[d.doc_id, i.item_id] == 0
