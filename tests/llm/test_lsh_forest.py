import math
import random

import pytest

from mendset.llm import lsh_forest, tries
from mendset.llm.components import components
from mendset.llm.queries import QUERIES


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """class_id and n_links of (doc_id, text) rows by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_longest_prefixes_alone_miss_the_target_and_shortest_meet_it():
    need = -math.log(1 - lsh_forest.TARGET)
    assert lsh_forest.TREES * tries.weight(8, 0.8) < need < lsh_forest.TREES * tries.weight(6, 0.8)


def _paths(spark, rows):
    """Paths by hand: rows of (node, [(stem, next, last)])."""
    return spark.createDataFrame(rows, "node bigint, paths array<struct<stem: bigint, next: int, last: int>>")


def test_crowded_trie_nodes_stay_divided_while_the_recall_allows(spark, monkeypatch):
    monkeypatch.setattr(tries, "CROWD", 3)
    crowded = [(n, [(t, n % 2, n // 2) if t < k else (100 + 50 * n + t, 0, 0) for t in range(32)]) for n in range(4) for k in [17]]
    assert tries.leaves(_paths(spark, crowded), 32, 0.8, 0.9995).groupBy("leaf").count().filter("count > 1").isEmpty()
    everywhere = [(n, [(t, n % 2, n // 2) for t in range(32)]) for n in range(4)]
    sizes = [r["count"] for r in tries.leaves(_paths(spark, everywhere), 32, 0.8, 0.9995).groupBy("leaf").count().collect()]
    got = sum({1: 0.25 * tries.weight(8, 0.8), 2: 0.5 * tries.weight(7, 0.8), 4: tries.weight(6, 0.8)}[s] for s in sizes)
    assert sizes.count(4) < 32 and got >= -math.log(1 - 0.9995)
    sparse = [(n, [(t, n % 2, n // 2) for t in range(32)]) for n in range(3)]
    assert tries.leaves(_paths(spark, sparse), 32, 0.8, 0.9995).groupBy("leaf").count().filter("count = 3").count() == 32


def test_false_meetings_do_not_chain(spark):
    draw = random.Random(5)
    sketch = lambda: bytearray(draw.randrange(256) for _ in range(256))
    alone = [sketch() for _ in range(6)]
    near = bytearray(alone[5])
    near[:40] = bytes((x + 1) % 256 for x in near[:40])
    sketches = spark.createDataFrame([(i, s) for i, s in enumerate([*alone, near])], "node bigint, sketch binary")
    pairs = [(i, i + 1) for i in range(4)] + [(0, 5, 6)]  # a chain of leaves, and one whose leader is unlike the pair in it
    met = spark.createDataFrame([(n, leaf) for leaf, nodes in enumerate(pairs) for n in nodes], "node bigint, leaf bigint")
    assert sorted(map(tuple, tries.ties(met, sketches).distinct().collect())) == [(6, 5)]
    crowd = spark.createDataFrame([(n, 0) for n in range(7)], "node bigint, leaf bigint")  # more rounds than ROUNDS: the rest is tied uncompared
    tied = components(tries.ties(crowd, sketches)).collect()
    assert len({r.root for r in tied if r.node in (5, 6)}) == 1


def test_recall_at_the_threshold(spark):
    """Many pairs of a similarity just above the threshold, and many texts that share half of their words."""
    draw = random.Random(9)
    head = " ".join(f"h{i}" for i in range(60))
    rows, pairs = [], 300
    for p in range(pairs):
        words = [f"p{p}w{i}" for i in range(104)]
        other = [*words[:-11], *[f"p{p}x{i}" for i in range(11)]]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    rows += [(10_000 + i, head + " " + " ".join(f"u{draw.randrange(10**9)}" for _ in range(60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert 5 * len(shingles(rows[0][1]) & shingles(rows[1][1])) >= 4 * len(shingles(rows[0][1]) | shingles(rows[1][1])) > 0
    got = {r.doc_id: (r.class_id, r.n_links) for r in lsh_forest.join(docs).collect()}
    assert sum(got[2 * p + 1] == (2 * p, 1) for p in range(pairs)) >= 0.999 * pairs
    assert all(got[10_000 + i] == (10_000 + i, 0) for i in range(300))


def test_ids_of_any_type_and_a_long_text(spark):
    long = " ".join(f"w{i % 5003}" for i in range(200_000))
    rows = [("a", "one two three four five six"), ("b", "one two three four five six"), ("7", long), ("8", long + " end"), ("2024-01-01", "alone here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.class_id, r.n_links) for r in lsh_forest.join(docs).collect()), key=str)
    assert got == [(7, 1), (7, 1), (None, 0), (None, 1), (None, 1)]
    left = lsh_forest.one_of_each(docs)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect() if r.doc_id not in "ab") == ["2024-01-01", "7"]
    assert left.filter("doc_id in ('a', 'b')").count() == 1


def corpus():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[draw.choice(words) for _ in range(draw.randint(3, 120))] for _ in range(25)]
    rows = []
    for text in base:
        for _ in range(draw.randint(1, 8)):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    extra = [None, "", " \n", "one", "one", "one two", rows[0][1], rows[0][1] + " ", "same " * 50, "same " * 60]
    return rows + [(1000 + i, t) for i, t in enumerate(extra)]


@pytest.mark.parametrize("block", [512, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK_DOCS", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, lsh_forest.join(docs).collect())) == plain(rows)
    kept = {r.doc_id for r in lsh_forest.one_of_each(docs).collect()}
    assert kept == {c for _, c, _ in plain(rows)}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "SMALL", -1)
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    assert sorted(map(tuple, lsh_forest.join(docs).collect())) == plain(corpus())


def test_repeated_rows_nulls_and_columns(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "y"), (None, "null id here", "z"), (3, None, "z"), (4, "other words entirely now ok", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, class_id string")
    got = sorted(map(tuple, lsh_forest.join(docs).filter("doc_id is not null").collect()))
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0)]
    assert [r.class_id for r in lsh_forest.join(docs).filter("doc_id is null").collect()] == [None]
    left = lsh_forest.one_of_each(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "3", "4", "None"]
    assert lsh_forest.join(docs.filter("false")).count() == 0 and lsh_forest.one_of_each(docs.filter("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_jaccard_join"](spark, sf).collect())) == plain(rows)
