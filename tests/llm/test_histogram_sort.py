import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mendset.llm import histogram_sort as hs
from mendset.llm.queries import QUERIES


def check(rows, texts, shards, balance):
    by = defaultdict(list)
    where = {}
    for r in rows:
        by[r.shard].append(r.slot)
        where.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len(v) == 1 for v in where.values()) and set(by) <= set(range(shards))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    share = sum(sizes.values()) / shards
    assert max(abs(sizes[s] - share) for s in range(shards)) <= balance * share
    return sizes


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_sharding"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    check(rows, texts, 8, 0.05)


def test_splitters_against_plain_sort(spark):
    rows = [(k * 7919 % 10007, 1 + k % 13) for k in range(3000)]
    df = spark.createDataFrame(rows, "key bigint, size bigint")
    cuts, error = hs.splitters(df, 4, 0.0)
    total = sum(s for _, s in rows)
    keys = sorted({k for k, _ in rows})
    below = {c: sum(s for k, s in rows if k < c) for c in [*keys, keys[-1] + 1]}
    for j, c in enumerate(cuts):
        goal = total * (j + 1) / 4
        best = min(abs(b - goal) for b in below.values())
        assert abs(sum(s for k, s in rows if k < c) - goal) == pytest.approx(best)
    assert error * total / 4 == pytest.approx(max(min(abs(b - total * (j + 1) / 4) for b in below.values()) for j in range(3)))


def test_hot_group_nulls_and_repeats(spark):
    rows = [(i, "same text" * 3 if i % 3 == 0 else (None if i % 50 == 1 else f"text {i}"), "s") for i in range(3000)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id int, text string, shard string")
    out = hs.sharded(docs).collect()
    assert len(out) == 3002
    sizes = check(out, {i: t for i, t, _ in rows}, 8, 4.0)
    others = sorted(sizes.values())[:7]
    assert len(sizes) == 8 and max(sizes.values()) == 1001 * 28 and others[-1] - others[0] < 0.1 * others[0]


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert hs.sharded(docs.filter("false")).count() == 0
    (row,) = hs.sharded(docs).collect()
    assert (row["size"], row.slot) == (1, 0)
    assert hs.sharded(docs, shards=1).select(F.max("shard")).first()[0] == 0
