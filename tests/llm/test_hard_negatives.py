import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendset.llm import hard_negatives as mine

ROWS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())]
)


def plain(rows, low=30, high=90):
    """The contract, pair by pair, in whole numbers."""
    table = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        table.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    anchors = {}
    for i, label, q in table:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    for a, (label, q) in anchors.items():
        scores = sorted((-dot(q, r), i, m) for i, m, r in table if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            fits = [x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits[:10])]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(parts)
    return sorted(tuple(r) for r in mine.mined(mine.prepared(df), F.col("vec_id") % 100 == 0).collect())


def vectors(draw, n, size=20, spread=1.0):
    return [[draw.gauss(0, spread) for _ in range(size)] for _ in range(n)]


def test_equals_all_pairs(spark):
    draw = random.Random(5)
    rows = [(25 * i, draw.randrange(3), v) for i, v in enumerate(vectors(draw, 160))]
    rows += [(25 * i + 1, label, [x + draw.gauss(0, 0.3) for x in v]) for i, label, v in rows[:60] for i in [i // 25]]
    assert mined(spark, rows) == plain(rows)


def test_ties_nulls_and_odd_vectors(spark):
    draw = random.Random(6)
    one = [1.0, 0.5, -0.25, 0.0]
    rows = [(i, i % 2, one) for i in range(30)] + [(100 + i, i % 2, [x / 2 for x in one]) for i in range(30)]
    rows += [(200, None, one), (300, 1, None), (400, 1, [1.0, None]), (500, 0, [math.nan]), (600, 1, [math.inf, 1.0]), (None, 1, one)]
    rows += [(700, 1, []), (800, 0, [0.0] * 4), (900, 0, [3.0] * 40), (901, 1, [2.0, 2.0]), (902, 0, [-1.0] * 4)]
    rows += [(100, 0, one), (3, 1, one), (3, 1, one)]  # ids that are there more than once
    rows += [(1000, 1, [draw.gauss(0, 1) for _ in range(4)])]
    assert mined(spark, rows) == plain(rows)


def test_large_numbers_are_exact(spark):
    rows = [(100 * i, i % 2, [2.0**20 + 3 * i, 2.0**20 - i, 5.0 * i]) for i in range(8)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, [*rows, (7, 0, [3e38, 1.0])]) == plain(rows)  # its scores need not fit


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(100, 0, [1.0]), (2, 0, [1.0])]) == []


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(mine, "BLOCK", 16)
    draw = random.Random(7)
    rows = [(20 * i, draw.randrange(2), v) for i, v in enumerate(vectors(draw, 200, 9))]
    assert mined(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [16, 64])
def test_bounds_hold_and_tighten(size):
    draw = np.random.default_rng(size)
    q = np.floor(256 * draw.normal(size=(60, size)))
    mean, deviation = mine.summaries(q)
    batch = pa.table({"vec_id": range(60), "label": [0] * 60, "q": list(q), "mean": list(mean.astype("f4")), "deviation": list(deviation.astype("f4"))})
    rows = mine.Rows.of(batch)
    exact, last = q @ q.T, np.inf
    for width, (m, d) in zip(mine.WIDTHS, rows.levels):
        whole = mine.summaries(q, width)
        assert np.allclose(m, whole[0], atol=1e-3) and np.allclose(d, whole[1], rtol=1e-4)
        off = np.abs(exact - width * m @ m.T) - d @ d.T
        assert (off <= mine.SLACK * np.outer(rows.norm, rows.norm)).all()
        assert (d @ d.T).mean() < last
        last = (d @ d.T).mean()


def test_segments_spare_exact_scores():
    """Smooth vectors are told apart by their summaries alone."""
    draw = np.random.default_rng(1)
    q = np.floor(256 * np.repeat(draw.normal(size=(400, 4)), 16, 1) + draw.normal(size=(400, 64)))
    m, d = mine.summaries(q, 16)
    upper = 16 * m @ m.T + d @ d.T
    exact = q @ q.T
    assert (upper >= np.sort(exact, 1)[:, -10][:, None]).mean() < 0.05
