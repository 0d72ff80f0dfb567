import math

import numpy as np
import pytest
from pyspark.sql import types as T

from mendset.llm import lattice

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rep", T.StringType())])


def grouped(spark, rows, parts=4):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], ROWS)
    return sorted((tuple(r) for r in lattice.grouped(df.repartition(parts)).collect()), key=repr)


def plain(rows, cosine=0.95):
    """All pairs."""
    good = [(k, np.float32(v).astype(float)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, x in good:
        for b, y in good:
            n = max(len(x), len(y))
            x_, y_ = np.pad(x, (0, n - len(x))), np.pad(y, (0, n - len(y)))
            if a != b and x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= cosine:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        root = min(rows[b][0] for b in seen) if i is not None else None
        out.append((i, len(links[k]), root, True if i is None else root == i))
    return sorted(out, key=repr)


def near(draw, v, cosine):
    """A vector at exactly this cosine to v."""
    w = draw.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    w /= np.linalg.norm(w)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * w


def test_groups_equal_all_pairs(spark):
    draw = np.random.default_rng(3)
    rows = [(7 * i, draw.normal(size=32).tolist()) for i in range(150)]
    for g in range(12):
        v = draw.normal(size=32)
        rows += [(2000 + 40 * g + k, near(draw, v, 0.99 - 0.002 * g).tolist()) for k in range(3 * g + 2)]
    rows += [(4000 + k, rows[3][1]) for k in range(20)]  # copies
    assert grouped(spark, rows) == plain(rows)


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CELL", 16)
    draw = np.random.default_rng(4)
    v = draw.normal(size=24)
    rows = [(i, near(draw, v, 0.985).tolist()) for i in range(120)] + [(500 + i, draw.normal(size=24).tolist()) for i in range(60)]
    assert grouped(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 0.5]
    rows = [(5, one), (9, [2.0, 4.0, 1.0]), (3, [1.0, 2.0, 0.5, 0.0]), (5, one), (6, None), (7, []), (8, [0.0, 0.0]), (10, [1.0, None]), (11, [math.nan, 1.0])]
    rows += [(12, [math.inf]), (None, one), (13, [-1.0, -2.0, -0.5]), (14, [3e38, 3e38]), (15, [3e38, 2.9e38]), (16, [1e-38, 1e-38]), (6, [7.0])]
    assert grouped(spark, rows) == plain(rows)
    assert grouped(spark, [], 1) == []


def test_several_groups_a_table(spark, monkeypatch):
    monkeypatch.setattr(lattice, "RANDOM", 0.01)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=40).tolist()) for i in range(80)]
    rows += [(100 + i, near(draw, np.array(rows[i][1]), 0.98).tolist()) for i in range(40)]
    assert lattice.shape_of(120)[0] > 1
    assert grouped(spark, rows) == plain(rows)


@pytest.mark.parametrize("groups", [1, 2])
def test_recall_at_the_threshold(groups):
    draw = np.random.default_rng(groups)
    n = 6000
    x = draw.normal(size=(n, 48))
    y = np.array([near(draw, v, lattice.COSINE) for v in x])
    u, v = lattice.units(x), lattice.units(y)
    met, single, tables = np.zeros(n, bool), [], math.ceil(math.log(1 - lattice.RECALL) / math.log(1 - lattice.MEETS**groups))
    for t in range(tables):
        p, q = lattice.projected(u, t, groups), lattice.projected(v, t, groups)
        once = lattice.within(p, lattice.homes(q)) | lattice.within(q, lattice.homes(p))
        single.append(once.mean())
        met |= once
    assert np.mean(single) >= lattice.MEETS**groups
    assert met.mean() >= 0.997


def test_decoding_finds_the_nearest_point():
    draw = np.random.default_rng(2)
    p = draw.normal(size=(500, 8)) * 1.3
    home = lattice.decoded(p)
    assert (((home * 2) % 1) == 0).all() and (home.sum(1) % 2 == 0).all()
    others = home[:, None] + lattice.SHIFTS
    mine = ((p - home) ** 2).sum(1)
    assert (mine <= 1 + 1e-9).all() and (mine[:, None] <= ((p[:, None] - others) ** 2).sum(2) + 1e-9).all()
    owner, cells, is_home = lattice.visits(np.rint(p * 65536) / 65536)
    seen = {(i, *c) for i, c in zip(owner, cells)}
    for i in range(500):
        assert {(i, *c) for c in others[i] if ((np.rint(p[i] * 65536) / 65536 - c) ** 2).sum() <= 1} <= seen
    assert is_home.sum() == 500
