"""Small graphs of many rows at once, as flat edge arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cyclic(edges: pa.Array) -> np.ndarray:
    """Which rows of list<struct<src,dst>> hold a cycle; edges with a null end do not count.

    Nodes without a way out are peeled off, with all edges that lead to them, until none is left; what
    remains leads in circles. An index of edges by their target gives each round just its own edges, so
    the work is linear in the edges of all rows together.
    """
    size = np.asarray(edges.value_lengths().fill_null(0)).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    flat = edges.flatten()
    ends = [flat.field(0), flat.field(1)]
    whole = np.asarray(pc.and_(flat.is_valid(), pc.and_(ends[0].is_valid(), ends[1].is_valid())))
    row = row[whole]
    out = np.zeros(len(size), bool)
    if not len(row):
        return out
    names = pa.concat_arrays([e.filter(pa.array(whole)) for e in ends]).dictionary_encode()
    code = np.asarray(names.indices).astype(np.int64)
    nodes, at = np.unique(np.append(row, row) * len(names.dictionary) + code, return_inverse=True)
    src, dst = at[: len(row)], at[len(row) :]
    ways = np.bincount(src, minlength=len(nodes))
    by_target = src[np.argsort(dst, kind="stable")]
    count = np.bincount(dst, minlength=len(nodes))
    first = np.cumsum(count) - count
    gone = np.flatnonzero(ways == 0)
    while len(gone):
        n = count[gone]
        lost = by_target[np.repeat(first[gone] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        lost, times = np.unique(lost, return_counts=True)
        ways[lost] -= times
        gone = lost[ways[lost] == 0]
    out[row[ways[src] > 0]] = True
    return out
