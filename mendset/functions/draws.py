"""Reproducible draws. Built on md5 so that results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendset.functions.text import let


def draw(seed: int, *parts: Column | str) -> Column:
    """A bigint in [0, 2^32) decided by the seed and the parts."""
    cols: list[Column | str] = [str(seed)]
    for p in parts:
        # fixed parts that follow one another are one
        if isinstance(p, str) and isinstance(cols[-1], str):
            cols[-1] += f"|{p}"
        else:
            cols.append(p if isinstance(p, str) else p.cast("string"))
    cols = [F.lit(p) if isinstance(p, str) else p for p in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def pick(candidates: Column, number: Column, given: bool = False) -> Column:
    """The element the draw points at; null for an empty array. `given` candidates are a column of the row."""

    def at(c: Column) -> Column:
        return F.get(c, F.pmod(number, F.greatest(F.size(c), F.lit(1))).cast("int"))

    return at(candidates) if given else let(candidates, at)
