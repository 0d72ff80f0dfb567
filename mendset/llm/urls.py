"""URL filters: rules first, then a ratio of character language models.

Two Markov models of variable order, of accepted and of rejected URLs, give each URL a likelihood: the
probability of a byte mixes the orders 0 to ORDER by Witten-Bell smoothing, so an order counts only
as far as its context was seen. Their log-likelihood difference, divided by the length, is calibrated
on held-out labelled URLs by a logistic curve; a URL is blocked where rejection is the likelier.

The models are fitted on a bounded sample of labelled URLs (at most SAMPLE distinct ones of each class, those of
the smallest hash), which also bounds what is sent to the tasks; every URL is judged by them.
The models read whole URLs, with scheme, query and fragment. Hosts and rules are column expressions. Null
URLs and such without `://` have empty host and path, fit no rule and, as labels come from hosts, train
no model; the models judge them as they are written, null as an empty string. Equal URLs get equal verdicts. Without labelled URLs of both
classes the method allows all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.llm.flat import slices, text_bytes

ORDER = 5
SAMPLE = 20_000
HELD_OUT = 3  # every third sampled URL calibrates
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Parts of host names that mark a URL as rejected for training.
REJECTED_TERMS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "viagra", "xxx"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Of (verdict, 'host/path') rules: the longest that fits, and its verdict (null without one)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, name in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # later ones win
        domain, start = name.split("/", 1)
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


class Markov:
    """Counts of bytes after contexts of 0 to ORDER bytes."""

    def __init__(self, texts: pa.Array):
        codes = _codes(texts)[0]
        self.levels = []
        for k, code in enumerate(codes):
            pairs, n = np.unique(code, return_counts=True)
            contexts, first = np.unique(pairs >> np.uint64(8), return_index=True)
            types = np.diff(np.append(first, len(pairs)))
            totals = np.add.reduceat(n, first) if len(pairs) else n
            self.levels.append((pairs, n, contexts, totals, types))

    def log10(self, codes: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(codes[0]), 1 / 256)
        for (pairs, n, contexts, totals, types), code in zip(self.levels, codes):
            seen, at = _lookup(contexts, code >> np.uint64(8))
            known, there = _lookup(pairs, code)
            mixed = (np.where(known, n[there], 0) + types[at] * p) / (totals[at] + types[at])
            p = np.where(seen, mixed, p)
        return np.log10(p)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _codes(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order: context and byte as one number, for all bytes and an end mark; lengths."""
    data, offsets = text_bytes(texts)
    n = np.diff(offsets)
    flat = np.zeros(len(data) + len(n) * (ORDER + 1), np.uint64)
    ends = offsets[1:] + (np.arange(len(n)) + 1) * (ORDER + 1)
    place = np.arange(len(data)) + np.repeat(np.arange(len(n)) * (ORDER + 1) + ORDER, n)
    flat[place] = data.astype(np.uint64) + np.uint64(2)  # 0: before the text, 1: its end (of 9 bits)
    flat[ends - 1] = 1
    at = np.sort(np.concatenate([place, ends - 1]))
    codes = [flat[at]]
    for k in range(1, ORDER + 1):
        codes.append(codes[-1] | (flat[at - k] << np.uint64(9 * k)))
    # contexts and bytes are told apart by a shift of 8 bits: fold the ninth bit of the byte away
    byte = codes[0]
    return [((c >> np.uint64(9)) << np.uint64(8)) | (byte & np.uint64(0xFF)) for c in codes], n + 1


class Ratio:
    """Both models and the calibration."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        kept = [[t for i, t in enumerate(ts) if i % HELD_OUT] or ts for ts in (accepted, rejected)]
        held = [[t for i, t in enumerate(ts) if not i % HELD_OUT] for ts in (accepted, rejected)]
        self.good, self.bad = (Markov(pa.array(ts, pa.string())) for ts in kept)
        d = np.concatenate([self.difference(pa.array(ts, pa.string())) for ts in held])
        y = np.repeat([0.0, 1.0], [len(ts) for ts in held])
        self.slope, self.bias = logistic(d, y)

    def difference(self, texts: pa.Array) -> np.ndarray:
        """log10 likelihood of rejection less that of acceptance, for each byte."""
        codes, n = _codes(texts)
        if not len(n):
            return np.zeros(0)
        each = self.bad.log10(codes) - self.good.log10(codes)
        return np.add.reduceat(each, np.cumsum(n) - n) / n

    def blocked(self, texts: pa.Array) -> np.ndarray:
        z = self.slope * self.difference(texts) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias by damped Newton steps; the slope is not negative."""
    scale = float(np.std(x)) or 1.0
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        u = x / scale
        g = np.array([((p - y) * u).sum() + ridge * a, (p - y).sum() + ridge * b])
        h = np.array([[(w * u * u).sum() + ridge, (w * u).sum()], [(w * u).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if float(np.abs(step).max()) < 1e-9 or math.isnan(a):
            break
    return max(a, 0.0) / scale, b


def sample(urls: DataFrame, text: Column, limit: int = SAMPLE) -> list[str]:
    """At most `limit` distinct values, those of the smallest hashes."""
    rows = urls.select(text.alias("t")).filter(F.length("t") > 0).distinct()
    return [r.t for r in rows.orderBy(F.xxhash64("t"), "t").limit(limit).collect()]


def weak_label(host: Column, terms: Sequence[str] = tuple(REJECTED_TERMS)) -> Column:
    """True where a part of the host (between dots and hyphens) is a rejected term."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, terms)))


def fit(urls: DataFrame, text: Column, rejected: Column) -> Ratio | None:
    good, bad = sample(urls.filter(~rejected), text), sample(urls.filter(rejected), text)
    return Ratio(good, bad) if good and bad else None


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", terms: Sequence[str] = tuple(REJECTED_TERMS)) -> DataFrame:
    """The pages with host, path, rule, verdict and p_block (null where a rule decides).

    These names replace columns of the same names.
    """
    host, path = host_and_path(F.col(url))
    rule, by_rule = longest_rule(host, path, rules)
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    model = fit(pages.filter(host != ""), text, weak_label(host, terms))

    @F.arrow_udf("double")
    def rejection(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.blocked(texts.slice(a, b - a)) for a, b in slices(texts)] if model else []
            yield pa.array(np.concatenate(parts) if parts else np.zeros(len(texts)), pa.float64())

    made = {"host": host, "path": path, "rule": rule, "_by_rule": by_rule, "_p": rejection(text)}
    out = pages.withColumns({f"_{k}" if k in pages.columns else k: v for k, v in made.items()})
    name = {k: f"_{k}" if k in pages.columns else k for k in made}
    by_rule, p = F.col(name["_by_rule"]), F.col(name["_p"])
    method = F.when(p >= 0.5, "block").otherwise("allow")
    out = out.withColumns({"verdict": F.coalesce(by_rule, method), "p_block": F.when(by_rule.isNull(), p)})
    for k in ("host", "path", "rule"):
        if name[k] != k:
            out = out.withColumn(k, F.col(name[k])).drop(name[k])
    return out.drop(name["_by_rule"], name["_p"])
