"""Quality rules under weak supervision: rules vote or abstain, EM finds how far each can be trusted.

Column expressions measure every whole text; rules turn the measures into votes (keep, reject) or
abstain. The latent quality of a document is good, or bad in one of several kinds (KINDS): what is all
symbols is not also shouted, and were both one class, its rules would seem to contradict each other.
Each rule has its rates of the three votes on good documents and on each kind of bad ones, so an
abstention tells something too, and a rule that only ever rejects is weighed by how often it does so
where. Expectation-maximisation estimates the rates and shares from all documents, by way of the counts
of vote patterns: Spark counts them, and the driver iterates over the counts, of which nine rules leave
at most 3 ** 9, whatever the corpus holds. Nothing bounds the estimates but the STRENGTH documents that
the beginning counts for, and rounds end when the likelihood does not grow any more. A document is kept
where the posterior probability of good quality is at least a half and no base rule fails.

Words are runs of characters other than 0x20 and 0x09-0x0D. Null texts count as empty: no words, so
the base rule fails. Repeated rows are judged alike, each counting as a document. An empty table
keeps the prior. Measures and verdict replace columns of the same names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.llm.tables import stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
PRIOR = 0.8  # where EM begins: the share of good documents
BEGIN_GOOD, BEGIN_BAD = (0.6, 0.03), (0.15, 0.7)  # and how often a rule votes keep and reject
STRENGTH = 10.0  # documents that the beginning counts for in each estimate
TOLERANCE = 1e-9  # gain of log-likelihood a document below which EM ends

#: Kinds of bad documents, and the rules whose rejections tell each from good documents at the beginning.
KINDS = {
    "shape": ("length", "word_size"),
    "symbols": ("symbols", "marked_words"),
    "repetition": ("lines", "repeats"),
    "shouting": ("capitals", "marks"),
    "prose": ("sentences",),
}
ONE_SIDED = {"length", "word_size", "lines", "marks"}  # rules that never vote keep

#: Measures that the query returns, and further ones that only rules use.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_marks", "n_stops", "n_marked"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _covered(windows: Column) -> Column:
    """Words in windows (hash, place), sorted, that occur twice or more."""
    same = lambda a, b: F.get(windows, a)["hash"] == F.get(windows, b)["hash"]
    repeated = F.filter(
        windows,
        lambda w, i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
    )
    places = F.sort_array(F.transform(repeated, lambda w: w["place"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda acc, p: F.struct(
        (p + WINDOW).alias("end"), (acc["total"] + p + WINDOW - F.greatest(acc["end"], p)).alias("total")
    )
    return F.aggregate(places, start, step, lambda acc: acc["total"])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with BASE and MORE as bigint columns; everything stays in the JVM."""
    kept = [c for c in docs.columns if c not in (*BASE, *MORE)]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    lines = F.split(t, "\n", -1)
    full = F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    first = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+", -1)).otherwise(F.array().cast("array<string>")).alias("_words"),
        full.alias("_lines"),
        _without(t, BLANKS).alias("word_chars"),
        (F.length(t) - _without(t, "#*$%&|<>")).alias("n_symbols"),
        (F.length(t) - _without(t, UPPER)).alias("n_upper"),
        (F.length(t) - _without(t, "!?")).alias("n_marks"),
        (F.length(t) - _without(t, ".")).alias("n_stops"),
        F.regexp_count(t, F.lit("[#*$%&|<>][^ \\t-\\r]*")).alias("n_marked"),
    )
    names = [*kept, "word_chars", "n_symbols", "n_upper", "n_marks", "n_stops", "n_marked"]
    keep = [F.col(f"`{c}`") for c in names]
    words, n = F.col("_words"), F.size("_words")
    # `_words` is used several times in one projection, so the optimiser keeps its own projection
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.select(
        *keep,
        n.alias("n_words"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        hashes.alias("_hashes"),
    )
    keep += [F.col(c) for c in ("n_words", "n_lines", "n_dup_lines")]
    h = F.col("_hashes")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    placed = F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("place")))
    third = second.select(*keep, F.when(twice, F.array_sort(placed)).alias("_windows"))
    fourth = third.select(*keep, F.coalesce(_covered(F.col("_windows")), F.lit(0)).alias("n_repeat_words"))
    return fourth.select(*[F.col(f"`{c}`") for c in kept], *[F.col(c).cast("bigint") for c in (*BASE, *MORE)])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule: when it votes reject, and when it votes keep; else it abstains."""
    n = F.col("n_words")
    chars, symbols, upper = F.col("word_chars"), F.col("n_symbols"), F.col("n_upper")
    lines, copies, repeats = F.col("n_lines"), F.col("n_dup_lines"), F.col("n_repeat_words")
    marks, stops, marked = F.col("n_marks"), F.col("n_stops"), F.col("n_marked")
    never = F.lit(False)
    return {
        "length": (n < 10, never),
        "word_size": ((chars < 2 * n) | (chars > 14 * n), never),
        "symbols": (10 * symbols > n, 100 * symbols <= n),
        "marked_words": (10 * marked > n, 50 * marked <= n),
        "lines": (3 * copies > lines, never),
        "repeats": (5 * repeats > n, repeats == 0),
        "capitals": (4 * upper > chars, 10 * upper <= chars),
        "marks": (5 * marks > n, never),
        "sentences": ((n >= 40) & (100 * stops < n), (stops >= 2) & (40 * stops >= n) & (2 * stops <= n)),
    }


def voted(measures: DataFrame) -> DataFrame:
    """With `votes`: a digit for each rule, 0 abstain, 1 keep, 2 reject."""
    digits = [F.when(reject, "2").when(keep, "1").otherwise("0") for reject, keep in rules().values()]
    return measures.withColumn("votes", F.concat(*digits))


class Trust:
    """Shares of the classes, good documents first, and the rates of votes: class x rule x vote."""

    def __init__(self, shares: np.ndarray, rates: np.ndarray):
        self.shares, self.rates = shares, rates
        # a rate of nothing belongs to a vote that is never cast
        self.log_shares, self.log_rates = np.log(shares), np.log(np.where(rates > 0, rates, 1))

    @property
    def share(self) -> float:
        """The share of good documents."""
        return float(self.shares[0])

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """Log probability of each row of votes together with each class."""
        return self.log_rates[:, np.arange(votes.shape[1]), votes].sum(2).T + self.log_shares

    def p_good(self, votes: Column) -> Column:
        """Posterior probability of good quality given the votes."""
        bad = F.lit(0.0)
        for k in range(1, len(self.shares)):
            odds = F.lit(float(self.log_shares[k] - self.log_shares[0]))
            for j, against in enumerate((self.log_rates[k] - self.log_rates[0]).tolist()):
                digit = F.substring(votes, j + 1, 1)
                odds = odds + F.when(digit == "0", against[0]).when(digit == "1", against[1]).otherwise(against[2])
            bad = bad + F.exp(odds)
        return 1 / (1 + bad)


def begin() -> Trust:
    """Where EM begins: a kind of bad documents differs from good ones in the votes of its own rules."""
    names = list(rules())

    def row(name: str, rates: tuple[float, float]) -> list[float]:
        keep, reject = (0.0 if name in ONE_SIDED else rates[0]), rates[1]
        return [1 - keep - reject, keep, reject]

    classes = [(), *KINDS.values()]
    rates = [[row(name, BEGIN_BAD if name in own else BEGIN_GOOD) for name in names] for own in classes]
    return Trust(np.array([PRIOR] + [(1 - PRIOR) / len(KINDS)] * len(KINDS)), np.array(rates))


def estimated(votes: np.ndarray, counts: np.ndarray, tolerance: float = TOLERANCE) -> Trust:
    """EM over rows of votes and their counts, until a round gains less than `tolerance` of
    log-likelihood a document. The beginning counts as STRENGTH documents of each class."""
    start = trust = begin()
    cast = np.eye(3)[votes]  # pattern x rule x vote
    last = -np.inf
    while True:
        joint = trust.joint(votes)
        whole = np.logaddexp.reduce(joint, axis=1)
        begun = (start.shares * trust.log_shares).sum() + (start.rates * trust.log_rates).sum()
        now = counts @ whole + STRENGTH * begun
        if now - last < tolerance * (counts.sum() + STRENGTH):
            return trust
        last = now
        weight = np.exp(joint - whole[:, None]) * counts[:, None]
        shares = weight.sum(0) + STRENGTH * start.shares
        rates = np.einsum("pk,pjv->kjv", weight, cast) + STRENGTH * start.rates
        trust = Trust(shares / shares.sum(), rates / rates.sum(2, keepdims=True))


def estimate(patterns: DataFrame) -> Trust:
    """EM over the pattern counts (votes, n), at most 3 ** len(rules()) rows."""
    rows = sorted((r.votes, r.n) for r in patterns.collect())
    votes = np.array([[int(v) for v in r[0]] for r in rows], np.int64).reshape(len(rows), len(rules()))
    return estimated(votes, np.array([r[1] for r in rows], np.float64))


def patterns(votes: DataFrame) -> DataFrame:
    return votes.groupBy("votes").agg(F.count("*").alias("n"))


def judged(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with their measures, `base_failed`, `p_good` and `kept`.

    The measured documents are written once; the patterns and the verdicts read that table.
    """
    names = [*BASE, *MORE, "votes", "base_failed", "p_good", "kept"]
    own = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    table = stored(voted(measured(docs, text)).select(*[F.col(f"`{c}`") for c in own], *BASE, *MORE, "votes"))
    trust = estimate(patterns(table))
    scored = table.withColumns({"base_failed": base_failed(), "p_good": trust.p_good(F.col("votes"))})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document")
    judged_ = judged(docs.select(whole, F.col(text).alias("_text")), "_text", keep_text=False)
    return judged_.filter("kept").select("_document.*")
