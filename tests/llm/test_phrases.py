import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mendset.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, lang string, text string, phrase string, n long"


def grams(rows):
    found, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    found[lang][tuple(w[i : i + k])] += 1
    return found, n


def plain(rows, least, top=2000, inside=80):
    out = []
    found, n = grams(rows)
    for lang, f in found.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], a)
        ranked = []
        for p, a in often.items():
            if 100 * cover.get(p, 0) < inside * a:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def mined(spark, rows, least, **more):
    df = spark.createDataFrame([(i, lang, text, "clash", i) for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, least, **more).collect())


def corpus(seed, n, words=40):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "ÉTÉ", "a-b", "　x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    gaps = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "!?", "\r\n", "\x0b"]
    texts = ["".join(w + draw.choice(gaps) for w in draw.choices(vocabulary, weights, k=draw.randrange(words))) for _ in range(n)]
    return [(draw.choice(["en", "de", None, "und"]), t) for t in texts]


def test_equals_counting(spark):
    rows = corpus(1, 400)
    got = mined(spark, rows, 5)
    assert got == plain(rows, 5) and len(got) > 100
    assert mined(spark, rows, 5, top=7, inside=50) == plain(rows, 5, 7, 50)


def test_odd_texts(spark):
    long = "ring a ring of roses " * 9000
    rows = [("en", None), (None, ""), ("en", " \t "), ("de", ".,;"), ("en", long), ("en", "x " * 70_000), ("fr", "one"), ("fr", "un deux, trois")] + [("es", "Se acabó el pan. Sí")] * 40
    got = mined(spark, rows, 30)
    assert got == plain(rows, 30)
    assert ("es", "acabó el pan") not in [(r[0], r[2]) for r in got] and ("es", "se acabó el pan") in [(r[0], r[2]) for r in got]


def test_no_rows(spark):
    assert mined(spark, [], 2) == []
    assert mined(spark, [("en", "a b c")], 2) == []


def test_small_filters_change_nothing(spark, monkeypatch):
    rows = corpus(2, 200)
    monkeypatch.setattr(phrases, "FILTER", 64)  # lets nearly everything through
    monkeypatch.setattr(phrases, "BUCKET", 64)
    assert mined(spark, rows, 4) == plain(rows, 4)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab .\n\tcdé", max_size=200), max_size=6))
def test_each_phrase_belongs_to_one_chunk(texts):
    batch = phrases.parsed(pa.array([t + "\n" for t in texts], pa.string()), pa.array(["x"] * len(texts), pa.string()))
    found = Counter()
    for skip, chunk, n in zip(batch["skip"].to_pylist(), batch["chunk"].to_pylist(), batch["n"].to_pylist()):
        assert chunk.endswith("\n")
        pieces = [p.split(" ") for p in chunk[:-1].split("\n")]
        at = 0
        for w in pieces:
            for i in range(len(w)):
                for k in range(1, min(4, i + 1) + 1):
                    if at + i >= skip:
                        found[tuple(w[i - k + 1 : i + 1])] += n
            at += len(w)
    assert found == grams([("x", t) for t in texts])[0]["x"]


def test_chunks_follow_content():
    draw = random.Random(4)
    same = " ".join(f"w{draw.randrange(900)}" for _ in range(3000))
    chunks = lambda t: set(phrases.parsed(pa.array([t + "\n"]), pa.array(["x"]))["chunk"].to_pylist())
    one, two = chunks(same), chunks("another start " + same)
    assert len(one & two) >= len(one) - 2
    assert np.mean([len(c.split()) for c in one]) < 3 * phrases.EVERY
