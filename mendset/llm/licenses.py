"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a text. All paragraphs become sets of hashed word 1- to 3-grams; multinomial logistic regression gives each license family and the
class `unknown` a probability. The temperature and the least probability of a known family are
calibrated on held-out labelled paragraphs. A predicted family is confirmed by its templates: the best
one must share CONFIRMED of the word pairs of the shorter side; it names the license.

The scan of the documents is made of column expressions, with the weights as literals of a bounded size, and
a join with one row for each template. A paragraph is scored in its own row. Before that, one number for each
feature (by how much it can favour any family over `unknown` at most) tells most paragraphs that cannot
belong to a family: exactly those that this bound settles are unknown without further scores.
Training reads the templates, fragments of them, and at most NEGATIVES paragraphs of the corpus (those
of the smallest hash among gated ones, and as many among the rest) that no template resembles.

Null and empty texts have no paragraphs. Every row is scanned by itself: repeated rows give repeated
results. An empty table gives none (the classifier then learns from the fixed sentences alone).
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendset.llm.tables import stored

# names of licenses as they are written; in other cases some are plain words ("mit" is German)
GATE = (
    r"(?i)licen[cs]|copyright|permission|warrant|redistribut|\bgnu\b|apache|creative commons|public domain|copyleft|rights reserved"
    r"|\b[al]?gpl|mozilla|unencumbered|\bbsd\b|\bmpl\b|\bcc[ -]by\b|\bcc0\b|(?-i:\bMIT\b|\bISC\b)"
    r"|obtaining a copy|deal in the software|without restriction|without limitation"
)
BUCKETS = 4096
NEGATIVES = 500
EPOCHS, RATE, RIDGE = 120, 0.5, 1e-4
LEAST, CONFIRMED = 0.5, 0.6
UNKNOWN = "unknown"

# Notices by which licenses are usually declared, with family and license.
TEMPLATES = [
    ("apache", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "MIT", "Released under the MIT License."),
    ("mit", "MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("mit", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "GPL-3.0", "Licensed under GPL v3 or later."),
    ("gpl", "GPL-2.0", "Licensed under GPL v2 or later."),
    ("gpl", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1."),
    ("lgpl", "LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "LGPL-2.1", "Licensed under LGPL v2.1 or later."),
    ("lgpl", "LGPL-3.0", "Licensed under LGPL v3 or later."),
    ("agpl", "AGPL-3.0", "Licensed under AGPL v3 or later."),
    ("agpl", "AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("mpl", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-by", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0 Universal."),
    ("cc0", "CC0-1.0", "Licensed under CC0 1.0."),
    ("cc0", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "ISC", "Licensed under the ISC License."),
]

# Sentences with words of licenses that declare none.
OTHERS = [
    "He lost his driving license and has to apply for a new one.",
    "The restaurant was granted a liquor licence by the city council.",
    "Copyright law protects original works of authorship.",
    "All rights reserved.",
    "Copyright 2019 Example Corporation. All rights reserved.",
    "The warranty covers repairs for two years after the purchase.",
    "She asked for permission to leave early.",
    "No part of this book may be reproduced without the permission of the publisher.",
    "Apache helicopters were seen over the valley.",
    "The gnu grazed next to the zebras.",
    "Much of the redistribution of income happens through taxes.",
    "A public domain painting may be copied by anyone.",
    "This version of the software requires a commercial license key.",
    "The license terms are between you and the seller.",
    "Licensed practitioners must renew under section 4.",
    "A general license version was discussed in the meeting.",
]
FAMILIES = sorted({t[0] for t in TEMPLATES})
CLASSES = [UNKNOWN, *FAMILIES]


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; points between digits stay in their word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def grams(words: Column, n: int) -> Column:
    """Distinct runs of n words; of fewer words none."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    made = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>")))


def features(words: Column) -> Column:
    every = F.concat(words, *[grams(words, n) for n in (2, 3)])
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, line (from 0), paragraph."""
    t = F.col(text).cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.posexplode(F.split(t, "\n", -1)).alias("line", "paragraph"))


def template_rows(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TEMPLATES, "family string, license string, template string")
    return rows.select("family", "license", grams(words_of(F.col("template")), 2).alias("pairs"))


def _smallest(hashed: DataFrame, test: Column) -> DataFrame:
    """The NEGATIVES rows of the smallest hash among those that pass the test. It is asked of the smallest
    hashes first, and of more of them until enough rows pass."""
    for share in (256, 16, 1):
        part = hashed.filter(F.col("h") < -(1 << 63) + (1 << 64) // share) if share > 1 else hashed
        few = stored(part.filter(test).orderBy("h", "paragraph").limit(NEGATIVES))
        if share == 1 or few.count() == NEGATIVES:
            return few


def _labelled(spark: SparkSession, docs: DataFrame, doc_id: str, text: str) -> tuple[list[list[int]], list[int]]:
    """Features and classes of the training paragraphs (all bounded in number)."""
    examples = []
    for family, _, template in TEMPLATES:
        parts = template.split()
        n = len(parts)
        spans = {(0, n), (0, -(-2 * n // 3)), (n // 3, n), (0, n - 1), (1, n)} if n > 6 else {(0, n)}
        for a, b in sorted(spans):
            piece = parts[a:b]
            examples += [(family, " ".join(piece)), (family, "Notice: " + " ".join(piece) + " Thank you.")]
            # with every k-th word missing
            examples += [(family, " ".join(w for i, w in enumerate(piece) if i % k != k - 1)) for k in (5, 7) if n > 9]
    examples += [(UNKNOWN, s) for s in OTHERS for _ in range(3)]
    known = spark.createDataFrame(examples, "family string, paragraph string")
    parts = []
    lines = paragraphs(docs, doc_id, text).select("paragraph").filter(F.length("paragraph").between(20, 2000))
    hashed = lines.withColumn("h", F.xxhash64("paragraph"))
    for gated in (True, False):
        few = _smallest(hashed, F.col("paragraph").rlike(GATE) if gated else F.lit(True))
        parts.append(few.select(F.lit(UNKNOWN).alias("family"), "paragraph", F.lit(True).alias("drawn")))
    rows = known.withColumn("drawn", F.lit(False)).unionByName(parts[0]).unionByName(parts[1])
    worded = stored(rows.withColumn("_words", words_of(F.col("paragraph"))))
    made = worded.select("family", "paragraph", "drawn", grams(F.col("_words"), 2).alias("pairs"), features(F.col("_words")).alias("f")).collect()
    known_pairs = {pair for _, _, template in TEMPLATES for pair in _pairs(template)}
    rows = [r for r in made if not r.drawn or 5 * len(known_pairs.intersection(r.pairs)) < len(r.pairs)]
    rows.sort(key=lambda r: (r.family, r.paragraph))
    return [r.f for r in rows], [CLASSES.index(r.family) for r in rows]


def _pairs(template: str) -> list[str]:
    words = re.findall(r"[^\W_]+(?:\.[0-9]+)*", template.lower())
    return sorted({" ".join(p) for p in zip(words, words[1:])})


def train(examples: list[list[int]], labels: list[int]) -> tuple[np.ndarray, float, float]:
    """Weights (BUCKETS + 1 rows, the last for the bias; a column for each class), temperature and the
    least probability of a known family. Adagrad on all examples; every fourth calibrates."""
    x = np.zeros((len(examples), BUCKETS + 1), np.float32)
    for i, f in enumerate(examples):
        x[i, f] = 1 / math.sqrt(max(1, len(f)))
        x[i, BUCKETS] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[labels]
    held = np.arange(len(x)) % 4 == 3
    weight = (1 / np.maximum(y.sum(0), 1))[labels][:, None].astype(np.float32)  # classes count alike

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def descend(rows: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(x[rows].any(0))
        xs, w = x[rows][:, used], np.zeros((len(used), len(CLASSES)), np.float32)
        square = np.full_like(w, 1e-6)
        for _ in range(EPOCHS):
            g = xs.T @ ((softmax(xs @ w) - y[rows]) * weight[rows]) + RIDGE * w
            square += g * g
            w -= RATE * g / np.sqrt(square)
        out = np.zeros((BUCKETS + 1, len(CLASSES)), np.float32)
        out[used] = w
        return out

    z = x[held] @ descend(~held)
    loss = lambda t: -np.log(np.maximum((softmax(z / t) * y[held]).sum(1), 1e-12)).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    p = softmax(z / temperature)
    wrong = p[y[held][:, 0] == 1][:, 1:].max(1, initial=0)
    least = float(np.clip(np.quantile(wrong, 0.99) if len(wrong) else LEAST, LEAST, 0.9))
    return descend(np.ones(len(x), bool)), temperature, least


def _once(value: Column) -> Column:
    """A value that later steps read as a column, so that it is worked out a single time."""
    return F.explode(F.array(value))


def _literal(values: np.ndarray) -> Column:
    """The numbers as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(values.tolist())), "array<" * values.ndim + "double" + ">" * values.ndim)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unknown: bool = True) -> DataFrame:
    """doc_id, line, paragraph, family (or unknown), license, probability, similarity, confirmed of every
    paragraph that a family is found for, and with `unknown` also of the others that hold a word of GATE."""
    spark = docs.sparkSession
    weights, temperature, least = train(*_labelled(spark, docs, doc_id, text))
    weights = weights.astype(np.float64)
    bias = weights[BUCKETS]
    # no family's z can pass that of unknown by more than the sum of these over sqrt(n), and the gap of the bias
    most = _literal((weights[:BUCKETS, 1:] - weights[:BUCKETS, :1]).max(1))
    gap = float((bias[1:] - bias[0]).max())
    table, zeros = _literal(weights[:BUCKETS]), _literal(np.zeros(len(CLASSES)))
    root = F.sqrt(F.greatest(F.lit(1), F.size("f")))
    reach = F.aggregate("f", F.lit(0.0), lambda a, i: a + F.get(most, i)) / root + gap
    possible = reach >= -1e-6  # sums of doubles
    worded = paragraphs(docs, doc_id, text).select("*", _once(words_of(F.col("paragraph"))).alias("_words"))
    featured = worded.select("*", _once(features(F.col("_words"))).alias("f"))
    judged = featured.filter(possible | F.col("paragraph").rlike(GATE) if unknown else possible)
    sums = F.aggregate("f", zeros, lambda a, i: F.zip_with(a, F.get(table, i), lambda x, y: x + y))
    summed = judged.select("row", "doc_id", "line", "paragraph", "_words", root.alias("root"), _once(sums).alias("w"))
    shift = _literal(bias)
    z = summed.select("*", _once(F.zip_with("w", shift, lambda w, b: (w / F.col("root") + b) / temperature)).alias("z"))
    e = z.select("*", _once(F.transform("z", lambda v: F.exp(v - F.array_max("z")))).alias("e"))
    scored = e.select("*", _once(F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, x: a + x))).alias("p"))
    known = F.slice("p", 2, len(FAMILIES))
    best = F.array_max(known)
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position(known, best).cast("int"))
    sure = best >= F.greatest(F.lit(least), F.get("p", F.lit(0)))
    guess = _once(F.struct(F.when(sure, family).otherwise(UNKNOWN).alias("family"), F.when(sure, best).otherwise(F.get("p", F.lit(0))).alias("probability")))
    guessed = scored.select("row", "doc_id", "line", "paragraph", "_words", guess.alias("guess"))
    wanted = guessed if unknown else guessed.filter(F.col("guess.family") != UNKNOWN)
    joined = stored(wanted.select("row", "doc_id", "line", "paragraph", grams(F.col("_words"), 2).alias("pairs"), "guess.*"))
    templates = stored(template_rows(spark).coalesce(1)).withColumnRenamed("pairs", "template")
    alike = F.size(F.array_intersect("pairs", "template")) / F.greatest(F.lit(1), F.least(F.size("pairs"), F.size("template")))
    met = joined.join(F.broadcast(templates), "family", "left").withColumn("similarity", F.coalesce(alike, F.lit(0.0)))
    # of equally alike templates the one nearest in length
    gap = -F.abs(F.size("pairs") - F.size("template"))
    chosen = met.groupBy("row", "doc_id", "line", "paragraph", "family", "probability").agg(
        F.max(F.struct("similarity", gap.alias("gap"), "license")).alias("best")
    )
    similarity = F.col("best.similarity")
    return chosen.select("doc_id", "line", "paragraph", "family", F.col("best.license").alias("license"), "probability", similarity.alias("similarity"), ((similarity >= CONFIRMED) & (F.col("family") != UNKNOWN)).alias("confirmed"))
