import re

import pytest
from pyspark.sql import functions as F

from mendset.llm import licenses
from mendset.llm.queries import QUERIES

DECLARED = {  # none of these is a template
    "This project is Licensed under the Apache License, Version 2.0, by its authors.": "apache",
    "The code was released under the MIT License in 2019.": "mit",
    "This document is licensed under the GNU General Public License, version 3 or later.": "gpl",
    "You can redistribute this program and/or modify it under the terms of the GNU General Public License as published by the FSF": "gpl",
    "Text licensed under CC BY-NC 4.0 unless noted.": "cc-by-nc",
    "The data set is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
}
BARE = {  # named without any of the words license, copyright or permission
    "Distributed under LGPL v2.1 or later": "lgpl",
    "Released under CC0 1.0": "cc0",
    "Available under CC BY-SA 4.0": "cc-by-sa",
    "Distributed under the 3-clause BSD terms": "bsd",
    "to deal in the Software without restriction, including without limitation": "mit",
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell": "mit",
}
PLAIN = ["The pilot's license was revoked after the warranty expired.", "Copyright disputes are settled with permission of the court.", "An apache wind blew over the hills."]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [f"First line.\n{s}\nlast line" for s in [*DECLARED, *PLAIN]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_held_out_paragraphs(scanned):
    for i, family in enumerate(DECLARED.values()):
        assert (scanned[i].family, scanned[i].confirmed, scanned[i].line) == (family, True, 1)
    for i in range(len(DECLARED), len(DECLARED) + len(PLAIN)):
        assert not scanned[i].confirmed


def test_names_without_the_word_license(spark):
    docs = spark.createDataFrame(list(enumerate(BARE)), "doc_id int, text string")
    got = {r.doc_id: r.family for r in licenses.scan(docs).filter("confirmed").collect()}
    assert got == dict(enumerate(BARE.values()))


def test_query_finds_every_declared_line(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op6_license_scan"](spark, sf).collect()
    got = {(r.doc_id, r.line, r.license) for r in rows if r.confirmed}
    lines = {"MIT": r"Released under the MIT License\.", "Apache-2.0": r"Licensed under the Apache License, Version 2\.0\.",
             "GPL-3.0": r"This work is licensed under the GNU General Public License, version 3\.", "CC-BY-NC-4.0": r"Licensed under CC BY-NC 4\.0\."}
    expected = set()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for n, line in enumerate((d.text or "").split("\n")):
            expected |= {(d.doc_id, n, k) for k, p in lines.items() if re.search(p, line)}
    assert expected and got == expected


def test_nulls_repeats_and_empty(spark):
    text = "Released under the MIT License."
    rows = [(1, None, "x"), (2, "", "x"), (3, text, "x"), (3, text, "x"), (None, "x\n" + text + "\n" + text, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, family string")
    got = [(r.doc_id, r.line) for r in licenses.scan(docs).filter("confirmed").collect()]
    assert sorted(got, key=str) == [(3, 0), (3, 0), (None, 1), (None, 2)]
    assert licenses.scan(docs.filter("false")).count() == 0


def test_long_line(spark):
    docs = spark.createDataFrame([(1, "plain words " * 20_000 + "copyright\nLicensed under CC BY 4.0.")], "doc_id int, text string")
    assert [(r.line, r.license) for r in licenses.scan(docs).filter("confirmed").collect()] == [(1, "CC-BY-4.0")]


def test_scan_stays_in_the_jvm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("x", F.lit(1))
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


UNGATED = {  # no word of the gate
    "Use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
    "modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "isc",
    "to use, copy, modify, merge, publish, distribute, and/or sell copies of the Software": "mit",
}


def test_paragraphs_without_a_word_of_the_gate_are_scored(spark):
    docs = spark.createDataFrame([(i, f"Other words.\n{s}") for i, s in enumerate(UNGATED)], "doc_id int, text string")
    assert docs.filter(F.col("text").rlike(licenses.GATE)).count() == 0
    got = {(r.doc_id, r.line): r.family for r in licenses.scan(docs, unknown=False).filter("confirmed").collect()}
    assert got == {(i, 1): f for i, f in enumerate(UNGATED.values())}
