import numpy as np
from test_lsh_forest import plain as plain_classes
from test_pieces import LIBRARY
from test_quality import plain_em, plain_measures

import corpus_pipeline
from mendset.llm import decontaminate, quality
from mendset.llm.pseudonyms import pseudonymise
from mendset.llm.queries import DEMO_KEY


def plain_votes(spark, rows):
    df = spark.createDataFrame([(i, *plain_measures(t).values()) for i, (_, t) in enumerate(rows)], ["i", *plain_measures("").keys()])
    return [r.votes for r in quality.voted(df).orderBy("i").collect()]


def brute_force(spark, rows, items):
    failed = [m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] for m in (plain_measures(t) for _, t in rows)]
    p = plain_em(plain_votes(spark, rows))
    good = [r for r, f, x in zip(rows, failed, p) if not f and x >= 0.5]
    tops = {c for _, c, _ in plain_classes(good)}
    single = [r for r in good if r[0] in tops]
    clean = [(d, t) for d, t in single if not any(decontaminate.plain(i) in decontaminate.plain(t) for i in items)]
    return {d: pseudonymise(t, DEMO_KEY)[0] for d, t in clean}


def test_run_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = brute_force(spark, rows, items)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == expected and len(got) == len(expected) < len(rows)
    for r in got:
        ids = [1, *LIBRARY.encode(r.text), 2]
        assert np.frombuffer(r.piece_ids, "<u4").tolist() == ids and r.decoded == LIBRARY.decode(ids)


def test_odd_tables(spark, sf):
    good = "Here is a sentence of plain words that nobody else has written. It goes on a little. "
    rows = [(1, None, "k"), (2, "", None), (3, good * 1 + "One more end.", "k"), (3, good * 1 + "One more end.", "k"), (None, good + "This one has no id.", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string").selectExpr("*", "'x' AS _windows", "1 AS n_words", "'y' AS class_id", "0 AS votes")
    for table in (docs, docs.filter("false")):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
            assert out.columns[: len(docs.columns)] == docs.columns, name
        left = sorted(map(str, (r.doc_id for r in out.collect())))
        assert left == (["3", "None"] if table is docs else [])
