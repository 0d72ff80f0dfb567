import time

import pyarrow as pa
from pyspark.sql import functions as F

from mendset.operators import checks
from mendset.operators import structure_template as st
from mendset.operators.inject import edits_of


def test_a_line_is_drawn_in_time_linear_in_the_lines(spark):
    # the offsets of all lines used to be kept by copying the list for each line
    head = "Resources:\n  A:\n    Type: B\nBig: |\n"
    text = head + "".join(f"  k{i}: v\n" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "a: b\n\nc: d"), (3, "# a: b\nc\n"), (4, "")], "doc_id long, text string")
    edits_of(df.filter("doc_id > 1"), "template", ["SYNTACTIC.invalid_yaml"]).collect()
    began = time.time()
    rows = {r.doc_id: r for r in edits_of(df, "template", ["SYNTACTIC.invalid_yaml"]).collect()}
    assert time.time() - began < 30
    assert set(rows) == {1, 2}
    for r, whole in ((rows[1], text), (rows[2], "a: b\n\nc: d")):
        lines, broken = whole.split("\n"), r.broken.split("\n")
        at = int(r.location.removeprefix("line ")) - 1
        assert [i for i, (a, b) in enumerate(zip(lines, broken, strict=True)) if a != b] == [at]
        assert broken[at] == "\t" + lines[at].lstrip(" ") and r.parts[0].start == sum(len(x) + 1 for x in lines[:at])


def test_braces_are_counted_outside_quotes_and_comments(spark):
    good = ['a { b = "}" }', "a { # }\n}", 'a { b = "\\"}" }', "", '{ "${x}" }', 'a { b = "\\\\" }']
    bad = ["a {", 'a { b = "{}}" # }', 'a { "}', "}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad])], "doc_id int, text string")
    found = df.select("doc_id", F.size(checks.braces(F.col("text"))).alias("n"))
    assert [r.n for r in found.orderBy("doc_id").collect()] == [0] * len(good) + [1] * len(bad)
    # one scan removes what is hidden; no list of tokens is made and walked
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_references_that_are_no_types_are_not_declared(spark):
    text = "aws_a.b.c aws_a.b.d var_x.y.z 10.0.0 local.a.b _aws_c.d.e 1aws_f.g.h aws_k.l.m.n Aws_o.p.q data.aws_r.s"
    df = spark.createDataFrame([(text,), (None,)], "text string").withColumn("b", F.array(F.struct(F.lit("aws_k").alias("type"), F.lit("l").alias("name"))))
    got = df.select(checks.undeclared_resource(F.col("text"), F.col("b")).alias("f")).collect()
    assert [f.message for f in got[0].f] == ["Undeclared resource aws_a.b"] and not got[1].f


def test_lists_from_flat_arrays():
    pair = pa.struct([("a", pa.string()), ("b", pa.int32())])
    for values, kind in (([["x", None], [], ["y"]], pa.string()), ([[], []], pa.string()), ([], pair), ([[("x", 1)], [], [(None, 2), ("z", None)]], pair)):
        as_rows = [[dict(zip("ab", v)) if kind is pair else v for v in row] for row in values]
        got = st._lists(values, kind)
        got.validate(full=True)
        assert got.type == pa.list_(kind) and got.to_pylist() == as_rows
