"""Checks whose work is linear in a config, on random graphs and on configs written by machines."""

import random
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendset.functions.graphs import cyclic
from mendset.operators import checks
from mendset.operators.inject import prepare

EDGES = pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string())]))


def plain(edges):
    """Drop edges that lead nowhere, again and again."""
    edges = [e for e in edges or [] if e is not None and e["src"] is not None and e["dst"] is not None]
    while True:
        kept = [e for e in edges if any(f["src"] == e["dst"] for f in edges)]
        if len(kept) == len(edges):
            return bool(kept)
        edges = kept


NODE = st.sampled_from(["a", "b", "c", "d", "e", "é", None])
EDGE = st.none() | st.fixed_dictionaries({"src": NODE, "dst": NODE})


@settings(max_examples=500, deadline=None)
@given(st.lists(st.none() | st.lists(EDGE, max_size=8), max_size=6))
def test_cycles(rows):
    assert cyclic(pa.array(rows, EDGES)).tolist() == [plain(r) for r in rows]


def test_a_long_chain_takes_under_a_second():
    chain = [{"src": f"n{i}", "dst": f"n{i + 1}"} for i in range(10_000)]
    random.Random(1).shuffle(chain)
    rows = pa.array([chain, [*chain, {"src": "n10000", "dst": "n0"}]], EDGES)
    start = time.perf_counter()
    assert cyclic(rows).tolist() == [False, True]
    assert time.perf_counter() - start < 1


def template(n):
    kinds = ["AWS::S3::Bucket", "AWS::EC2::Subnet", "AWS::RDS::DBInstance", "My::Own::Type"]
    out = ["Resources:"]
    for i in range(n):
        out += [f"  R{i}:", f"    Type: {kinds[i % 4]}", "    Properties:", f"      Name{i % 9}: !Ref R{i // 2}", "      Count: 3"]
        if i % 8 == 0:
            out.append("      BucketEncryption: {On: true}")
        if i % 8 == 1:
            out += ["      VpcId: {Ref: Net}", "      CidrBlock: 10.0.0.0/8"]
    return "\n".join(out) + "\n"


def test_large_templates_are_checked_in_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, template(n))], "doc_id bigint, text string")
        nodes = prepare(df, "template").select("nodes").persist()
        rule = F.concat(checks.required_properties(F.col("nodes")), checks.template_encryption(F.col("nodes")))
        best, found = 99.0, None
        for _ in range(3):
            start = time.perf_counter()
            found = nodes.select(rule.alias("f")).first().f
            best = min(best, time.perf_counter() - start)
        return best, found

    small, large = seconds(600), seconds(5000)
    assert large[0] < 2 + 12 * small[0]
    said = [f.message for f in large[1]]
    assert sum(m.startswith("No encryption") for m in said) == 5000 // 8 + 5000 // 4
    assert said.count("Missing property VpcId in R5") == 1 and "Missing property VpcId in R9" not in said


def test_owners_and_calls(spark):
    text = "Resources:\n  A:\n    Type: T\n    Properties:\n      X: {Ref: B}\n      Y: {Z: 1}\nOutputs:\n  A: {Type: U}\n"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    nodes = {".".join(n.path): (n.owner_type, n.called) for n in prepare(df, "template").first().nodes}
    assert nodes["Resources.A.Properties.X"] == ("T", True) and nodes["Resources.A.Properties.Y"] == ("T", False)
    assert nodes["Outputs.A"] == (None, False) and nodes["Resources.A.Type"] == ("T", False)


def test_cycles_of_texts(spark):
    block = 'resource "t" "{}" {{\n  depends_on = [{}]\n}}\n'
    round_ = block.format("a", "t.b, t.c") + block.format("b", "t.d") + block.format("c", "") + block.format("d", "t.a")
    texts = [round_, round_.replace("t.a]", "t.é]"), block.format("x", "t.x"), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = df.select("doc_id", F.size(checks.cycle(F.col("text"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0}
    yaml = "Resources:\n  A:\n    DependsOn: [B, C]\n  B:\n    DependsOn: {}\n  C: {{Type: T}}\n"
    texts = [yaml.format("A"), yaml.format("C"), yaml.format("{Ref: A}"), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = prepare(df, "template").select("doc_id", F.size(checks.template_cycle(F.col("nodes"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}
