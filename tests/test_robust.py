"""Inputs that no rendering of a table contains: none may abort a job, all have a defined result."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendset.functions import braces
from mendset.operators import checks
from mendset.operators.inject import HCL_FAULTS, TEMPLATE_FAULTS, edits_of, prepare
from mendset.operators.structure_hcl import block_spans, resource_spans
from mendset.sources import corpus


def resource(body, name="a"):
    return f'resource "aws_instance" "{name}" {{\n{body}\n}}\n'


def test_deep_nesting_and_private_use_characters(spark):
    deep = resource("x = " + "{" * 10_000 + "}" * 10_000)
    private = resource('  name = "\ue000\uf8ff"\n  \ue001 {\n  }', "b")
    text = deep + private + resource("  open = {", "c")
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    rows = df.select(resource_spans(F.col("text")).alias("r"), block_spans(F.col("text"), "module").alias("m")).collect()
    assert [(b.name, b.start, b.end) for b in rows[0].r] == [("a", 0, len(deep) - 1), ("b", len(deep), len(deep) + len(private) - 1)]
    assert rows[0].r[1].line == deep.count("\n") and [a.name for a in rows[0].r[1].attrs] == ["name"]
    assert [list(r.r) for r in rows[1:]] == [[], []] and not any(r.m for r in rows)


def test_quotes_comments_and_escapes():
    def found(text, comments):
        got = braces.block_spans(pa.array([text]), braces.RESOURCE, comments)
        return [(b["start"], b["end"]) for b in got[0].as_py()]

    text = 'resource "t" "a" {\n  s = "}\\"}"\n  # }\n}\n'
    assert found(text, False) == [(0, text.index("# }") + 3)]  # comments are not skipped here
    assert found(text, True) == [(0, len(text) - 1)]
    stray = 'x = "\n' + text
    assert found(stray, True) == [(6, len(stray) - 1)]


TEMPLATES = [
    "CidrIp: 0.0.0.0/0\n",
    "Mappings:\n  CidrIp: 0.0.0.0/0\nResources:\n  A: just text\n  B: [1, 2]\n",
    "Resources:\n  R:\n    Type: AWS::EC2::SecurityGroupIngress\n    Properties:\n      CidrIp: 0.0.0.0/0\n      FromPort: 0\n      ToPort: 65535\n",
    "Resources: 5\n", "- a\n- b\n", "", "{", "key: [", None,
]
CONFIGS = [
    'x = "99999999999999999999.0.0.0/8"\n' + resource('  ami = ""'),
    'resource "aws_security_group_rule" "r" {\n  type = "ingress"\n  from_port = 0\n  to_port = 65535\n  cidr_blocks = ["0.0.0.0/0"]\n}\n',
    resource("}{") + "}}}", "resource", "\ud7ff\ue000", "", None,
]


@pytest.mark.parametrize("family,texts", [("template", TEMPLATES), ("hcl", CONFIGS)])
def test_odd_texts_through_faults_and_checks(spark, family, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rule = checks.template_findings(F.col("text"), F.col("nodes")) if family == "template" else checks.hcl_findings(F.col("text"), F.col("resource_spans"))
    found = {r.doc_id: [f.code for f in r.f or []] for r in prepare(df, family).select("doc_id", rule.alias("f")).collect()}
    assert len(found) == len(texts)
    if family == "template":
        assert "W001" in found[2] and "W001" not in found[0] + found[1]
    else:
        assert "E008" in found[0] and "W001" in found[1]
    assert edits_of(df, family, TEMPLATE_FAULTS if family == "template" else HCL_FAULTS).count() >= 0


def test_select_is_judged_for_literal_lists_only(spark):
    select = "Resources:\n  A:\n    Type: T\n    Properties:\n      Z: !Select [{}, {}]\n"
    texts = [select.format(40, "!GetAZs ''"), select.format(2, "[a, b]"), select.format(1, "[a, b]"), select.format("9" * 30, "[a, b]")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = prepare(df, "template").select("doc_id", F.size(checks.intrinsics(F.col("nodes"))).alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_corpus_scan_routes_bad_bytes(spark, tmp_path):
    (tmp_path / "a.tf").write_bytes(b"x = 1\n" * 20)
    (tmp_path / "b.yaml").write_bytes(b"\xff\xfe" * 60)
    (tmp_path / "c.md").write_bytes(b"y" * 100)
    assert [r.path.rsplit("/", 1)[1] for r in corpus.corpus_scan(spark, str(tmp_path)).collect()] == ["a.tf"]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in corpus.corpus_rejects(spark, str(tmp_path)).collect()] == [("b.yaml", "not UTF-8")]


def test_a_removed_provider_block_is_a_break(spark):
    text = 'provider "aws" {\n  region = "us-east-1"\n}\n' + resource("  ami = \"ami-1\"\n  instance_type = \"x\"\n  encrypted = true")
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    broken = edits_of(df, "hcl", ["PROVIDER.missing_provider"]).select("doc_id", F.col("broken").alias("text"))
    codes = lambda d: [f.code for f in prepare(d, "hcl").select(checks.hcl_findings(F.col("text"), F.col("resource_spans")).alias("f")).first().f]
    assert "E010" not in codes(df) and "E010" in codes(broken)
