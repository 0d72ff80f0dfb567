import random

import pyarrow as pa
import yaml
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from pyspark.sql import functions as F

from mendset.functions import template_arrays
from mendset.operators import checks, edits, inject
from mendset.operators import structure_template as st

RESOLVERS = yaml.SafeLoader.yaml_implicit_resolvers
YAML = """# a stack
Parameters:
  Stage:
    Type: String
    AllowedValues: [dev, "te'st", 1.5, true, {}, []]

Conditions:
  IsLive: !Equals [!Ref Stage, prod]
Resources:
  Net:
    Type: AWS::EC2::VPC
    DependsOn: [Disk, Disk]
    Properties:
      CidrBlock: 10.1.0.0/16
      Tags:
        - Key: Name
          Value: !Sub "${Stage}-net"
        - !Ref Stage
        - !Join ['-', [a, b]]
        - only
  Disk:
    Type: AWS::S3::Bucket
    DependsOn: Net
    Properties:
      BucketName: !Join ["-", [disk, "1", !Select [0, !GetAZs ""], [!Ref A, {"b": !Ref B}]]]
      Nested:
        Fn::Odd: {"a": {"b": !Ref Net}, "c": [], "d": 7}
Outputs: {}"""
JSON = '{\n  "Resources": {\n    "Net": {"Type": "AWS::EC2::VPC", "Size": -1, "On": true, "DependsOn": ["Net", "x"],\n      "Properties": {"A" : { "Ref":"Net" }, "B": [[1, {"c": "it\'s"}], null]}}\n  },\n  "Empty": {}\n}\n'
PLAIN = [YAML, JSON, "a: b", "a:\n  - b: c\n    d: 2001-01-01\n  - e\n", "{}\n", "a: b#c\nd: x:y\n", "\n\na: 0x1F\n", "a: 'b'\nc: \"\"\n"]
OTHER = [
    None, "", "a: b # c\n", "a:\n- b\n", "a: |\n  b\n", "a: &x b\nc: *x\n", 'a: "b\\n"\n', "a: b\n  c\n", "a:\nb: c\n", "a: ü\n", "- a\n", "a: b\na: c\n",
    "a:\n\t- b\n", "a: !Join\n  - b\n", '{"a": "b",}', "a: 'it''s'\n", "a:\n  - - b\n", "a\n", "{a: b}", "a: [b: c]\n", "a:\n  b: c\n d: e\n", "a: [\"b, c]\n", "a: [b}\n",
]


def node_type(spark):
    return to_arrow_type(_parse_datatype_string(f"array<{st.NODE_TYPE}>")).value_type


def composed(texts, node, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(st, "_rows", st._composed_rows)
        return st._made(texts, node).to_pylist()


def test_plain_templates_are_not_read_one_by_one(spark, monkeypatch):
    node = node_type(spark)
    wanted = composed(PLAIN, node, monkeypatch)
    monkeypatch.setattr(st, "_rows", None)
    got = st._nodes(PLAIN, node)
    got.validate(full=True)
    assert got.to_pylist() == wanted


def test_other_templates_keep_their_places(spark, monkeypatch):
    node = node_type(spark)
    texts = [t for pair in zip(OTHER, PLAIN * 3) for t in pair]
    plain = template_arrays.Templates(texts, RESOLVERS)
    assert plain.bad.tolist() == [True, False] * len(OTHER)
    assert st._nodes(texts, node).to_pylist() == composed(texts, node, monkeypatch)
    assert st._nodes(OTHER, node).to_pylist() == composed(OTHER, node, monkeypatch)
    assert st._nodes([], node).to_pylist() == []


def test_changed_templates_have_the_rows_of_the_tree(spark, monkeypatch):
    node, rng, read = node_type(spark), random.Random(3), 0
    pieces = ["", " ", "\n", "  ", ":", ": ", "-", "- ", ",", "[", "]", "{", "}", '"', "'", "#", " #", "!R ", "1", "~", "::", "Type: A", "null", "[]"]
    for _ in range(40):
        texts = []
        for _ in range(100):
            text = rng.choice([YAML, *PLAIN])
            for _ in range(rng.choice((1, 1, 2))):
                at = rng.randrange(len(text) + 1)
                text = text[:at] + rng.choice(pieces) + text[at + rng.choice((0, 0, 1)) :]
            texts.append(text)
        plain = template_arrays.Templates(texts, RESOLVERS)
        ok = [t for t, bad in zip(texts, plain.bad) if not bad]
        read += len(ok)
        got = plain.nodes(node)
        assert isinstance(got, pa.ListArray)
        assert got.to_pylist() == composed(ok, node, monkeypatch)
    assert read > 500


GROUPS = """Parameters:
  Only: {"Type": "String"}
Resources:
  Group:
    Type: AWS::EC2::SecurityGroup
    Properties:
      GroupDescription: !Ref Only
      SecurityGroupIngress:
        - CidrIp: 0.0.0.0/0
          FromPort: 0
          ToPort: 65535
  Alone:
    Type: AWS::EC2::SecurityGroupIngress
    DependsOn: Gone
    Properties: {"CidrIp": "0.0.0.0/0", "Engine": "x", "A": {"B": !GetAtt Lost.Arn}, "C": !If [No, a, b], "D": !Select [3, [a]], "E": !Sub "${a"}
  Disk: {"Type": "AWS::S3::Bucket", "DependsOn": "Disk", "Properties": {"ImageId": "ami-1", "BucketEncryption": {}, "J": !Join x}}
"""


def test_nodes_that_are_not_read_change_nothing(spark, monkeypatch):
    texts = [YAML, JSON, GROUPS, GROUPS.replace("String", "Stri\\u006eg"), YAML.replace("Net:", "Net: # a"), "Resources: !X {\"a\": {\"Type\": \"b\"}}\n", "a: b", None]
    configs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string").coalesce(1)
    made = lambda: sorted(inject.edits_of(configs, "template").drop("text").collect())
    one = lambda f: sorted(inject.edits_of(configs, "template", [f]).drop("text").collect())
    few = made()
    each = {f: one(f) for f in inject.TEMPLATE_FAULTS}
    assert sum(map(len, each.values())) == len(few) > 30
    with monkeypatch.context() as m:
        m.setattr(inject, "READS", {})
        assert made() == few
    assert sorted(r for rows in each.values() for r in rows) == few
    for name, reads in checks.READS.items():
        found = lambda docs: docs.select("doc_id", getattr(checks, name)(F.col("nodes")).alias("f")).orderBy("doc_id").collect()  # noqa: B023, E731
        got = found(st.with_nodes(configs, reads))
        assert got == found(st.with_nodes(configs)) and any(r.f for r in got), name
    assert set(edits.READS) == set(inject.TEMPLATE_FAULTS)


def test_only_nodes_that_are_read_are_handed_over(spark):
    node = node_type(spark)
    reads = [st.calls_of("Ref"), st.resource_key("Type"), (1, None, None, ("a",)), (5, "Resources", "Properties", None)]
    texts = [YAML, *OTHER, JSON, "a: b # c\nc: d\n"]
    whole, some = st._nodes(texts, node).to_pylist(), st._nodes(texts, node, reads).to_pylist()
    assert some == [[n for n in nodes if st._matches(n["path"], reads)] for nodes in whole]
    assert 0 < sum(map(len, some)) < sum(map(len, whole))
