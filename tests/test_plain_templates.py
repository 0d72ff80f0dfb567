import random

import pytest
import yaml

from mendset.functions import plain_templates
from mendset.operators import structure_template as st

RESOLVERS = yaml.SafeLoader.yaml_implicit_resolvers
YAML = """# a stack
Parameters:
  Stage:
    Type: String
    AllowedValues: [dev, "test", 1.5, true]

Conditions:
  IsLive: !Equals [!Ref Stage, prod]
Resources:
  # the net
  Net:
    Type: AWS::EC2::VPC
    Properties:
      CidrBlock: 10.1.0.0/16
      Tags:
        - Key: Name
          Value: !Sub "${Stage}-net"
        - only
  Disk:
    Type: AWS::S3::Bucket
    DependsOn: [Net]
    Properties:
      BucketName: !Join ["-", [disk, "1", !Select [0, !GetAZs ""]]]
      Fn::Odd: {"a": {"b": !Ref Net}, "c": []}
Outputs: {}
"""
JSON = '{\n  "Resources": {\n    "Net": {"Type": "AWS::EC2::VPC", "Size": -1, "On": true, "DependsOn": ["Net", "x"]},\n    "A" : { "Ref":"Net" }\n  },\n  "Empty": {}\n}\n'
PLAIN = [YAML, JSON, "a: b", "a:\n  - b: c\n    d: 2001-01-01\n  - e\n", "{}\n", "a: b#c\nd: x:y\n", "\n\na: 0x1F\n"]
UNUSUAL = [
    "a: b # c\n", "a:\n- b\n", "a: |\n  b\n", "a: &x b\nc: *x\n", 'a: "b\\n"\n', "a: b\n  c\n", "a:\nb: c\n", "a: ü\n", "a: b\n---\nc: d\n",
    "- a\n- b\n", "a:\n\t- b\n", "a: !Join\n  - b\n", '{"a": "b",}', "a: 'it''s'\n", "a:\n  - - b\n", "a\n", "", "{a: b}", "a: [b: c]\n", "a:\n  b: c\n d: e\n",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_need_no_tree(text, monkeypatch):
    wanted = st._composed_rows(text)
    monkeypatch.setattr(st, "_compose", None)
    assert st._rows(text) == wanted


@pytest.mark.parametrize("text", UNUSUAL)
def test_unusual_texts_are_composed(text):
    assert plain_templates.rows(text, RESOLVERS) is None
    assert st._rows(text) == st._composed_rows(text)


def test_changed_texts_give_the_rows_of_the_tree():
    rng, read = random.Random(7), 0
    for _ in range(6000):
        text = rng.choice([YAML, *PLAIN, *UNUSUAL])
        for _ in range(rng.choice((1, 1, 2))):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", " ", "\n", "  ", ":", ": ", "-", "- ", ",", "[", "]", "{", "}", '"', "'", "#", "!R ", "1", "~"]) + text[at + rng.choice((0, 0, 1)) :]
        got = plain_templates.rows(text, RESOLVERS)
        if got is not None:
            read += 1
            assert got == st._composed_rows(text), text
    assert read > 300


def test_nodes_of_many_texts(spark):
    texts = [YAML, None, "", JSON, "a: b # c\n", "- a\n", "\ta: ["]
    configs = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string").coalesce(1)
    got = {r.doc_id: r.nodes for r in st.with_nodes(configs).collect()}
    assert [len(got[i]) for i in range(7)] == [len(st._composed_rows(t)) if t else 0 for t in texts]
    disk = {tuple(n.path): n for n in got[0]}
    name = disk["Resources", "Disk", "Properties", "BucketName"]
    assert (name.owner_type, name.called, name.kind, disk[(*name.path, "Join")].size) == ("AWS::S3::Bucket", False, "map", 2)
    assert disk["Resources", "Disk", "DependsOn"].circular is False
    net = {tuple(n.path): n for n in got[3]}
    assert net["Resources", "Net", "DependsOn"].circular and not net["Resources", "Net", "Type"].circular
    assert YAML[name.start : name.end].startswith("!Join")
