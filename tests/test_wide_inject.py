"""Many faults at a time: in groups, on places in bytes, from the nodes that are read."""

import pytest
from pyspark.sql import functions as F
from test_faults import GOLD

from mendset.functions import text as t
from mendset.operators import inject as made
from mendset.operators import structure_template
from mendset.plans import structure
from mendset.plans.catalogue import QUERIES

TEMPLATE = """Parameters:
  Env:
    Type: String
Resources:
  Net:
    Type: AWS::EC2::VPC
    Properties:
      CidrBlock: 10.0.0.0/16
      Tags: [{Key: a, Value: !Sub "${Env}-x"}]
  Box:
    Type: AWS::EC2::Instance
    DependsOn: Net
    Properties:
      ImageId: ami-1
      InstanceType: !If [Live, !Ref Env, !Select [0, [a, b]]]
      Name: !Join ["-", [a, b]]
      Data: {"Fn::GetAtt": [Net, Id]}
"""


def test_many_faults_are_made_in_groups():
    groups = made._groups(made.HCL_FAULTS)
    assert len(groups) == 3 and max(map(len, groups)) <= made.GROUP
    assert sorted(f for g in groups for f in g) == sorted(made.HCL_FAULTS)
    assert made._groups(made.HCL_FAULTS[:3]) == [made.HCL_FAULTS[:3]] and made._groups([]) == [[]]


@pytest.mark.parametrize(("family", "gold"), [("hcl", GOLD), ("template", TEMPLATE)])
def test_other_texts_break_as_ascii_texts_do(spark, family, gold):
    head = "# é😀\n"
    df = lambda text: spark.createDataFrame([(1, text)], "doc_id int, text string")
    broken = lambda text: {r.fault_id: r.broken for r in made.edits_of(df(text), family).collect()}
    plain, other = broken(gold), broken(head + gold)
    assert len(plain) > 9 and set(plain) == set(other)
    drawn = {"SYNTACTIC.invalid_yaml"}  # draws among all lines
    assert {f: b for f, b in other.items() if f not in drawn} == {f: head + b for f, b in plain.items() if f not in drawn}


def test_bytes_of_plain_texts_give_the_same_places(spark):
    rows = [("abcdef",), ("é😀abcdef",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string").withColumn("b", t.plain_bytes(F.col("s")))
    assert [r.b is None for r in df.collect()] == [False, True, False, True]
    p = F.expr("array(named_struct('start',3,'end',5,'replacement','ß'), named_struct('start',0,'end',1,'replacement','++'))")
    s, b, k = F.col("s"), F.col("b"), F.lit
    for parts in (p, F.slice(p, 1, 1), F.slice(p, 1, 0)):
        # parts lie inside their text
        assert df.filter("s is null or s <> ''").filter(~t.splice(s, parts, b).eqNullSafe(t.splice(s, parts))).count() == 0
    for start, end in ((0, 3), (2, 99), (-2, 3), (50, 60), (3, 1)):
        assert df.filter(~t.text_slice(s, k(start), k(end), b).eqNullSafe(t.code_point_slice(s, k(start), k(end)))).count() == 0
    assert df.filter(~t.first_match(s, "c.", b).eqNullSafe(t.first_match(s, "c."))).count() == 0


@pytest.mark.parametrize("name", ["chk_type_drift_template", "chk_unknown_type_template", "render_template", "nested_set"])
def test_queries_name_the_nodes_they_read(spark, sf, monkeypatch, name):
    given = []
    real = structure_template.with_nodes

    def seen(configs, reads=None):
        given.append(reads)
        return real(configs, reads)

    monkeypatch.setattr(made, "with_nodes", seen)
    monkeypatch.setattr(structure.tpl, "with_nodes", seen)
    QUERIES[name](spark, sf)
    assert given and None not in given
