"""What faults do to documents: on hand-written texts, and as invariants over the rendered ones."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from mendset.functions.text import splice
from mendset.operators import checks
from mendset.operators import structure_hcl as hcl
from mendset.operators.inject import HCL_FAULTS, TEMPLATE_FAULTS, edits_of, inject, prepare
from mendset.operators.structure_template import template_nodes
from mendset.sources.rendered import configs, hcl_configs, template_configs

GOLD = '''terraform {
  required_providers {
    aws = {
      source  = "hashicorp/aws"
      version = ">= 4.0"
    }
  }
}

provider "aws" {
  region = "eu-west-1"
}

variable "stage" {
  default = "dev"
}

# a stray { and a "quote
resource "aws_vpc" "net" {
  cidr_block = "10.1.0.0/16"
  note       = "braces } in { text \\" }"
  tags = {
    Name = "${var.stage}-{net}"
  }
}

module "parts" {
  source = "./parts"
}

resource "aws_subnet" "one" {
  vpc_id            = aws_vpc.net.id
  cidr_block        = "10.1.1.0/24"
  availability_zone = "eu-west-1a"
}

resource "aws_security_group" "web" {
  name   = "web"
  vpc_id = aws_vpc.net.id
  ingress {
    from_port = 80
    to_port   = 80
  }
}

resource "aws_instance" "box" {
  ami           = "ami-0abc123"
  instance_type = "t3.micro"
  subnet_id     = aws_subnet.one.id
  count         = 2
  encrypted     = true
  depends_on    = [aws_subnet.one]
}
'''

TEMPLATE = '''AWSTemplateFormatVersion: "2010-09-09"
# keeps this comment
Parameters:
  Stage:
    Type: String
Conditions:
  Live: !Equals [!Ref Stage, prod]
Resources:
  Net:
    Type: AWS::EC2::VPC
    Properties:
      CidrBlock: 10.0.0.0/16
      Tags:
        - Key: Name
          Value: !Sub "${Stage}-net"
  Web:
    Type: AWS::EC2::SecurityGroup
    DependsOn: Net
    Properties:
      GroupDescription: web
      SecurityGroupIngress:
        - IpProtocol: tcp
          FromPort: 80
          ToPort: 80
          CidrIp: 10.0.0.0/8
  Box:
    Type: AWS::EC2::Instance
    Properties:
      ImageId: ami-0abc123
      InstanceType: t3.micro
      UserData: !If [Live, a, b]
      Zone: !Select
        - 0
        - !GetAZs ""
      Name: !Join
        - "-"
        - - !Ref Stage
          - box
  Bucket:
    Type: AWS::S3::Bucket
    Properties:
      BucketEncryption:
        ServerSideEncryptionConfiguration: []
Outputs:
  Arn:
    Value: !GetAtt Bucket.Arn
'''


def frame(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


def load(text):
    class Loader(yaml.SafeLoader):
        pass

    def build(loader, suffix, node):
        kind = {"ScalarNode": loader.construct_scalar, "SequenceNode": lambda n: loader.construct_sequence(n, deep=True)}
        return {suffix: kind.get(type(node).__name__, lambda n: loader.construct_mapping(n, deep=True))(node)}

    Loader.add_multi_constructor("!", build)
    return yaml.load(text, Loader=Loader)


@pytest.fixture(scope="module")
def broken_hcl(spark):
    return {r.fault_id: r for r in edits_of(frame(spark, GOLD), "hcl").collect()}


@pytest.fixture(scope="module")
def broken_template(spark):
    return {r.fault_id: r for r in edits_of(frame(spark, TEMPLATE), "template").collect()}


def test_every_hcl_fault_applies(broken_hcl):
    # the block drawn for this one may hold no literal of a kind that can drift
    assert set(HCL_FAULTS) - set(broken_hcl) <= {"SYNTACTIC.wrong_attribute_type"}
    for r in broken_hcl.values():
        assert r.broken != GOLD and r.description and r.location


def test_every_template_fault_applies(broken_template):
    assert set(TEMPLATE_FAULTS) - set(broken_template) == {"SYNTACTIC.invalid_json_template"}


@pytest.mark.parametrize(
    ("fault", "old", "new"),
    [
        ("SEMANTIC.invalid_cidr", '"10.1.0.0/16"', '"999.999.999.999/33"'),
        ("SEMANTIC.invalid_region", '"eu-west-1"', '"us-fictional-1"'),
        ("SEMANTIC.bad_ami_format", "ami-0abc123", "INVALID-ami-format"),
        ("PROVIDER.version_constraint_mismatch", ">= 4.0", ">= 99.0.0, < 99.0.1"),
        ("REFERENCE.broken_module_source", "./parts", "./nonexistent_module_path"),
        ("SECURITY.missing_encryption", "\n  encrypted     = true", ""),
        ("DEPENDENCY.missing_depends_on", "\n  depends_on    = [aws_subnet.one]", ""),
        ("PROVIDER.missing_provider", GOLD[: GOLD.index('\n\nprovider "aws"')], ""),
    ],
)
def test_hcl_edit(broken_hcl, fault, old, new):
    assert broken_hcl[fault].broken == GOLD.replace(old, new, 1)


def test_first_vpc_id_is_replaced(broken_hcl):
    assert broken_hcl["CROSS_RESOURCE.subnet_vpc_mismatch"].broken == GOLD.replace("aws_vpc.net.id", '"vpc-00000000"', 1)


def test_cycle_joins_the_first_two_resources(broken_hcl):
    text = broken_hcl["DEPENDENCY.circular_dependency"].broken
    assert "\n  depends_on = [aws_subnet.one]\n}" in text and "\n  depends_on = [aws_vpc.net]\n}" in text


def test_brace_is_the_last_of_its_block(broken_hcl):
    r = broken_hcl["SYNTACTIC.missing_closing_brace"]
    at = r.parts[0].start
    assert GOLD[at] == "}" and (at + 1 == len(GOLD) or GOLD[at - 1] == "\n") and r.broken == GOLD[:at] + GOLD[at + 1 :]


def test_blocks_ignore_braces_in_quotes(spark):
    rows = hcl.resource_table(frame(spark, GOLD)).collect()
    assert [(r.type, r.name) for r in rows] == [
        ("aws_vpc", "net"), ("aws_subnet", "one"), ("aws_security_group", "web"), ("aws_instance", "box"),
    ]
    for r in rows:
        assert GOLD[r.start :].startswith(f'resource "{r.type}"') and GOLD[r.end - 2 : r.end] == "\n}"


def test_deep_nesting_and_unbalanced_blocks(spark):
    deep = 'resource "a_b" "c" {\n' + "  x {\n" * 40 + "  }\n" * 40 + "}\n"
    cut = 'resource "a_b" "d" {\n  y {\n}\n'
    rows = hcl.resource_table(frame(spark, deep + cut)).collect()
    assert [(r.name, r.start, r.end) for r in rows] == [("c", 0, len(deep) - 1)]


def test_attributes_take_only_the_top_level(spark):
    rows = hcl.attribute_table(frame(spark, GOLD)).filter("block = 'web'").collect()
    assert [r.name for r in rows] == ["name", "vpc_id"]
    lines = GOLD.split("\n")
    for r in rows:
        assert lines[r.line] == r.text and GOLD[r.start :].startswith(r.text)


def test_strict_refs_leave_out_dotted_numbers(spark):
    df = frame(spark, 'x = "10.0.1.0/24"\ny = aws_vpc.net.id\n')
    rows = df.select(hcl.resource_refs(F.col("text")).alias("s"), hcl.resource_refs(F.col("text"), strict=False).alias("l")).first()
    assert [(r.type, r.name) for r in rows.s] == [("aws_vpc", "net")]
    assert [(r.type, r.name) for r in rows.l] == [("10", "0"), ("aws_vpc", "net")]


@pytest.mark.parametrize(
    ("fault", "change"),
    [
        ("REFERENCE.bad_getatt", lambda t: t["Outputs"]["Arn"]["Value"].update(GetAtt="BucketBroken.Arn")),
        ("REFERENCE.undefined_parameter", lambda t: t.pop("Parameters") and t.update(Parameters={})),
        ("SEMANTIC.cf_invalid_resource_type", lambda t: t["Resources"]["Net"].update(Type="AWS::EC2::VirtualPrivateCloud")),
        ("SEMANTIC.cf_bad_ami", lambda t: t["Resources"]["Box"]["Properties"].update(ImageId="INVALID-ami-format")),
        ("SEMANTIC.wrong_property_value", lambda t: t["Resources"]["Box"]["Properties"].update(InstanceType="x1.superlarge")),
        ("SYNTACTIC.missing_required_property", lambda t: t["Resources"]["Net"]["Properties"].pop("CidrBlock")),
        ("SYNTACTIC.wrong_property_type", lambda t: t["Resources"]["Net"]["Properties"].update(Tags="not-a-list")),
        ("DEPENDENCY.missing_dependency", lambda t: t["Resources"]["Web"].pop("DependsOn")),
        ("DEPENDENCY.circular_depends_on", lambda t: (t["Resources"]["Net"].update(DependsOn=["Web"]), t["Resources"]["Web"].update(DependsOn=["Net"]))),
        ("INTRINSIC.wrong_select_index", lambda t: t["Resources"]["Box"]["Properties"]["Zone"]["Select"].__setitem__(0, 999)),
        ("INTRINSIC.bad_if_condition", lambda t: t["Resources"]["Box"]["Properties"]["UserData"]["If"].__setitem__(0, "NonExistentCondition")),
        ("INTRINSIC.invalid_join", lambda t: t["Resources"]["Box"]["Properties"]["Name"].update(Join="invalid-join-not-a-list")),
        ("INTRINSIC.malformed_sub", lambda t: t["Resources"]["Net"]["Properties"]["Tags"][0]["Value"].update(Sub="${Stage}-net ${UndefinedVar")),
        ("SECURITY.cf_missing_encryption", lambda t: t["Resources"]["Bucket"].update(Properties={})),
        ("SECURITY.open_ingress", lambda t: t["Resources"]["Web"]["Properties"]["SecurityGroupIngress"].append(
            {"IpProtocol": "tcp", "FromPort": 0, "ToPort": 65535, "CidrIp": "0.0.0.0/0"})),
    ],
)
def test_template_edit_means_what_it_should(broken_template, fault, change):
    """The broken text loads to the gold tree with exactly the intended change; comments stay."""
    want = load(TEMPLATE)
    change(want)
    if fault == "REFERENCE.undefined_parameter":
        want.pop("Parameters", None)
    broken = broken_template[fault].broken
    got = load(broken)
    if fault == "REFERENCE.undefined_parameter":
        assert not got.get("Parameters")
        got.pop("Parameters", None)
    assert got == want and "# keeps this comment" in broken


def test_json_template_edits(spark):
    tree = {
        "Resources": {
            "A": {"Type": "AWS::SQS::Queue", "Properties": {"Name": {"Fn::Join": ["-", ["x", {"Ref": "B"}]]}, "L": [1, 2]}},
            "B": {"Type": "AWS::EC2::SecurityGroup", "DependsOn": "A", "Properties": {"GroupDescription": "g"}},
        }
    }
    rows = {r.fault_id: r.broken for r in edits_of(frame(spark, json.dumps(tree, indent=2)), "template").collect()}
    opened = json.loads(rows["SECURITY.open_ingress"])["Resources"]["B"]["Properties"]["SecurityGroupIngress"]
    assert opened == [{"IpProtocol": "tcp", "FromPort": 0, "ToPort": 65535, "CidrIp": "0.0.0.0/0"}]
    cycle = json.loads(rows["DEPENDENCY.circular_depends_on"])["Resources"]
    assert (cycle["A"]["DependsOn"], cycle["B"]["DependsOn"]) == (["B"], ["A"])
    assert json.loads(rows["SYNTACTIC.missing_required_property"])["Resources"]["B"]["Properties"] == {}
    assert json.loads(rows["SYNTACTIC.wrong_property_type"])["Resources"]["A"]["Properties"]["L"] == "not-a-list"
    assert json.loads(rows["REFERENCE.broken_ref"])["Resources"]["A"]["Properties"]["Name"]["Fn::Join"][1][1] == {"Ref": "BNonexistent"}
    assert "DependsOn" not in json.loads(rows["DEPENDENCY.missing_dependency"])["Resources"]["B"]
    with pytest.raises(json.JSONDecodeError):
        json.loads(rows["SYNTACTIC.invalid_json_template"])
    assert "SYNTACTIC.invalid_yaml" not in rows


def test_nodes_cover_every_entry_in_order(spark):
    def walk(tree, path=()):
        if isinstance(tree, dict):
            for k, v in tree.items():
                yield (*path, k)
                yield from walk(v, (*path, k))
        elif isinstance(tree, list):
            for i, v in enumerate(tree):
                yield from walk(v, (*path, str(i)))

    rows = template_nodes(frame(spark, TEMPLATE)).orderBy("i").collect()
    assert [tuple(r.path) for r in rows] == list(walk(load(TEMPLATE)))


def test_bad_texts_have_no_nodes(spark):
    df = spark.createDataFrame([(1, "a: [1"), (2, ""), (3, None), (4, "- 1\n- 2\n"), (5, "a: &x\n  b: *x\n")], "doc_id bigint, text string")
    assert {r.doc_id for r in template_nodes(df).collect()} == {5}


def test_unknown_format_yields_nothing(spark):
    df = frame(spark, GOLD).withColumn("format", F.lit("pulumi"))
    assert inject(df, ["SEMANTIC.invalid_cidr"], ["SEMANTIC.cf_bad_ami"]).count() == 0


@pytest.mark.parametrize("family", ["hcl", "template"])
def test_invariants(spark, sf, family):
    """Broken differs from gold; the inverse edit restores gold; parts are as many as they should be."""
    source = (hcl_configs if family == "hcl" else template_configs)(spark, sf).filter("doc_id < 200")
    rows = edits_of(source, family)
    two = F.col("fault_id").isin("DEPENDENCY.circular_dependency", "DEPENDENCY.circular_depends_on")
    n = F.size("parts")
    moved = F.aggregate(
        F.array_sort("parts"),
        F.struct(F.lit(0).alias("shift"), F.expr("cast(array() as array<struct<start:int,end:int,replacement:string>>)").alias("out")),
        lambda a, p: F.struct(
            (a["shift"] + F.length(p["replacement"]) - p["end"] + p["start"]).alias("shift"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (p["start"] + a["shift"]).alias("start"),
                        (p["start"] + a["shift"] + F.length(p["replacement"])).alias("end"),
                        F.substring("text", p["start"] + 1, p["end"] - p["start"]).alias("replacement"),
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    bad = rows.filter(
        (F.col("broken") == F.col("text"))
        | (n != F.when(two, 2).otherwise(1))
        | (splice(F.col("broken"), moved) != F.col("text"))
    )
    assert bad.count() == 0


def test_result_does_not_depend_on_partitions(spark, sf):
    source = hcl_configs(spark, sf).filter("doc_id < 300")
    names = ["SYNTACTIC.missing_closing_brace", "REFERENCE.undefined_variable"]
    digest = lambda d: sorted(map(tuple, edits_of(d, "hcl", names).select("doc_id", "fault_id", "broken").collect()))
    assert digest(source.repartition(1)) == digest(source.repartition(7, "path"))


RAISES = {
    "hcl": {
        "SYNTACTIC.missing_closing_brace": "E001", "SYNTACTIC.missing_required_argument": "E005",
        "REFERENCE.undefined_variable": "E002", "REFERENCE.bad_resource_reference": "E003",
        "SEMANTIC.bad_ami_format": "E008", "SEMANTIC.invalid_cidr": "E008", "SEMANTIC.invalid_region": "E008",
        "DEPENDENCY.circular_dependency": "E009", "SECURITY.overly_permissive_security_group": "W001",
        "SECURITY.missing_encryption": "W002", "CROSS_RESOURCE.wrong_az_reference": "E008",
    },
    "template": {
        "SYNTACTIC.missing_required_property": "E005", "SYNTACTIC.invalid_json_template": "E012",
        "REFERENCE.broken_ref": "E004", "REFERENCE.bad_getatt": "E004", "REFERENCE.undefined_parameter": "E004",
        "SEMANTIC.cf_bad_ami": "E008", "DEPENDENCY.circular_depends_on": "E009", "INTRINSIC.malformed_sub": "E011",
        "INTRINSIC.bad_if_condition": "E011", "INTRINSIC.invalid_join": "E011",
        "SECURITY.open_ingress": "W001", "SECURITY.cf_missing_encryption": "W002",
    },
}


@pytest.mark.parametrize("family", ["hcl", "template"])
def test_each_fault_raises_its_check(spark, sf, family):
    source = (hcl_configs if family == "hcl" else template_configs)(spark, sf).filter("doc_id < 150").select("doc_id", "text")
    rule = lambda: (
        checks.hcl_findings(F.col("text"), F.col("resource_spans"))
        if family == "hcl"
        else checks.template_findings(F.col("text"), F.col("nodes"))
    )
    count = lambda d: prepare(d, family).withColumn("found", F.transform(rule(), lambda f: f["code"]))
    gold = count(source).select("doc_id", F.col("found").alias("gold_found"))
    broken = edits_of(source, family, list(RAISES[family])).select("doc_id", "fault_id", F.col("broken").alias("text"))
    codes = F.create_map(*[F.lit(x) for kv in RAISES[family].items() for x in kv])
    number = lambda a: F.size(F.filter(a, lambda c: c == F.element_at(codes, F.col("fault_id"))))
    missed = count(broken).join(gold, "doc_id").filter(number("found") <= number("gold_found"))
    assert missed.groupBy("fault_id").count().collect() == []


def test_injection_does_not_shuffle(spark, sf):
    for family, source in (("hcl", hcl_configs), ("template", template_configs)):
        plan = edits_of(source(spark, sf), family, ["SYNTACTIC.missing_closing_brace"] if family == "hcl" else ["REFERENCE.broken_ref"])
        text = plan._jdf.queryExecution().executedPlan().toString()
        # the only exchange spreads the narrow order rows of a one-file test table over the cores
        assert text.count("Exchange") <= 1 and "SortMergeJoin" not in text


def test_configs_have_both_formats(spark, sf):
    assert {r.format for r in configs(spark, sf).select("format").distinct().collect()} == {"terraform", "cloudformation"}
