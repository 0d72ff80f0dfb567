"""Configuration texts rendered from the `orders` table, one per order.

The given tables hold no configuration text, so the structural operators run on texts built from
order columns by plain concatenation: no join, no group, no shuffle, one row in and one row out.
Both renderings are written in SQL that Spark and other engines share, so that a test can rebuild
the same text elsewhere.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HCL_PARTS: list[tuple[str | None, str]] = [
    (
        "o_orderkey % 10 <> 9",
        """terraform {
  required_version = ">= 1.<<o_orderkey % 9>>"
}

""",
    ),
    (
        "o_orderkey % 10 <> 8",
        """provider "aws" {
  region = "us-east-<<1 + o_custkey % 2>>"
}

""",
    ),
    (
        None,
        """# rendered order {<<o_orderkey>>}
variable "priority" {
  default = "<<o_orderpriority>>"
}

resource "aws_vpc" "main" {
  cidr_block = "10.<<o_custkey % 255>>.0.0/16"
  tags = {
    Name = "vpc-${var.priority}"
  }
}

resource "aws_subnet" "main" {
  vpc_id            = aws_vpc.main.id
  cidr_block        = "10.<<o_custkey % 255>>.1.0/24"
  availability_zone = "us-east-1<<substr('abc', 1 + CAST(o_orderkey % 3 AS INT), 1)>>"
}

""",
    ),
    (
        "o_orderkey % 2 = 0",
        """resource "aws_security_group" "edge" {
  name   = "edge-<<o_orderkey>>"
  vpc_id = aws_vpc.main.id
  ingress {
    from_port   = 443
    to_port     = 443
    protocol    = "tcp"
    cidr_blocks = ["10.0.0.0/8"]
  }
}

""",
    ),
    (
        "o_orderkey % 5 = 0",
        """module "net" {
  source = "./modules/net<<o_custkey % 4>>"
  size   = <<o_orderkey % 7>>
}

""",
    ),
]
for _n in (1, 2, 3):
    HCL_PARTS += [
        (
            f"o_orderkey % 3 >= {_n - 1}",
            f"""resource "aws_instance" "line_{_n}" {{
  ami           = "ami-<<lpad(CAST(o_custkey * {_n} AS STRING), 8, '0')>>"
  instance_type = var.priority
  subnet_id     = aws_subnet.main.id
  count         = <<(o_orderkey * {_n}) % 50>>
  monitoring    = <<CASE WHEN (o_orderkey + {_n}) % 2 = 0 THEN 'true' ELSE 'false' END>>
""",
        ),
        (f"o_orderkey % 3 >= {_n - 1} AND o_orderstatus = 'F'", "  encrypted     = true\n"),
        (f"o_orderkey % 3 >= {_n - 1} AND {_n} > 1", "  depends_on    = [aws_vpc.main]\n"),
        (f"o_orderkey % 3 >= {_n - 1}", "}\n\n"),
    ]

YAML_PARTS: list[tuple[str | None, str]] = [
    (
        None,
        """# order <<o_orderkey>>
AWSTemplateFormatVersion: "2010-09-09"
Description: Stack of order <<o_orderkey>>
Parameters:
  StackEnv:
    Type: String
    Default: <<CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'prod' END>>
  NodeType:
    Type: String
    Default: t3.micro
Conditions:
  IsLive: !Equals [!Ref StackEnv, prod]
Resources:
  Network:
    Type: AWS::EC2::VPC
    Properties:
      CidrBlock: 10.<<o_custkey % 255>>.0.0/16
      Tags:
        - Key: Name
          Value: !Sub "${StackEnv}-net-<<o_orderkey>>"
  Subnet:
    Type: AWS::EC2::Subnet
""",
    ),
    ("o_orderkey % 3 = 0", "    DependsOn: Network\n"),
    (
        None,
        """    Properties:
      VpcId: !Ref Network
      CidrBlock: 10.<<o_custkey % 255>>.1.0/24
      AvailabilityZone: !Select [0, !GetAZs ""]
""",
    ),
    (
        "o_orderkey % 4 = 0",
        """  Guard:
    Type: AWS::EC2::SecurityGroup
    Properties:
      GroupDescription: guard of order <<o_orderkey>>
      VpcId: !Ref Network
      SecurityGroupIngress:
        - IpProtocol: tcp
          FromPort: 443
          ToPort: 443
          CidrIp: 10.0.0.0/8
""",
    ),
    (
        None,
        """  Worker:
    Type: AWS::EC2::Instance
    Properties:
      ImageId: ami-<<lpad(CAST(o_custkey AS STRING), 8, '0')>>
      InstanceType: <<CASE WHEN o_orderkey % 8 = 0 THEN 't3.small' ELSE '!If [IsLive, m5.large, !Ref NodeType]' END>>
      SubnetId: !Ref Subnet
""",
    ),
    (
        "o_orderstatus <> 'O'",
        """  Store:
    Type: AWS::S3::Bucket
    Properties:
      BucketName: !Join ["-", [store, "<<o_orderkey>>"]]
""",
    ),
    (
        "o_orderstatus = 'F'",
        """      BucketEncryption:
        ServerSideEncryptionConfiguration:
          - ServerSideEncryptionByDefault:
              SSEAlgorithm: AES256
""",
    ),
    (
        None,
        """Outputs:
  WorkerIp:
    Value: !GetAtt Worker.PrivateIp
""",
    ),
]

JSON_PARTS: list[tuple[str | None, str]] = [
    (
        None,
        """{
  "AWSTemplateFormatVersion": "2010-09-09",
  "Parameters": {
    "StackEnv": {
      "Type": "String",
      "Default": "<<CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'prod' END>>"
    }
  },
  "Resources": {
    "Network": {
      "Type": "AWS::EC2::VPC",
      "Properties": {
        "CidrBlock": "10.<<o_custkey % 255>>.0.0/16"
      }
    },
    "Queue": {
      "Type": "AWS::SQS::Queue",
      "DependsOn": "Network",
      "Properties": {
        "QueueName": {
          "Fn::Sub": "${StackEnv}-<<o_orderkey>>"
        },
        "Tags": [
          "<<o_orderstatus>>",
          "<<o_orderpriority>>"
        ]
      }
    },
    "Worker": {
      "Type": "AWS::EC2::Instance",
      "Properties": {
        "ImageId": "ami-<<lpad(CAST(o_custkey AS STRING), 8, '0')>>",
        "InstanceType": "t3.small",
        "SubnetId": {
          "Ref": "Network"
        }
      }
    }
  },
  "Outputs": {
    "QueueArn": {
      "Value": {
        "Fn::GetAtt": ["Queue", "Arn"]
      }
    }
  }
}
""",
    ),
]


def concat_sql(parts: list[tuple[str | None, str]]) -> str:
    """One SQL concatenation; <<expr>> marks a column expression, a condition guards its part."""
    out = []
    for condition, text in parts:
        terms = []
        for i, piece in enumerate(re.split(r"<<(.*?)>>", text)):
            if i % 2:
                terms.append(f"CAST(({piece}) AS STRING)")
            elif piece:
                # "${" is split so that no engine takes it for a variable of its own
                terms += [f"'{t}'" for t in piece.replace("${", "$\0{").split("\0")]
        joined = "concat(" + ", ".join(terms) + ")"
        out.append(joined if condition is None else f"CASE WHEN {condition} THEN {joined} ELSE '' END")
    return "concat(" + ",\n".join(out) + ")"


HCL_TEXT = concat_sql(HCL_PARTS)
TEMPLATE_TEXT = (
    f"CASE WHEN o_orderkey % 3 = 1 THEN {concat_sql(JSON_PARTS)} ELSE {concat_sql(YAML_PARTS)} END"
)
HCL_PATH = (
    "concat('live/env', CAST(o_custkey % 7 AS STRING), '/order_', CAST(o_orderkey AS STRING), '.tf')"
)
TEMPLATE_PATH = (
    "concat(CASE WHEN o_custkey % 2 = 0 THEN 'cloudformation/' ELSE 'stacks/' END, 'order_', "
    "CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 1 THEN '.json' ELSE '.yaml' END)"
)


TASK_ROWS = 50_000  # orders whose texts one task renders and works on
PLACE = "place in the scan"


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows evenly over tasks of about TASK_ROWS rows at most, as many to each core.

    The scan's own partitions tell nothing: a file is cut by bytes, but each of its row groups is read
    whole by one task, so that most partitions of a file of few row groups hold no row. The rows are
    narrow here: text is rendered after this exchange, never before it. The count reads file footers only.
    Rows go by the hash of their place, which is even for any keys; dealing them in turn would have the task
    of a row group sort it first.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, math.ceil(rows.count() / (cores * TASK_ROWS)))
    return rows.withColumn(PLACE, F.monotonically_increasing_id()).repartition(cores * rounds, PLACE).drop(PLACE)


def _rendered(spark: SparkSession, sf_dir: str, text: str, path: str, fmt: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.expr(path).alias("path"),
        F.lit(fmt).alias("format"),
        F.expr(text).alias("text"),
        F.col("o_orderkey").alias("seq"),
    )


def hcl_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, HCL_TEXT, HCL_PATH, "terraform")


def template_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, TEMPLATE_TEXT, TEMPLATE_PATH, "cloudformation")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both corpora; template documents get ids and positions after their HCL twin."""
    shift = [(F.col("doc_id") * 2).alias("doc_id"), "path", "format", "text", (F.col("seq") * 2).alias("seq")]
    shift2 = [(F.col("doc_id") * 2 + 1).alias("doc_id"), "path", "format", "text", (F.col("seq") * 2 + 1).alias("seq")]
    return hcl_configs(spark, sf_dir).select(*shift).unionAll(template_configs(spark, sf_dir).select(*shift2))
