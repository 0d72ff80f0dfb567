"""The fault dimension: a small literal table and the selections made from it."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HCL_FORMATS = ["terraform", "opentofu"]
TEMPLATE_FORMATS = ["cloudformation"]

# The fault taxonomy in registration order.
# (category, name, severity, formats, example_error, tags, description)
FAULTS = [
    ("SYNTACTIC", "missing_closing_brace", "low", HCL_FORMATS, "Error: Argument or block definition required", ["hcl", "parse-error"], "Remove a closing brace from a resource, variable, or output block"),
    ("SYNTACTIC", "wrong_attribute_type", "low", HCL_FORMATS, "Error: Invalid value for variable", ["type-mismatch"], 'Assign a string where a number/bool is expected or vice versa (e.g., port = "eighty")'),
    ("SYNTACTIC", "invalid_hcl_syntax", "low", HCL_FORMATS, "Error: Invalid expression", ["hcl", "parse-error"], "Introduce invalid HCL syntax (e.g., missing equals sign, stray comma)"),
    ("SYNTACTIC", "missing_required_argument", "low", HCL_FORMATS, "Error: Missing required argument", ["required-field"], "Remove a required argument from a resource block (e.g., ami from aws_instance)"),
    ("REFERENCE", "undefined_variable", "medium", HCL_FORMATS, "Error: Reference to undeclared input variable", ["reference", "variable"], "Reference a variable that is not declared (var.nonexistent)"),
    ("REFERENCE", "bad_resource_reference", "medium", HCL_FORMATS, "Error: Reference to undeclared resource", ["reference", "resource"], "Reference a non-existent resource or misspell resource name in an expression"),
    ("REFERENCE", "broken_module_source", "medium", HCL_FORMATS, "Error: Failed to download module", ["module", "source"], "Set module source to an invalid path or non-existent registry module"),
    ("SEMANTIC", "invalid_resource_type", "medium", HCL_FORMATS, "Error: Invalid resource type", ["resource-type"], "Use a non-existent resource type (e.g., aws_ec2_instance instead of aws_instance)"),
    ("SEMANTIC", "bad_ami_format", "medium", HCL_FORMATS, "Error: expected AMI ID to match pattern", ["ami", "aws"], "Use an invalid AMI ID format (e.g., missing ami- prefix, wrong length)"),
    ("SEMANTIC", "invalid_cidr", "medium", HCL_FORMATS, "Error: invalid CIDR address", ["cidr", "networking"], "Use an invalid CIDR block (e.g., 10.0.0.0/33, 999.0.0.0/8)"),
    ("SEMANTIC", "invalid_region", "low", HCL_FORMATS, "Error: Invalid AWS Region", ["provider", "region"], "Specify a non-existent AWS/Azure/GCP region"),
    ("DEPENDENCY", "circular_dependency", "high", HCL_FORMATS, "Error: Cycle", ["cycle", "dependency"], "Create a circular reference between two resources via depends_on or expressions"),
    ("DEPENDENCY", "missing_depends_on", "high", HCL_FORMATS, "Error: Reference to undeclared resource", ["dependency"], "Remove an implicit dependency, causing ordering issues at plan time"),
    ("PROVIDER", "missing_provider", "medium", HCL_FORMATS, "Error: Failed to query available provider packages", ["provider"], "Remove the required_providers block or provider configuration"),
    ("PROVIDER", "version_constraint_mismatch", "low", HCL_FORMATS, "Error: Failed to query available provider packages", ["provider", "version"], "Set an impossible provider version constraint (e.g., >= 99.0)"),
    ("SECURITY", "overly_permissive_security_group", "high", HCL_FORMATS, "Warning: Security group rule allows ingress from 0.0.0.0/0", ["aws", "networking", "security-group"], "Open a security group to 0.0.0.0/0 on all ports"),
    ("SECURITY", "missing_encryption", "high", HCL_FORMATS, "Warning: Resource missing encryption configuration", ["compliance", "encryption"], "Remove encryption configuration from S3 bucket, EBS volume, or RDS instance"),
    ("CROSS_RESOURCE", "subnet_vpc_mismatch", "high", HCL_FORMATS, "Error: InvalidSubnet", ["aws", "networking", "vpc"], "Reference a subnet that belongs to a different VPC than expected"),
    ("CROSS_RESOURCE", "wrong_az_reference", "high", HCL_FORMATS, "Error: InvalidParameterValue: Invalid availability zone", ["availability-zone", "aws"], "Use an availability zone that doesn't match the subnet or region"),
    ("SYNTACTIC", "invalid_yaml", "low", TEMPLATE_FORMATS, "E0000 Template is not valid YAML", ["parse-error", "yaml"], "Introduce invalid YAML syntax (bad indentation, missing colon, tab characters)"),
    ("SYNTACTIC", "wrong_property_type", "low", TEMPLATE_FORMATS, "E3012 Property value is not of type", ["type-mismatch"], "Set a property to the wrong type (e.g., string where list expected)"),
    ("SYNTACTIC", "missing_required_property", "low", TEMPLATE_FORMATS, "E3003 Property required but missing", ["required-field"], "Remove a required property from a resource (e.g., ImageId from AWS::EC2::Instance)"),
    ("SYNTACTIC", "invalid_json_template", "low", TEMPLATE_FORMATS, "E0000 Template is not valid JSON", ["json", "parse-error"], "For JSON templates: trailing comma, missing quote, unescaped character"),
    ("REFERENCE", "broken_ref", "medium", TEMPLATE_FORMATS, "E3012 Ref to resource that does not exist", ["ref", "reference"], "Use !Ref to a logical ID that doesn't exist in the template"),
    ("REFERENCE", "bad_getatt", "medium", TEMPLATE_FORMATS, "E3012 GetAtt attribute does not exist", ["getatt", "reference"], "Use !GetAtt with wrong resource name or non-existent attribute"),
    ("REFERENCE", "undefined_parameter", "medium", TEMPLATE_FORMATS, "E3012 Ref to parameter that does not exist", ["parameter", "reference"], "Reference a parameter in Resources that isn't defined in Parameters section"),
    ("SEMANTIC", "cf_invalid_resource_type", "medium", TEMPLATE_FORMATS, "E3001 Invalid or unsupported Type", ["resource-type"], "Use a non-existent resource type (e.g., AWS::EC2::VirtualMachine instead of AWS::EC2::Instance)"),
    ("SEMANTIC", "wrong_property_value", "medium", TEMPLATE_FORMATS, "E3030 Invalid value for AllowedValues", ["property-value"], "Set a property to an invalid value (e.g., InstanceType: 'x1.super' which doesn't exist)"),
    ("SEMANTIC", "cf_bad_ami", "medium", TEMPLATE_FORMATS, "E3031 Invalid AMI ID format", ["ami", "aws"], "Use an invalid AMI ID format in ImageId property"),
    ("DEPENDENCY", "circular_depends_on", "high", TEMPLATE_FORMATS, "E3004 Circular dependency between resources", ["cycle", "dependency"], "Create a circular DependsOn chain between resources"),
    ("DEPENDENCY", "missing_dependency", "high", TEMPLATE_FORMATS, "Resource creation failed due to missing dependency", ["dependency"], "Remove DependsOn where ordering is critical, causing deploy-time failure"),
    ("INTRINSIC", "malformed_sub", "medium", TEMPLATE_FORMATS, "E1029 Sub variable not found", ["intrinsic", "sub"], "Break !Sub syntax (e.g., unclosed ${, reference non-existent variable in substitution)"),
    ("INTRINSIC", "wrong_select_index", "medium", TEMPLATE_FORMATS, "E1028 Select index out of range", ["intrinsic", "select"], "Use !Select with an index that exceeds the list length"),
    ("INTRINSIC", "bad_if_condition", "medium", TEMPLATE_FORMATS, "E8005 Condition not defined", ["condition", "intrinsic"], "Use !If with a condition name not defined in the Conditions section"),
    ("INTRINSIC", "invalid_join", "medium", TEMPLATE_FORMATS, "E1022 Invalid Join declaration", ["intrinsic", "join"], "Break !Join syntax (e.g., wrong number of arguments, non-list second argument)"),
    ("SECURITY", "open_ingress", "high", TEMPLATE_FORMATS, "W2509 Security Group ingress open to 0.0.0.0/0", ["aws", "networking", "security-group"], "Set security group ingress to 0.0.0.0/0 on all ports"),
    ("SECURITY", "cf_missing_encryption", "high", TEMPLATE_FORMATS, "W2511 Resource missing encryption configuration", ["compliance", "encryption"], "Remove server-side encryption from S3 bucket or RDS storage"),
]

# Category order.
CATEGORIES = ["SYNTACTIC", "REFERENCE", "SEMANTIC", "DEPENDENCY", "PROVIDER", "SECURITY", "CROSS_RESOURCE", "INTRINSIC"]

FAULT_SCHEMA = (
    "ord int, fault_id string, category string, name string, severity string, "
    "formats array<string>, example_error string, tags array<string>, description string"
)


def fault_dim(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """All faults. A later row with a known id replaces the earlier one but keeps its place."""
    rows: dict[str, tuple] = {}
    for category, name, severity, formats, error, tags, description in [*FAULTS, *extra]:
        key = f"{category}.{name}"
        order = rows[key][0] if key in rows else len(rows)
        rows[key] = (order, key, category, name, severity, formats, error, tags, description)
    return spark.createDataFrame(list(rows.values()), FAULT_SCHEMA)


def by_id(faults: DataFrame, fault_id: str) -> DataFrame:
    return faults.filter(F.col("fault_id") == fault_id)


def by_category(faults: DataFrame, category: str) -> DataFrame:
    return faults.filter(F.col("category") == category).orderBy("ord")


def by_format(faults: DataFrame, fmt: str) -> DataFrame:
    return faults.filter(F.array_contains("formats", fmt)).orderBy("ord")


def category_of(fault_id: Column | str) -> Column:
    """Text before the first dot; the whole id when there is none."""
    return F.substring_index(fault_id, ".", 1)


def taxonomy_listing(faults: DataFrame) -> DataFrame:
    """Faults by category name and severity text, each with the size of its category."""
    per_category = faults.groupBy("category").agg(F.count("*").alias("category_count"))
    place = F.row_number().over(Window.orderBy("category", "severity", "ord"))
    return faults.join(F.broadcast(per_category), "category").select(
        place.alias("pos"), "fault_id", "category", "severity",
        F.array_join("formats", ", ").alias("formats"), "description", "category_count",
    )


def applicability_join(configs: DataFrame, faults: DataFrame) -> DataFrame:
    """Every config with every fault of its format; configs of unknown format yield nothing.

    `faults` is the taxonomy, never data, so its size is fixed and it is broadcast.
    """
    per_format = faults.withColumn("format", F.explode("formats")).drop("formats")
    return configs.join(F.broadcast(per_format), "format")


def stratified_faults(faults: DataFrame, n: int) -> DataFrame:
    """n faults per format, taken round-robin over the categories in first-appearance order."""
    per_format = faults.withColumn("format", F.explode("formats")).drop("formats")
    group = Window.partitionBy("format", "category")
    rounds = F.row_number().over(group.orderBy("ord"))
    first_seen = F.min("ord").over(group)
    turn = F.row_number().over(Window.partitionBy("format").orderBy("round", "category_ord"))
    return (
        per_format.withColumn("round", rounds)
        .withColumn("category_ord", first_seen)
        .withColumn("turn", turn)
        .filter(F.col("turn") <= n)
    )


def stratified_ids(fmt: str, n: int) -> list[str]:
    """The same choice as plain ids, for naming the faults to inject."""
    groups: dict[str, list[str]] = {}
    for category, name, _, formats, *_rest in FAULTS:
        if fmt in formats:
            groups.setdefault(category, []).append(f"{category}.{name}")
    rounds = zip_longest(*groups.values())
    return [i for one in rounds for i in one if i is not None][:n]


def agentic_targets(configs: DataFrame, selected: DataFrame, n_agent: int) -> DataFrame:
    """Per config, the first selected fault of each of up to n distinct categories."""
    group = Window.partitionBy("format", "category")
    head = (
        selected.withColumn("head", F.row_number().over(group.orderBy("ord")))
        .filter(F.col("head") == 1)
        .withColumn("slot", F.row_number().over(Window.partitionBy("format").orderBy("category_ord")))
        .filter(F.col("slot") <= n_agent)
        .select("format", "fault_id", "category", "slot")
    )
    return configs.join(F.broadcast(head), "format")
