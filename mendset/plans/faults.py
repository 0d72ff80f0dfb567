"""Registered queries: the 37 faults and the injection driver."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.functions.draws import pick
from mendset.operators import checks, faults_hcl, faults_template
from mendset.operators.edits import Document
from mendset.operators.inject import (
    HCL_FAULTS,
    TEMPLATE_FAULTS,
    attempt_loop,
    break_verdict,
    edits_of,
    inject,
    prepare,
    trusted_errors,
)
from mendset.operators.structure_hcl import variable_refs
from mendset.operators.taxonomy import fault_dim
from mendset.plans.base import (
    ATTRS,
    BLOCKS,
    CONFIGS,
    HCL,
    QUERIES,
    SQL,
    TPL,
    draw_sql,
    kth_match,
    query,
    quote,
    taxonomy_sql,
)
from mendset.sources.rendered import configs, hcl_configs, template_configs


def part_rows(edits: DataFrame) -> DataFrame:
    rows = edits.select(
        "doc_id", F.posexplode("parts").alias("part", "p"), "description", F.md5("broken").alias("broken_hash")
    )
    return rows.select(
        "doc_id", F.col("part").cast("bigint").alias("part"), F.col("p.start").cast("bigint").alias("edit_start"),
        F.col("p.end").cast("bigint").alias("edit_end"), F.col("p.replacement").alias("replacement"),
        "description", "broken_hash",
    )


def _register(fault_id: str, family: str) -> None:
    source = hcl_configs if family == "hcl" else template_configs
    QUERIES[fault_id] = lambda spark, sf_dir: part_rows(edits_of(source(spark, sf_dir), family, [fault_id]))


for _f in HCL_FAULTS:
    _register(_f, "hcl")
for _f in TEMPLATE_FAULTS:
    _register(_f, "template")


def one_part(ctes: str, edits: str) -> str:
    """`edits` selects doc_id, text, s (0-based), n (length cut), r (replacement), d (description)."""
    return f"""WITH {ctes}, e AS ({edits})
SELECT doc_id, 0::BIGINT AS part, s::BIGINT AS edit_start, (s + n)::BIGINT AS edit_end, r AS replacement,
       d AS description, md5(substr(text, 1, s) || r || substr(text, s + n + 1)) AS broken_hash
FROM e WHERE substr(text, s + 1, n) <> r"""


def two_parts(ctes: str, edits: str) -> str:
    """`edits` selects doc_id, text, s1, n1, r1, s2, n2, r2, d with the first part left of the second."""
    return f"""WITH {ctes}, e AS ({edits}),
b AS (SELECT *, md5(substr(text, 1, s1) || r1 || substr(text, s1 + n1 + 1, s2 - s1 - n1) || r2 || substr(text, s2 + n2 + 1)) AS h FROM e)
SELECT doc_id, 0::BIGINT AS part, s1::BIGINT AS edit_start, (s1 + n1)::BIGINT AS edit_end, r1 AS replacement, d AS description, h AS broken_hash FROM b
UNION ALL SELECT doc_id, 1::BIGINT, s2::BIGINT, (s2 + n2)::BIGINT, r2, d, h FROM b"""


def first_group(ctes: str, table: str, pattern: str, replacement: str, description: str) -> str:
    """First match of a pattern with groups (prefix)(value)."""
    return one_part(
        f"""{ctes}, m AS (SELECT doc_id, text, regexp_extract(text, '{pattern}', 0) AS m0,
  regexp_extract(text, '{pattern}', 1) AS g1, regexp_extract(text, '{pattern}', 2) AS g2
  FROM {table} WHERE regexp_matches(text, '{pattern}'))""",
        f"SELECT doc_id, text, instr(text, m0) - 1 + length(g1) AS s, length(g2) AS n, {replacement} AS r, {description} AS d FROM m",
    )


def drawn_block(fault_id: str) -> str:
    return f"SELECT * FROM blocks WHERE i = {draw_sql(fault_id)} % n"


def case_map(key: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {default} END"


def in_pairs(a: str, b: str, mapping: dict[str, list[str]]) -> str:
    pairs = [f"({quote(k)}, {quote(v)})" for k, vs in mapping.items() for v in vs]
    return f"({a}, {b}) IN ({', '.join(pairs)})"


_F = "SYNTACTIC.missing_closing_brace"
SQL[_F] = one_part(
    BLOCKS,
    f"SELECT doc_id, text, e - 1 AS s, 1 AS n, '' AS r, 'Removed closing brace from resource ' || type || '.' || name AS d FROM ({drawn_block(_F)})",
)
_F = "SYNTACTIC.wrong_attribute_type"
SQL[_F] = one_part(
    ATTRS,
    rf"""SELECT doc_id, text, start + instr(line, g) - 1 + length(g) - length(v) AS s, length(v) AS n,
      CASE WHEN is_number THEN '"' || attr || '_value"' ELSE '"yes"' END AS r,
      CASE WHEN is_number THEN 'Changed numeric value to string for ' ELSE 'Changed boolean to string for ' END || attr AS d
    FROM (SELECT *, regexp_extract(g, '(\d+|true|false)$', 1) AS v FROM (
      SELECT *, regexp_matches(line, '=\s*\d+') AS is_number,
        CASE WHEN regexp_matches(line, '=\s*\d+') THEN regexp_extract(line, '=\s*\d+', 0) ELSE regexp_extract(line, '=\s*(true|false)', 0) END AS g,
        row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS k
      FROM attrs WHERE i = {draw_sql(_F)} % n AND regexp_matches(line, '=\s*(\d+|true|false)'))) WHERE k = 1""",
)
_F = "SYNTACTIC.invalid_hcl_syntax"
SQL[_F] = one_part(
    ATTRS,
    rf"""SELECT doc_id, text, start + instr(line, regexp_extract(line, '\s*=\s*', 0)) - 1 AS s,
      length(regexp_extract(line, '\s*=\s*', 0)) AS n, ' ' AS r, 'Removed equals sign from attribute ' || attr AS d
    FROM attrs WHERE i = {draw_sql(_F)} % n AND a = 1 + {draw_sql(_F, "'attribute'")} % n_attrs""",
)
_F = "SYNTACTIC.missing_required_argument"
SQL[_F] = one_part(
    ATTRS,
    f"""SELECT doc_id, text, start AS s, length(line) + 1 AS n, '' AS r,
      'Removed required argument ''' || attr || ''' from ' || type || '.' || block AS d
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {draw_sql(_F, "i::VARCHAR")}, i, j) AS k
          FROM attrs WHERE {in_pairs("type", "attr", faults_hcl.REQUIRED_ARGUMENTS)}) WHERE k = 1""",
)
_F = "REFERENCE.undefined_variable"
_P = r"var\.\w+"
_K = f"1 + {draw_sql(_F)} % len(regexp_extract_all(text, '{_P}', 0))"
SQL[_F] = one_part(
    HCL,
    f"""SELECT doc_id, text, {kth_match(_P, "k")} AS s, length(v) AS n, v || '_undefined' AS r,
      'Changed variable reference from ' || v || ' to ' || v || '_undefined' AS d
    FROM (SELECT *, regexp_extract_all(text, '{_P}', 0)[k] AS v FROM (SELECT *, {_K} AS k FROM hcl WHERE regexp_matches(text, '{_P}')))""",
)
_F = "REFERENCE.bad_resource_reference"
_P = r"aws_\w+\.\w+\.\w+"
_K = f"1 + {draw_sql(_F)} % len(regexp_extract_all(text, '{_P}', 0))"
SQL[_F] = one_part(
    HCL,
    rf"""SELECT doc_id, text, {kth_match(_P, "k")} AS s, length(v) AS n, v || '_typo' AS r,
      'Misspelled resource reference from ' || v || ' to ' || v || '_typo' AS d
    FROM (SELECT *, regexp_extract(regexp_extract_all(text, '{_P}', 0)[k], '^\w+\.\w+', 0) AS v
          FROM (SELECT *, {_K} AS k FROM hcl WHERE regexp_matches(text, '{_P}')))""",
)
_F = "REFERENCE.broken_module_source"
SQL[_F] = first_group(
    HCL, "hcl", r'(module "net" \{\n  source = )("[^"]*")', f"'\"{faults_hcl.BAD_MODULE}\"'",
    "'Changed module source to non-existent path'",
)
_F = "SEMANTIC.invalid_resource_type"
_R = case_map("type", faults_hcl.TYPE_TYPOS, "type || '_invalid'")
SQL[_F] = one_part(
    BLOCKS,
    f"SELECT doc_id, text, s + 10 AS s, length(type) AS n, {_R} AS r, 'Changed resource type from ' || type || ' to ' || {_R} AS d FROM ({drawn_block(_F)})",
)
SQL["SEMANTIC.bad_ami_format"] = first_group(
    HCL, "hcl", r'(ami\s*=\s*")(ami-[0-9a-f]+)', quote(faults_hcl.BAD_AMI),
    f"'Corrupted AMI ID from ' || g2 || ' to {faults_hcl.BAD_AMI}'",
)
SQL["SEMANTIC.invalid_cidr"] = first_group(
    HCL, "hcl", r'(")(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d{1,2})"', quote(faults_hcl.BAD_CIDR),
    f"'Changed CIDR from ' || g2 || ' to {faults_hcl.BAD_CIDR}'",
)
SQL["SEMANTIC.invalid_region"] = first_group(
    HCL, "hcl", r'(region\s*=\s*")([\w-]+)"', quote(faults_hcl.BAD_REGION),
    f"'Changed region from ' || g2 || ' to {faults_hcl.BAD_REGION}'",
)
SQL["DEPENDENCY.circular_dependency"] = two_parts(
    BLOCKS,
    """SELECT a.doc_id, a.text, a.e - 1 AS s1, 0 AS n1, chr(10) || '  depends_on = [' || b.type || '.' || b.name || ']' || chr(10) AS r1,
      b.e - 1 AS s2, 0 AS n2, chr(10) || '  depends_on = [' || a.type || '.' || a.name || ']' || chr(10) AS r2,
      'Added circular dependency between ' || a.name || ' and ' || b.name AS d
    FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.i = 0 AND b.i = 1""",
)
SQL["DEPENDENCY.missing_depends_on"] = first_group(
    HCL, "hcl", r"()(\n[ \t]*depends_on\s*=\s*\[[^\]]*\])", "''", "'Removed depends_on declaration'"
)
SQL["PROVIDER.missing_provider"] = one_part(
    HCL
    + r""", m AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?m)^terraform \{') THEN regexp_extract(text, '(?m)^terraform \{\n(?:  [^\n]*\n)*\}', 0)
      ELSE regexp_extract(text, '(?m)^provider "aws" \{\n(?:  [^\n]*\n)*\}', 0) END AS v FROM hcl)""",
    """SELECT doc_id, text, instr(text, v) - 1 AS s, length(v) AS n, '' AS r,
      CASE WHEN starts_with(v, 'terraform') THEN 'Removed terraform/required_providers block' ELSE 'Removed provider configuration block' END AS d
    FROM m WHERE v <> ''""",
)
SQL["PROVIDER.version_constraint_mismatch"] = first_group(
    HCL, "hcl", r'(version\s*=\s*")([^"]*)"', quote(faults_hcl.BAD_VERSION),
    f"'Changed version constraint to impossible range: {faults_hcl.BAD_VERSION}'",
)
SQL["SECURITY.overly_permissive_security_group"] = one_part(
    BLOCKS,
    f"""SELECT doc_id, text, e - 1 AS s, 0 AS n, {quote(faults_hcl.OPEN_INGRESS)} || chr(10) AS r,
      'Added overly permissive ingress rule (0.0.0.0/0 all TCP ports)' AS d
    FROM blocks WHERE type = 'aws_security_group' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1""",
)
SQL["SECURITY.missing_encryption"] = first_group(
    HCL, "hcl", r"()(\n[ \t]*encrypted\s*=\s*true)", "''", "'Removed encrypted = true'"
)
SQL["CROSS_RESOURCE.subnet_vpc_mismatch"] = first_group(
    HCL, "hcl", r"(vpc_id\s*=\s*)(\S+)", "'\"vpc-00000000\"'",
    r"'Replaced ' || regexp_replace(g1, '\s+$', '') || ' reference with hardcoded invalid ID'",
)
_F = "CROSS_RESOURCE.wrong_az_reference"
_R = "[" + ", ".join(quote(z) for z in faults_hcl.WRONG_ZONES) + f"][1 + {draw_sql(_F)} % 3]"
SQL[_F] = first_group(
    HCL, "hcl", r'(availability_zone\s*=\s*")([\w-]+)"', _R, f"'Changed availability zone from ' || g2 || ' to ' || {_R}"
)

# ---- templates. The rendered texts have two shapes, so the expected edits are written per shape.

IS_JSON = "starts_with(text, '{')"
TLINES = (
    TPL
    + """, lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM tpl),
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines)"""
)


def drawn_line(fault_id: str, keep: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n_kept
      FROM placed WHERE {keep}) WHERE k = {draw_sql(fault_id)} % n_kept"""


_F = "SYNTACTIC.invalid_yaml"
SQL[_F] = one_part(
    TLINES,
    rf"""SELECT doc_id, text, start AS s, length(line) - length(ltrim(line)) AS n, chr(9) AS r, 'Inserted tab character in YAML indentation' AS d
    FROM ({drawn_line(_F, f"NOT {IS_JSON} AND contains(line, ':') AND NOT starts_with(ltrim(line), '#')")})""",
)
_F = "SYNTACTIC.invalid_json_template"
_KEEP = IS_JSON + " AND right(rtrim(line), 1) IN ('}', '\"')"
SQL[_F] = one_part(
    TLINES,
    f"""SELECT doc_id, text, start + length(line) AS s, 0 AS n, ',' AS r, 'Added trailing comma to create invalid JSON' AS d
    FROM ({drawn_line(_F, _KEEP)})""",
)


def by_shape(json_pattern: str, yaml_pattern: str, json_r: str, yaml_r: str, json_d: str, yaml_d: str) -> str:
    """First match per shape; groups (prefix)(value)."""

    def half(cond, pattern, r, d):
        return f"""SELECT doc_id, text, instr(text, m0) - 1 + length(g1) AS s, length(g2) AS n, {r} AS r, {d} AS d FROM (
          SELECT doc_id, text, regexp_extract(text, '{pattern}', 0) AS m0, regexp_extract(text, '{pattern}', 1) AS g1,
            regexp_extract(text, '{pattern}', 2) AS g2, regexp_extract(text, '{pattern}', 3) AS g3 FROM tpl WHERE {cond} AND regexp_matches(text, '{pattern}'))"""

    parts = []
    if json_pattern:
        parts.append(half(IS_JSON, json_pattern, json_r, json_d))
    if yaml_pattern:
        parts.append(half(f"NOT {IS_JSON}", yaml_pattern, yaml_r, yaml_d))
    return one_part(TPL, " UNION ALL ".join(parts))


SQL["SYNTACTIC.wrong_property_type"] = by_shape(
    r'("Tags": )(\[[^\]]*\])()', r'(Tags:\n        )(- Key: Name\n          Value: [^\n]*)()', "'\"not-a-list\"'", "'not-a-list'",
    "'Changed list property Tags to string'", "'Changed list property Tags to string'",
)
SQL["SYNTACTIC.missing_required_property"] = by_shape(
    r'(AWS::EC2::VPC",\n      "Properties": )(\{[^}]*\})()', r"(AWS::EC2::VPC\n    Properties:\n)(      CidrBlock: [^\n]*\n)()", "'{}'", "''",
    "'Removed required property ''CidrBlock'' from AWS::EC2::VPC'", "'Removed required property ''CidrBlock'' from AWS::EC2::VPC'",
)


def drawn_match(fault_id: str, pattern: str, value: str, suffix: str, description: str, keep: str = "true") -> str:
    """Draw one of the matches; `value` extracts the part to change from the match."""
    hits = f"regexp_extract_all(text, '{pattern}', 0)"
    return one_part(
        TPL,
        f"""SELECT doc_id, text, {kth_match(pattern, "k")} + instr(m, v) - 1 AS s, length(v) AS n, {suffix} AS r, {description} AS d
    FROM (SELECT *, regexp_extract(m, '{value}', 1) AS v FROM (SELECT *, {hits}[k] AS m FROM (
      SELECT *, 1 + {draw_sql(fault_id)} % len({hits}) AS k FROM tpl WHERE regexp_matches(text, '{pattern}') AND {keep})))""",
    )


_REF = r'!Ref \w+|"Ref": "\w+"'
SQL["REFERENCE.broken_ref"] = drawn_match(
    "REFERENCE.broken_ref", _REF, r'(\w+|"\w+")$',
    """CASE WHEN starts_with(v, '"') THEN '"' || trim(v, '"') || 'Nonexistent"' ELSE v || 'Nonexistent' END""",
    """'Changed Ref target from ' || trim(v, '"') || ' to ' || trim(v, '"') || 'Nonexistent'""",
)
SQL["REFERENCE.bad_getatt"] = drawn_match(
    "REFERENCE.bad_getatt", r'!GetAtt \w+\.\w+|"Fn::GetAtt": \["\w+", "\w+"\]', r'(?:!GetAtt |\[)(\w+\.\w+|"\w+")',
    """CASE WHEN starts_with(v, '"') THEN '"' || trim(v, '"') || 'Broken"' ELSE replace(v, '.', 'Broken.') END""",
    "'Corrupted GetAtt resource reference'",
)
_F = "REFERENCE.undefined_parameter"
_P = r"!Ref (?:StackEnv|NodeType)\b"
SQL[_F] = one_part(
    TPL,
    rf"""SELECT doc_id, text, CASE WHEN refs = ['StackEnv'] OR pick = 'StackEnv' THEN instr(text, '  StackEnv:') - 1 ELSE instr(text, '  NodeType:') - 1 END AS s,
      length(CASE WHEN pick = 'StackEnv' THEN regexp_extract(text, '  StackEnv:\n(?:    [^\n]*\n)*', 0) ELSE regexp_extract(text, '  NodeType:\n(?:    [^\n]*\n)*', 0) END) AS n,
      '' AS r, 'Removed parameter ''' || pick || ''' that is referenced in Resources' AS d
    FROM (SELECT *, refs[1 + {draw_sql(_F)} % len(refs)] AS pick FROM (SELECT *, regexp_extract_all(text, '!Ref (StackEnv|NodeType)\b', 1) AS refs FROM tpl WHERE NOT {IS_JSON}))""",
)
SQL["SEMANTIC.cf_invalid_resource_type"] = by_shape(
    r'("Type": )("AWS::EC2::VPC")()', r"(Type: )(AWS::EC2::VPC)()", "'\"AWS::EC2::VirtualPrivateCloud\"'", "'AWS::EC2::VirtualPrivateCloud'",
    "'Changed resource type from AWS::EC2::VPC to AWS::EC2::VirtualPrivateCloud'", "'Changed resource type from AWS::EC2::VPC to AWS::EC2::VirtualPrivateCloud'",
)
_D = "'Changed InstanceType to invalid value ''x1.superlarge'''"
SQL["SEMANTIC.wrong_property_value"] = by_shape(
    r'("InstanceType": )("[^"]*")()', r"(InstanceType: )(t3[^\n]*)()", "'\"x1.superlarge\"'", "'x1.superlarge'", _D, _D
)
SQL["SEMANTIC.cf_bad_ami"] = by_shape(
    r'("ImageId": )("[^"]*")()', r"(ImageId: )(ami-[^\n]*)()", f"'\"{faults_template.BAD_AMI}\"'", quote(faults_template.BAD_AMI),
    "'Corrupted AMI ID from ' || trim(g2, '\"') || ' to INVALID-ami-format'", "'Corrupted AMI ID from ' || g2 || ' to INVALID-ami-format'",
)
SQL["DEPENDENCY.circular_depends_on"] = two_parts(
    TPL,
    f"""SELECT doc_id, text, instr(text, '"Network": {{') + 11 AS s1, 0 AS n1, '"DependsOn": ["Queue"], ' AS r1,
      instr(text, '"DependsOn": "Network"') + 12 AS s2, 9 AS n2, '["Network"]' AS r2, 'Created circular DependsOn between Network and Queue' AS d FROM tpl WHERE {IS_JSON}
    UNION ALL SELECT doc_id, text, instr(text, '    Type: AWS::EC2::VPC') + 3, 0, 'DependsOn: [Subnet]' || chr(10) || '    ',
      CASE WHEN contains(text, '    DependsOn: Network') THEN instr(text, 'DependsOn: Network') + 10 ELSE instr(text, '    Type: AWS::EC2::Subnet') + 3 END,
      CASE WHEN contains(text, '    DependsOn: Network') THEN 7 ELSE 0 END,
      CASE WHEN contains(text, '    DependsOn: Network') THEN '[Network]' ELSE 'DependsOn: [Network]' || chr(10) || '    ' END,
      'Created circular DependsOn between Network and Subnet' FROM tpl WHERE NOT {IS_JSON}""",
)
SQL["DEPENDENCY.missing_dependency"] = by_shape(
    r'()("DependsOn": "Network",\n      )()', r"()(    DependsOn: Network\n)()", "''", "''",
    "'Removed DependsOn from Queue'", "'Removed DependsOn from Subnet'",
)
_D = "'Added unclosed variable reference in !Sub'"
SQL["INTRINSIC.malformed_sub"] = by_shape(
    r'("Fn::Sub": "[^"]*)()(")', r'(!Sub "[^"]*)()(")', "' ${UndefinedVar'", "' ${UndefinedVar'", _D, _D
)
SQL["INTRINSIC.wrong_select_index"] = by_shape(
    "", r"(!Select \[)(0)()", "", "'999'", "", "'Set !Select index to 999 (out of bounds)'"
)
SQL["INTRINSIC.bad_if_condition"] = by_shape(
    "", r"(!If \[)(IsLive)()", "", "'NonExistentCondition'", "", "'Changed !If condition from ''IsLive'' to ''NonExistentCondition'''"
)
SQL["INTRINSIC.invalid_join"] = by_shape(
    "", r"(!Join )(\[[^\n]*)()", "", "'invalid-join-not-a-list'", "",
    "'Changed !Join value to invalid string (should be [delimiter, list])'",
)
_RULE = textwrap.indent("\n".join(f"{'- ' if i == 0 else '  '}{k}: {v}" for i, (k, v) in enumerate(faults_template.OPEN_RULE)), " " * 8)
SQL["SECURITY.open_ingress"] = by_shape(
    "", r"(SecurityGroupIngress:\n(?:        [^\n]*\n)*?          CidrIp: [^\n]*)()()", "", f"chr(10) || {quote(_RULE)}", "",
    "'Added overly permissive ingress rule to Guard'",
)
SQL["SECURITY.cf_missing_encryption"] = by_shape(
    "", r"()(      BucketEncryption:\n(?:        [^\n]*\n)*)()", "", "''", "", "'Removed encryption property ''BucketEncryption'' from AWS::S3::Bucket'"
)


# ---- the driver

def both_formats(spark, sf_dir) -> DataFrame:
    """Every order in both renderings; doc_id and format together name a config."""
    hcl = hcl_configs(spark, sf_dir).select("doc_id", "text", F.lit("terraform").alias("format"))
    return hcl.unionAll(template_configs(spark, sf_dir).select("doc_id", "text", F.lit("cloudformation").alias("format")))


def _broken_by(fault_id: str, fmt: str) -> str:
    return f"SELECT doc_id, '{fmt}' AS format, '{fault_id}' AS fault_id, broken_hash FROM ({SQL[fault_id]}) WHERE part = 0"


#: (doc_id, format, fault_id, broken_hash) of all faults, from the SQL of each.
ALL_BROKEN = "\nUNION ALL ".join(
    _broken_by(f, fmt) for fmt, names in (("terraform", HCL_FAULTS), ("cloudformation", TEMPLATE_FAULTS)) for f in names
)


@query("inject", ALL_BROKEN)
def inject_query(spark, sf_dir):
    """All 37 faults on every config of their format."""
    rows = inject(both_formats(spark, sf_dir))
    return rows.select("doc_id", "format", "fault_id", F.md5("broken").alias("broken_hash"))


_F = "REFERENCE.undefined_variable"


@query(
    "random_pick",
    rf"""WITH {HCL}, refs AS (SELECT doc_id, text, regexp_extract_all(text, 'var\.(\w+)', 0) AS all_refs FROM hcl)
SELECT doc_id, len(all_refs)::BIGINT AS candidates, {kth_match(r"var\.\w+", f"1 + {draw_sql(_F)} % len(all_refs)")} AS chosen_start FROM refs""",
)
def random_pick(spark, sf_dir):
    refs = variable_refs(F.col("text"))
    chosen = pick(refs, Document().draw(_F))
    return hcl_configs(spark, sf_dir).select(
        "doc_id", F.size(refs).cast("bigint").alias("candidates"), chosen["start"].cast("bigint").alias("chosen_start")
    )


@query(
    "attempt_loop",
    f"""WITH {BLOCKS}, tries AS (SELECT b.doc_id, t.attempts, b.type || '.' || b.name AS target FROM blocks b,
  (VALUES (1, ''), (2, '1'), (3, '2')) t(attempts, salt) WHERE b.i = {draw_sql("SYNTACTIC.missing_closing_brace", salt="t.salt", doc="b.doc_id")} % b.n)
SELECT doc_id, min(attempts)::BIGINT AS attempts, arg_min(target, attempts) AS target FROM tries
WHERE starts_with(target, 'aws_instance') GROUP BY doc_id""",
)
def attempt_loop_query(spark, sf_dir):
    hit = "resource \"aws_instance"
    won = attempt_loop(
        hcl_configs(spark, sf_dir), "hcl", ["SYNTACTIC.missing_closing_brace"],
        accept=lambda e: e["location"].startswith(hit),
    )
    target = F.regexp_replace("location", r'^resource "([^"]+)" "([^"]+)"$', "$1.$2")
    return won.select("doc_id", F.col("attempts").cast("bigint").alias("attempts"), target.alias("target"))


@query(
    "trusted_errors",
    f"""WITH {CONFIGS}, {taxonomy_sql()}
SELECT c.doc_id, f.fault_id, CASE WHEN f.example_error = '' THEN 'Injected ' || f.fault_id ELSE f.example_error END AS error
FROM configs c JOIN faults f ON list_contains(string_split(f.formats, ','), c.format)""",
)
def trusted_errors_query(spark, sf_dir):
    from mendset.operators.taxonomy import applicability_join

    pairs = applicability_join(configs(spark, sf_dir).select("doc_id", "format"), fault_dim(spark))
    error = trusted_errors(F.col("fault_id"), F.col("example_error"))[0]
    return pairs.select("doc_id", "fault_id", error.alias("error"))


@query(
    "break_verdict",
    rf"""WITH {HCL}, v AS (
  SELECT doc_id, 'SEMANTIC.invalid_region' AS fault_id, true AS accepted FROM hcl WHERE contains(text, 'region = "')
  UNION ALL SELECT doc_id, 'SECURITY.overly_permissive_security_group', true FROM hcl WHERE contains(text, '"aws_security_group"')
  UNION ALL SELECT doc_id, 'DEPENDENCY.missing_depends_on', NOT contains(text, 'provider "aws"') FROM hcl WHERE contains(text, 'depends_on'))
SELECT * FROM v""",
)
def break_verdict_query(spark, sf_dir):
    """Verdicts of gold and broken texts by the static checks, then the acceptance rule.

    A config without a provider block is invalid before the edit, so any edit of it counts as a break.
    """
    from mendset.operators.validation import rule_code_split

    names = ["SEMANTIC.invalid_region", "SECURITY.overly_permissive_security_group", "DEPENDENCY.missing_depends_on"]
    gold = hcl_configs(spark, sf_dir)
    verdict = lambda: rule_code_split(checks.hcl_findings(F.col("text"), F.col("resource_spans")))
    golds = prepare(gold, "hcl").select("*", verdict().alias("gold_verdict")).drop("resource_spans")
    edits = edits_of(golds, "hcl", names)
    broken = edits.select("doc_id", "fault_id", "gold_verdict", F.col("broken").alias("text"))
    judged = prepare(broken, "hcl").select("doc_id", "fault_id", "gold_verdict", verdict().alias("v"))
    return judged.select(
        "doc_id", "fault_id",
        break_verdict(
            F.substring_index("fault_id", ".", 1), F.col("v.valid"), F.col("v.errors"),
            F.col("v.warnings"), F.col("gold_verdict.warnings"),
        ).alias("accepted"),
    )
