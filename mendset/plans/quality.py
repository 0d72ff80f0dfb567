"""Registered queries: gates for external edits, validator output, static checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.functions.text import fence_strip as strip_fences
from mendset.operators import checks, gates, validation
from mendset.operators.inject import agentic_edits, prepare
from mendset.operators.structure_hcl import resource_table
from mendset.plans.base import LINE_COUNT_SQL, BLOCKS, HCL, TPL, WHITESPACE_SQL, longs, query, table
from mendset.sources.corpus import materialized
from mendset.sources.rendered import hcl_configs, template_configs

# ---- 2.7 gates, on the turns of conversations

_RESPONSE = """CASE (conv_id + turn) % 6 WHEN 0 THEN concat('```hcl', chr(10), text, chr(10), '```', chr(10)) WHEN 1 THEN concat('  ', chr(10))
  WHEN 2 THEN concat('```', chr(10), replace(text, 'an', 'na')) WHEN 3 THEN concat(chr(9), text, chr(10)) WHEN 4 THEN substr(text, 1, 60) ELSE concat(text, chr(10), 'one more line') END"""
_TRIM = f"trim({{0}}, {WHITESPACE_SQL})"
_CLEAN = f"regexp_replace(regexp_replace({_TRIM.format('response')}, '^```[^\n]*(\n|$)', ''), '(^|\n)[ \t]*```[ \t]*$', '')"
_PAIRS = f"pairs AS (SELECT conv_id, turn, text, {_RESPONSE} AS response FROM conversations)"


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.expr(_RESPONSE).alias("response")
    )


@query("fence_strip", f"WITH {_PAIRS} SELECT conv_id, turn, md5({_CLEAN}) AS clean_hash FROM pairs")
def fence_strip(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "conv_id", "turn", F.md5(strip_fences(F.col("response"))).alias("clean_hash")
    )


@query("empty_gate", f"WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE length({_TRIM.format('response')}) > 0")
def empty_gate(spark, sf_dir):
    return gates.empty_gate(_pairs(spark, sf_dir), "response").select("conv_id", "turn")


@query("similarity_gate")
def similarity_gate(spark, sf_dir):
    kept = gates.similarity_gate(_pairs(spark, sf_dir), "text", "response")
    return kept.select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))


@query("change_ratio_gate")
def change_ratio_gate(spark, sf_dir):
    kept = gates.change_ratio_gate(_pairs(spark, sf_dir), "text", "response")
    return kept.select("conv_id", "turn", F.col("changed_lines").cast("bigint").alias("changed_lines"))


@query(
    "identity_gate",
    f"WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE {_TRIM.format('text')} <> {_TRIM.format('response')}",
)
def identity_gate(spark, sf_dir):
    return gates.identity_gate(_pairs(spark, sf_dir), "text", "response").select("conv_id", "turn")


@query(
    "line_changes",
    f"""WITH {_PAIRS}, l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, -1 AS sign FROM pairs
UNION ALL SELECT conv_id, turn, unnest(string_split(regexp_replace(response, '\n$', ''), chr(10))), 1 FROM pairs),
n AS (SELECT conv_id, turn, line, sum(sign) AS net FROM l GROUP BY ALL)
SELECT conv_id, turn, sum(greatest(net, 0))::BIGINT AS added, sum(greatest(-net, 0))::BIGINT AS removed FROM n GROUP BY ALL""",
)
def line_changes(spark, sf_dir):
    keyed = _pairs(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    rows = gates.line_changes(keyed, "key", "text", "response")
    return rows.select("key.conv_id", "key.turn", "added", "removed")


@query(
    "line_bag_gate",
    f"""WITH {_PAIRS}, l AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, -1 AS sign FROM pairs
UNION ALL SELECT conv_id, turn, unnest(string_split(regexp_replace(response, '\n$', ''), chr(10))), 1 FROM pairs),
n AS (SELECT conv_id, turn, line, abs(sum(sign)) AS net FROM l GROUP BY ALL), c AS (SELECT conv_id, turn, sum(net)::BIGINT AS changed_lines FROM n GROUP BY ALL)
SELECT c.conv_id, c.turn, changed_lines FROM c JOIN pairs p ON p.conv_id = c.conv_id AND p.turn = c.turn
WHERE changed_lines / greatest({LINE_COUNT_SQL.format(t="p.text")}, 1) <= 0.2""",
)
def line_bag_gate(spark, sf_dir):
    keyed = _pairs(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return gates.line_bag_gate(keyed, "key", "text", "response").select("key.conv_id", "key.turn", "changed_lines")


@query("agentic_edits")
def agentic_edits_query(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text", "response", F.lit("SEMANTIC").alias("category")
    )
    return agentic_edits(rows).withColumn("broken", F.md5("broken"))


# ---- 2.8 validator output

_RAW = """concat('{"valid": ', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END, ', "diagnostics": [{"severity": "', CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END,
  '", "summary": "', event_type, '", "detail": "', CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS STRING) END, '"}, {"severity": "error", "summary": "second"}]', CASE WHEN event_id % 7 = 0 THEN '' ELSE '}' END)"""


@query(
    "diagnostics_parse",
    f"""WITH e AS (SELECT *, {_RAW} AS raw, event_type || CASE WHEN event_id % 5 = 0 THEN '' ELSE ': ' || user_id END AS m FROM events)
SELECT event_id, event_id % 7 <> 0 AND event_id % 3 = 0 AS valid,
 CASE WHEN event_id % 7 = 0 THEN 'Failed to parse terraform validate output: ' || raw WHEN event_id % 2 = 0 THEN m || '|second' ELSE 'second' END AS errors,
 CASE WHEN event_id % 7 = 0 OR event_id % 2 = 0 THEN '' ELSE m END AS warnings FROM e""",
)
def diagnostics_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", validation.diagnostics_parse(F.expr(_RAW)).alias("v")
    )
    return rows.select(
        "event_id", "v.valid", F.array_join("v.errors", "|").alias("errors"), F.array_join("v.warnings", "|").alias("warnings")
    )


@query(
    "rule_code_split",
    """SELECT doc_id, n_chars % 4 <> 0 AS valid, CASE WHEN n_chars % 4 = 0 THEN 'E1 ' || source ELSE '' END AS errors,
 CASE WHEN n_chars % 3 = 0 THEN 'W1 ' || lang || '|' ELSE '' END || 'I1 info' AS warnings FROM documents""",
)
def rule_code_split(spark, sf_dir):
    def match(code, test, message):
        return F.when(test, F.struct(F.lit(code).alias("code"), message.alias("message")))

    found = F.array(
        match("W1", F.col("n_chars") % 3 == 0, F.concat(F.lit("W1 "), "lang")),
        match("E1", F.col("n_chars") % 4 == 0, F.concat(F.lit("E1 "), "source")),
        match("I1", F.lit(True), F.lit("I1 info")),
    )
    split = validation.rule_code_split(F.filter(found, lambda m: m.isNotNull()))
    rows = table(spark, sf_dir, "documents").select("doc_id", split.alias("v"))
    return rows.select(
        "doc_id", "v.valid", F.array_join("v.errors", "|").alias("errors"), F.array_join("v.warnings", "|").alias("warnings")
    )


def _verdicts(spark, sf_dir) -> DataFrame:
    """One verdict per labelled document: low quality is invalid and toxic is a warning."""
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    none = F.array().cast("array<string>")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("path"),
        F.col("lang").alias("format"),
        (F.col("quality") == 1).alias("valid"),
        F.when(F.col("quality") == 1, none).otherwise(F.array(F.lit("low quality"), F.col("source"))).alias("errors"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none).alias("warnings"),
    )


_VERDICTS = "v AS (SELECT d.doc_id AS path, d.lang AS format, d.source, l.quality = 1 AS valid, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(
    "gold_stats",
    f"""WITH {_VERDICTS} SELECT format, count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid,
 count(*) FILTER (valid)::DOUBLE / count(*) AS pass_rate FROM v GROUP BY format""",
)
def gold_stats(spark, sf_dir):
    return validation.gold_stats(_verdicts(spark, sf_dir))


@query("gold_errors", f"WITH {_VERDICTS} SELECT format, path, 'low quality|' || source AS errors FROM v WHERE NOT valid")
def gold_errors(spark, sf_dir):
    return validation.gold_errors(_verdicts(spark, sf_dir)).withColumn("errors", F.array_join("errors", "|"))


@query(
    "check_report",
    f"""WITH {_VERDICTS}, r AS (SELECT doc_id AS path FROM documents), rep AS (
SELECT r.path, CASE WHEN v.valid IS NULL THEN 'MISSING' WHEN v.valid THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN v.valid = false THEN 2 ELSE 0 END::BIGINT AS n_errors, CASE WHEN v.toxic = 1 THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM r LEFT JOIN v ON r.path = v.path)
SELECT *, (SELECT bool_or(status <> 'PASS') FROM rep) AS any_fail FROM rep""",
)
def check_report(spark, sf_dir):
    requested = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    verdicts = _verdicts(spark, sf_dir).select("path", "valid", "errors", "warnings")
    report = validation.check_report(requested, verdicts, "path")
    report = materialized(report)  # read for the rows and for the flag
    flagged = report.withColumn("any_fail", validation.any_failure(report).scalar())
    return longs(flagged, "n_errors", "n_warnings")


# ---- 2.8 static checks, on corpora with known slips put in by plain replacement


def _findings(spark, sf_dir, family: str, slip: str, rule, parsed: bool = True, reads: list[tuple] | None = None) -> DataFrame:
    source = hcl_configs if family == "hcl" else template_configs
    texts = source(spark, sf_dir).select("doc_id", F.expr(slip).alias("text"))
    found = (prepare(texts, family, reads) if parsed else texts).select("doc_id", rule().alias("found"))
    # outer: else the rule runs a second time, in a filter for empty arrays
    rows = found.select("doc_id", F.explode_outer("found").alias("f")).filter(F.col("f").isNotNull())
    return rows.select("doc_id", "f.code", "f.message")


def _blocks():
    return F.col("resource_spans")


def _nodes():
    return F.col("nodes")


_BRACES = "CASE doc_id % 4 WHEN 1 THEN replace(text, 'tags = {', 'tags = ') WHEN 2 THEN replace(text, 'cidr_block = ', 'cidr_block = { ') ELSE text END"


@query(
    "chk_braces",
    rf"""WITH {HCL}, t AS (SELECT doc_id, regexp_replace({_BRACES}, '"[^"]*"|#[^\n]*', '', 'g') AS b FROM hcl)
SELECT doc_id, 'E001' AS code, 'Unbalanced braces' AS message FROM t WHERE length(replace(b, '{{', '')) <> length(replace(b, '}}', ''))""",
)
def chk_braces(spark, sf_dir):
    return _findings(spark, sf_dir, "hcl", _BRACES, lambda: checks.braces(F.col("text")))


@query(
    "chk_undeclared_var",
    f"WITH {HCL} SELECT doc_id, 'E002' AS code, 'Undeclared variable prio' AS message FROM hcl WHERE doc_id % 3 = 0",
)
def chk_undeclared_var(spark, sf_dir):
    slip = "CASE WHEN doc_id % 3 = 0 THEN replace(text, '= var.priority', '= var.prio') ELSE text END"
    return _findings(spark, sf_dir, "hcl", slip, lambda: checks.undeclared_var(F.col("text")))


@query(
    "chk_undeclared_resource",
    f"WITH {HCL} SELECT doc_id, 'E003' AS code, 'Undeclared resource aws_subnet.mian' AS message FROM hcl WHERE doc_id % 4 = 2",
)
def chk_undeclared_resource(spark, sf_dir):
    slip = "CASE WHEN doc_id % 4 = 2 THEN replace(text, 'aws_subnet.main.id', 'aws_subnet.mian.id') ELSE text END"
    return _findings(spark, sf_dir, "hcl", slip, lambda: checks.undeclared_resource(F.col("text"), _blocks()))


@query(
    "chk_dangling_ref",
    f"""WITH {TPL} SELECT doc_id, 'E004' AS code, 'GetAtt of nothing: ' || CASE WHEN starts_with(text, '{{') THEN 'Quue' ELSE 'Wroker' END AS message FROM tpl WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'E004', 'Ref to nothing: Subnt' FROM tpl WHERE doc_id % 5 = 2 AND NOT starts_with(text, '{{')""",
)
def chk_dangling_ref(spark, sf_dir):
    slip = """CASE doc_id % 5 WHEN 1 THEN replace(replace(text, '!GetAtt Worker', '!GetAtt Wroker'), '["Queue", "Arn"]', '["Quue", "Arn"]')
      WHEN 2 THEN replace(text, '!Ref Subnet', '!Ref Subnt') ELSE text END"""
    return _findings(spark, sf_dir, "template", slip, lambda: checks.dangling_ref(_nodes()), reads=checks.READS["dangling_ref"])


@query(
    "chk_required",
    f"""WITH {HCL}, {TPL} SELECT doc_id * 2 AS doc_id, 'E005' AS code, 'Missing argument cidr_block in aws_vpc.main' AS message FROM hcl WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id * 2 + 1, 'E005', 'Missing property ImageId in Worker' FROM tpl WHERE doc_id % 4 = 3""",
)
def chk_required(spark, sf_dir):
    one = _findings(
        spark, sf_dir, "hcl", "CASE WHEN doc_id % 3 = 1 THEN replace(text, '  cidr_block = \"10.', '  cidr = \"10.') ELSE text END",
        lambda: checks.required_arguments(F.col("text"), _blocks()),
    )
    two = _findings(
        spark, sf_dir, "template", "CASE WHEN doc_id % 4 = 3 THEN replace(text, 'ImageId', 'Image') ELSE text END",
        lambda: checks.required_properties(_nodes()), reads=checks.READS["required_properties"],
    )
    return one.withColumn("doc_id", F.col("doc_id") * 2).unionAll(two.withColumn("doc_id", F.col("doc_id") * 2 + 1))


@query(
    "chk_unknown_type",
    f"WITH {BLOCKS} SELECT doc_id, 'aws_instence' AS type, name FROM blocks WHERE type = 'aws_instance' AND doc_id % 5 = 0",
)
def chk_unknown_type(spark, sf_dir):
    gold = hcl_configs(spark, sf_dir)
    slip = F.expr("CASE WHEN doc_id % 5 = 0 THEN replace(text, 'aws_instance\"', 'aws_instence\"') ELSE text END")
    found = checks.unknown_types(resource_table(gold.withColumn("text", slip)), resource_table(gold))
    return found.select("doc_id", "type", "name")


@query(
    "chk_type_drift",
    rf"""WITH {BLOCKS} SELECT doc_id, type, name AS block, 'monitoring' AS attribute, 'string' AS kind, 'bool' AS usual_kind FROM blocks WHERE doc_id % 10 = 0 AND contains(body, 'monitoring    = true')
UNION ALL SELECT doc_id, type, name, 'encrypted', 'string', 'bool' FROM blocks WHERE doc_id % 10 = 0 AND contains(body, 'encrypted     = true')""",
)
def chk_type_drift(spark, sf_dir):
    gold = hcl_configs(spark, sf_dir)
    slip = F.expr("CASE WHEN doc_id % 10 = 0 THEN replace(text, '= true', '= \"true\"') ELSE text END")
    return checks.type_drift(gold.withColumn("text", slip), gold)


_TYPED = r"CASE WHEN starts_with(text, '{') THEN regexp_extract_all(text, '(?m)^    \"(\w+)\": \{\n      \"Type\": \"AWS::EC2::Instance', 1) ELSE regexp_extract_all(text, '(?m)^  (\w+):\n    Type: AWS::EC2::Instance', 1) END"


@query(
    "chk_unknown_type_template",
    f"WITH {TPL} SELECT doc_id, 'AWS::EC2::Instence' AS type, unnest({_TYPED}) AS name FROM tpl WHERE doc_id % 6 = 0",
)
def chk_unknown_type_template(spark, sf_dir):
    gold = template_configs(spark, sf_dir).select("doc_id", "text")
    slip = F.expr("CASE WHEN doc_id % 6 = 0 THEN replace(text, 'EC2::Instance', 'EC2::Instence') ELSE text END")
    found = checks.unknown_types(
        checks.template_type_table(prepare(gold.withColumn("text", slip), "template", checks.TYPE_READS)),
        checks.template_type_table(prepare(gold, "template", checks.TYPE_READS)),
    )
    return found.select("doc_id", "type", "name")


@query(
    "chk_type_drift_template",
    f"""WITH {TPL}, b AS (SELECT * FROM (VALUES ('Network', 'AWS::EC2::VPC'), ('Subnet', 'AWS::EC2::Subnet')) t(block, type))
SELECT doc_id, type, block, 'CidrBlock' AS attribute, 'int' AS kind, 'str' AS usual_kind FROM tpl CROSS JOIN b WHERE doc_id % 10 = 0 AND NOT starts_with(text, '{{')""",
)
def chk_type_drift_template(spark, sf_dir):
    gold = template_configs(spark, sf_dir).select("doc_id", "text")
    slip = F.expr("CASE WHEN doc_id % 10 = 0 THEN replace(text, 'CidrBlock: 10.', 'CidrBlock: 10 # ') ELSE text END")
    given = lambda configs: prepare(configs, "template", checks.DRIFT_READS)
    return checks.template_type_drift(given(gold.withColumn("text", slip)), given(gold))


@query(
    "chk_literals",
    f"""WITH {HCL} SELECT doc_id, 'E008' AS code, 'Unknown region us-nowhere-' || regexp_extract(text, 'us-east-([12])"', 1) AS message FROM hcl WHERE doc_id % 4 = 0 AND contains(text, 'region = "')
UNION ALL SELECT doc_id, 'E008', 'Invalid network 10.0.0.0/88' FROM hcl WHERE doc_id % 4 = 2
UNION ALL SELECT DISTINCT doc_id, 'E008', 'Invalid image ' || replace(unnest(regexp_extract_all(text, 'ami-[0-9a-f]+', 0)), 'ami', 'emi') FROM hcl WHERE doc_id % 4 = 1
UNION ALL SELECT doc_id, 'E008', 'Unknown zone ' || regexp_extract(text, 'us-east-1[abc]', 0) || 'x' FROM hcl WHERE doc_id % 4 = 3""",
)
def chk_literals(spark, sf_dir):
    slip = """CASE doc_id % 4 WHEN 0 THEN replace(text, 'region = "us-east-', 'region = "us-nowhere-') WHEN 2 THEN replace(text, '10.0.0.0/8"', '10.0.0.0/88"')
      WHEN 1 THEN replace(text, '"ami-', '"emi-') ELSE replace(replace(replace(text, '1a"', '1ax"'), '1b"', '1bx"'), '1c"', '1cx"') END"""
    return _findings(spark, sf_dir, "hcl", slip, lambda: checks.literals(F.col("text")))


@query(
    "chk_cycle",
    f"""WITH {HCL}, {TPL} SELECT doc_id * 2 AS doc_id, 'E009' AS code, 'Dependency cycle' AS message FROM hcl WHERE doc_id % 7 = 0 AND doc_id % 3 >= 1
UNION ALL SELECT doc_id * 2 + 1, 'E009', 'Dependency cycle' FROM tpl WHERE doc_id % 2 = 0 AND contains(text, 'DependsOn')""",
)
def chk_cycle(spark, sf_dir):
    one = _findings(
        spark, sf_dir, "hcl",
        "CASE WHEN doc_id % 7 = 0 THEN replace(text, '  tags = {', concat('  depends_on = [aws_instance.line_2]', chr(10), '  tags = {')) ELSE text END",
        lambda: checks.cycle(F.col("text")),
    )
    two = _findings(
        spark, sf_dir, "template",
        """CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, '    Type: AWS::EC2::VPC', concat('    DependsOn: [Worker, Subnet]', chr(10), '    Type: AWS::EC2::VPC')),
           '"Network": {', '"Network": {"DependsOn": "Queue", ') ELSE text END""",
        lambda: checks.template_cycle(_nodes()), reads=checks.READS["template_cycle"],
    )
    return one.withColumn("doc_id", F.col("doc_id") * 2).unionAll(two.withColumn("doc_id", F.col("doc_id") * 2 + 1))


@query(
    "chk_provider",
    f"WITH {HCL} SELECT doc_id, 'E010' AS code, 'No provider for aws' AS message FROM hcl WHERE NOT contains(text, 'provider \"aws\"')",
)
def chk_provider(spark, sf_dir):
    return _findings(spark, sf_dir, "hcl", "text", lambda: checks.provider(F.col("text"), _blocks()))


@query(
    "chk_intrinsics",
    f"""WITH {TPL}, y AS (SELECT * FROM tpl WHERE NOT starts_with(text, '{{'))
SELECT doc_id, 'E011' AS code, 'Unclosed variable in Sub: ${{StackEnv-net-' || doc_id AS message FROM y WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'E011', 'Select index out of range: 40' FROM y WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'E011', 'Condition not defined: IsDead' FROM y WHERE doc_id % 5 = 2 AND contains(text, '!If [IsLive')
UNION ALL SELECT doc_id, 'E011', 'Join needs a delimiter and a list: Resources.Store.Properties.BucketName.Join' FROM y WHERE doc_id % 5 = 3 AND contains(text, '!Join')""",
)
def chk_intrinsics(spark, sf_dir):
    slip = """CASE doc_id % 5 WHEN 0 THEN replace(text, concat('$', '{StackEnv}-net'), concat('$', '{StackEnv-net')) WHEN 1 THEN replace(text, '!Select [0, !GetAZs ""]', '!Select [40, [a, b]]')
      WHEN 2 THEN replace(text, '!If [IsLive', '!If [IsDead') WHEN 3 THEN replace(text, '!Join ["-", [', '!Join [["-", ') ELSE text END"""
    fixed = f"CASE WHEN doc_id % 5 = 3 THEN regexp_replace({slip}, '!Join [^' || chr(10) || ']*', '!Join [a, b, c]') ELSE {slip} END"
    return _findings(spark, sf_dir, "template", fixed, lambda: checks.intrinsics(_nodes()), reads=checks.READS["intrinsics"])


@query(
    "chk_layout",
    f"""WITH {TPL} SELECT doc_id, 'E012' AS code, CASE WHEN starts_with(text, '{{') THEN 'Not valid JSON' ELSE 'Tab in indentation' END AS message FROM tpl WHERE doc_id % 4 <> 0""",
)
def chk_layout(spark, sf_dir):
    slip = "CASE WHEN doc_id % 4 <> 0 THEN replace(replace(text, '    Type: AWS', concat(chr(9), 'Type: AWS')), '\"Outputs\": {', '\"Outputs\": {,') ELSE text END"
    return _findings(spark, sf_dir, "template", slip, lambda: checks.layout(F.col("text")), parsed=False)


@query(
    "chk_open_ingress",
    f"""WITH {HCL}, {TPL} SELECT doc_id * 2 AS doc_id, 'W001' AS code, 'Ingress open to the world on all ports' AS message FROM hcl WHERE doc_id % 3 = 0 AND contains(text, 'aws_security_group')
UNION ALL SELECT doc_id * 2 + 1, 'W001', 'Ingress open to the world on all ports' FROM tpl WHERE doc_id % 3 = 0 AND contains(text, 'SecurityGroupIngress')""",
)
def chk_open_ingress(spark, sf_dir):
    one = _findings(
        spark, sf_dir, "hcl",
        "CASE WHEN doc_id % 3 = 0 THEN replace(replace(replace(text, 'from_port   = 443', 'from_port   = 0'), 'to_port     = 443', 'to_port     = 65535'), '10.0.0.0/8\"', '0.0.0.0/0\"') ELSE text END",
        lambda: checks.open_ingress(F.col("text")),
    )
    two = _findings(
        spark, sf_dir, "template",
        "CASE WHEN doc_id % 3 = 0 THEN replace(replace(replace(text, 'FromPort: 443', 'FromPort: 0'), 'ToPort: 443', 'ToPort: 65535'), 'CidrIp: 10.0.0.0/8', 'CidrIp: 0.0.0.0/0') ELSE text END",
        lambda: checks.template_open_ingress(_nodes()), reads=checks.READS["template_open_ingress"],
    )
    return one.withColumn("doc_id", F.col("doc_id") * 2).unionAll(two.withColumn("doc_id", F.col("doc_id") * 2 + 1))


@query(
    "chk_encryption",
    f"""WITH {BLOCKS}, {TPL} SELECT doc_id * 2 AS doc_id, 'W002' AS code, 'No encryption in aws_instance.' || name AS message FROM blocks WHERE type = 'aws_instance' AND NOT contains(body, 'encrypted')
UNION ALL SELECT doc_id * 2 + 1, 'W002', 'No encryption in Store' FROM tpl WHERE contains(text, 'AWS::S3::Bucket') AND NOT contains(text, 'BucketEncryption')""",
)
def chk_encryption(spark, sf_dir):
    one = _findings(spark, sf_dir, "hcl", "text", lambda: checks.encryption(F.col("text"), _blocks()))
    two = _findings(spark, sf_dir, "template", "text", lambda: checks.template_encryption(_nodes()), reads=checks.READS["template_encryption"])
    return one.withColumn("doc_id", F.col("doc_id") * 2).unionAll(two.withColumn("doc_id", F.col("doc_id") * 2 + 1))
