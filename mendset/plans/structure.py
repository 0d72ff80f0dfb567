"""Registered queries: the taxonomy against the corpus, and structure extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from mendset.functions.text import plain_bytes, splice
from mendset.operators import structure_hcl as hcl
from mendset.operators import structure_template as tpl
from mendset.operators import taxonomy as tax
from mendset.plans.base import ATTRS, BLOCKS, CONFIGS, HCL, TPL, longs, query, taxonomy_sql
from mendset.sources.rendered import configs, hcl_configs, template_configs

# ---- 2.4 taxonomy. The dimension itself is fixed, so each query applies it to the corpus.


@query(
    "fault_dim",
    f"""WITH {CONFIGS}, {taxonomy_sql()}, n AS (SELECT format, count(*) AS configs FROM configs GROUP BY format)
SELECT f.ord::BIGINT AS ord, f.fault_id, f.category, f.name, f.severity, f.formats, f.example_error, f.tags, f.description,
 coalesce(sum(n.configs), 0)::BIGINT AS configs FROM faults f LEFT JOIN n ON list_contains(string_split(f.formats, ','), n.format) GROUP BY ALL""",
)
def fault_dim(spark, sf_dir):
    sizes = configs(spark, sf_dir).groupBy("format").agg(F.count("*").alias("configs"))
    faults = tax.fault_dim(spark)
    per_fault = faults.select("fault_id", F.explode("formats").alias("format")).join(sizes, "format", "left")
    totals = per_fault.groupBy("fault_id").agg(F.coalesce(F.sum("configs"), F.lit(0)).alias("configs"))
    return faults.join(totals, "fault_id").select(
        F.col("ord").cast("bigint").alias("ord"), "fault_id", "category", "name", "severity",
        F.array_join("formats", ",").alias("formats"), "example_error",
        F.array_join("tags", ",").alias("tags"), "description", "configs",
    )


@query(
    "fault_lookup",
    f"""WITH {CONFIGS}, {taxonomy_sql()}, r AS (SELECT DISTINCT fault_id, category, formats, ord FROM faults)
SELECT c.doc_id, 'category' AS kind, f.fault_id, f.ord::BIGINT AS ord FROM configs c JOIN r f ON f.category = 'SECURITY' AND list_contains(string_split(f.formats, ','), c.format)
UNION ALL SELECT c.doc_id, 'id', f.fault_id, f.ord::BIGINT FROM configs c JOIN r f ON f.fault_id = 'SYNTACTIC.invalid_yaml' AND c.format = 'cloudformation'
UNION ALL SELECT c.doc_id, 'format', f.fault_id, f.ord::BIGINT FROM configs c JOIN r f ON c.format = 'terraform' AND contains(f.formats, 'opentofu')""",
)
def fault_lookup(spark, sf_dir):
    faults, docs = tax.fault_dim(spark), configs(spark, sf_dir).select("doc_id", "format")
    found = [
        ("category", tax.by_category(faults, "SECURITY"), docs),
        ("id", tax.by_id(faults, "SYNTACTIC.invalid_yaml"), docs),
        ("format", tax.by_format(faults, "opentofu"), docs),
    ]
    rows = [
        tax.applicability_join(d, f).select("doc_id", F.lit(kind).alias("kind"), "fault_id", F.col("ord").cast("bigint").alias("ord"))
        for kind, f, d in found
    ]
    return reduce(lambda a, b: a.unionAll(b), rows)


@query(
    "taxonomy_listing",
    f"""WITH {CONFIGS}, {taxonomy_sql()}, n AS (SELECT format, count(*) AS configs FROM configs GROUP BY format)
SELECT row_number() OVER (ORDER BY f.category, f.severity, f.ord)::BIGINT AS pos, f.fault_id, f.category, f.severity, replace(f.formats, ',', ', ') AS formats, f.description,
 count(*) OVER (PARTITION BY f.category)::BIGINT AS category_count, (SELECT sum(configs) FROM n WHERE list_contains(string_split(f.formats, ','), n.format))::BIGINT AS configs FROM faults f""",
)
def taxonomy_listing(spark, sf_dir):
    sizes = configs(spark, sf_dir).groupBy("format").agg(F.count("*").alias("configs"))
    listing = longs(tax.taxonomy_listing(tax.fault_dim(spark)), "pos", "category_count")
    per_fault = listing.withColumn("format", F.explode(F.split("formats", ", "))).join(sizes, "format", "left")
    keys = ["pos", "fault_id", "category", "severity", "formats", "description", "category_count"]
    return per_fault.groupBy(*keys).agg(F.sum("configs").alias("configs"))


@query(
    "applicability_join",
    f"""WITH {CONFIGS}, {taxonomy_sql()}, k AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE format END AS format FROM configs)
SELECT k.doc_id, f.fault_id FROM k JOIN faults f ON list_contains(string_split(f.formats, ','), k.format)""",
)
def applicability_join(spark, sf_dir):
    fmt = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise(F.col("format"))
    docs = configs(spark, sf_dir).select("doc_id", fmt.alias("format"))
    return tax.applicability_join(docs, tax.fault_dim(spark)).select("doc_id", "fault_id")


_TURNS = f"""{taxonomy_sql()}, x AS (SELECT *, unnest(string_split(formats, ',')) AS format FROM faults),
rr AS (SELECT *, row_number() OVER (PARTITION BY format, category ORDER BY ord) AS round, min(ord) OVER (PARTITION BY format, category) AS category_ord FROM x),
chosen AS (SELECT *, row_number() OVER (PARTITION BY format ORDER BY round, category_ord) AS turn FROM rr QUALIFY turn <= 8)"""


@query(
    "stratified_faults",
    f"WITH {CONFIGS}, {_TURNS} SELECT c.doc_id, s.fault_id, s.turn::BIGINT AS turn FROM configs c JOIN chosen s ON c.format = s.format",
)
def stratified_faults(spark, sf_dir):
    chosen = tax.stratified_faults(tax.fault_dim(spark), 8).select("format", "fault_id", F.col("turn").cast("bigint").alias("turn"))
    docs = configs(spark, sf_dir).select("doc_id", "format")
    return docs.join(F.broadcast(chosen), "format").select("doc_id", "fault_id", "turn")


@query(
    "agentic_targets",
    f"""WITH {CONFIGS}, {_TURNS}, h AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY format, category ORDER BY ord) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY format ORDER BY category_ord) AS slot FROM h QUALIFY slot <= 3)
SELECT c.doc_id, t.fault_id, t.slot::BIGINT AS slot FROM configs c JOIN t ON c.format = t.format""",
)
def agentic_targets(spark, sf_dir):
    chosen = tax.stratified_faults(tax.fault_dim(spark), 8)
    rows = tax.agentic_targets(configs(spark, sf_dir).select("doc_id", "format"), chosen, 3)
    return rows.select("doc_id", "fault_id", F.col("slot").cast("bigint").alias("slot"))


# ---- 2.5 structure of brace texts


def _kind_sql(kind: str, label: str) -> str:
    hits = rf"regexp_extract_all(text, '(?m)^{kind} {label}\{{\n(?:  [^\n]*\n)*\}}', 0)"
    return f"SELECT doc_id, '{kind}' AS kind, instr(text, b) - 1 AS span_start, instr(text, b) - 1 + length(b) AS span_end FROM (SELECT doc_id, text, unnest({hits}) AS b FROM hcl)"


@query(
    "block_spans",
    f"WITH {HCL} "
    + " UNION ALL ".join(
        _kind_sql(k, lab) for k, lab in (("terraform", ""), ("provider", '"aws" '), ("variable", '"priority" '), ("module", '"net" '))
    ),
)
def block_spans(spark, sf_dir):
    docs = hcl_configs(spark, sf_dir)
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), hcl.block_spans(F.col("text"), k).alias("spans"))
            for k in ("terraform", "provider", "variable", "module")
        ]
    )
    per_kind = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.explode("k.spans").alias("b"))
    return per_kind.select(
        "doc_id", "kind", F.col("b.start").cast("bigint").alias("span_start"), F.col("b.end").cast("bigint").alias("span_end")
    )


@query("resource_spans", f"WITH {BLOCKS} SELECT doc_id, (i)::BIGINT AS i, type, name, s AS span_start, e AS span_end FROM blocks")
def resource_spans(spark, sf_dir):
    rows = hcl.resource_table(hcl_configs(spark, sf_dir)).withColumnsRenamed({"start": "span_start", "end": "span_end"})
    return longs(rows, "i", "span_start", "span_end")


@query("attributes", f"WITH {ATTRS} SELECT doc_id, i::BIGINT AS i, type, block, attr AS name, line_no::BIGINT AS line, start AS line_start FROM attrs")
def attributes(spark, sf_dir):
    rows = hcl.attribute_table(hcl_configs(spark, sf_dir)).withColumnRenamed("start", "line_start").drop("text")
    return longs(rows, "i", "line", "line_start")


@query(
    "attribute_line",
    rf"""WITH {BLOCKS} SELECT doc_id, name, CASE WHEN regexp_matches(body, '(?m)^\s*from_port\s*=') THEN
  length(regexp_replace(substr(text, 1, s) || regexp_extract(body, '^((?s).*?)from_port\s*=', 1), '[^\n]', '', 'g')) END::BIGINT AS line FROM blocks""",
)
def attribute_line(spark, sf_dir):
    staged = hcl_configs(spark, sf_dir).withColumn("blocks", hcl.resource_spans(F.col("text")))
    lines = F.transform(
        "blocks",
        lambda b: F.struct(b["name"].alias("name"), hcl.attribute_line(F.col("text"), b, "from_port").cast("bigint").alias("line")),
    )
    return staged.select("doc_id", F.explode(lines).alias("x")).select("doc_id", "x.name", "x.line")


_STARTS = """(length(array_to_string(list_slice(string_split_regex(text, '{p}'), 1, k), '')) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0))::BIGINT"""


@query(
    "variable_refs",
    rf"""WITH {HCL}, r AS (SELECT doc_id, text, regexp_extract_all(text, 'var\.(\w+)', 0) AS m FROM hcl)
SELECT doc_id, substr(m[k], 5) AS name, {_STARTS.format(p=r"var\.\w+")} AS ref_start FROM (SELECT *, unnest(generate_series(1, len(m))) AS k FROM r)""",
)
def variable_refs(spark, sf_dir):
    rows = hcl_configs(spark, sf_dir).select("doc_id", F.explode(hcl.variable_refs(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.name", F.col("r.start").cast("bigint").alias("ref_start"))


_REF = r"[A-Za-z_]\w*\.\w+\.\w+"


@query(
    "resource_refs",
    rf"""WITH {HCL}, r AS (SELECT doc_id, text, regexp_extract_all(text, '{_REF}', 0) AS m FROM hcl)
SELECT doc_id, string_split(m[k], '.')[1] AS type, string_split(m[k], '.')[2] AS name, {_STARTS.format(p=_REF)} AS ref_start FROM (SELECT *, unnest(generate_series(1, len(m))) AS k FROM r)
WHERE NOT starts_with(m[k], 'var')""",
)
def resource_refs(spark, sf_dir):
    rows = hcl_configs(spark, sf_dir).select("doc_id", F.explode(hcl.resource_refs(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.type", "r.name", F.col("r.start").cast("bigint").alias("ref_start"))


@query(
    "line_delete",
    f"""WITH {HCL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM hcl)
SELECT doc_id, md5(array_to_string(list_concat(list_slice(a, 1, doc_id % 5), list_slice(a, doc_id % 5 + 4, len(a))), chr(10))) AS text_hash FROM l""",
)
def line_delete(spark, sf_dir):
    first = (F.col("doc_id") % 5).cast("int")
    text = hcl.line_delete(F.col("text"), first, first + 2)
    return hcl_configs(spark, sf_dir).select("doc_id", F.md5(text).alias("text_hash"))


@query(
    "line_replace",
    f"""WITH {HCL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS a, doc_id % 60 AS n FROM hcl),
c AS (SELECT *, a[n + 1] AS x FROM l)
SELECT doc_id, md5(CASE WHEN x IS NULL OR instr(x, 'a') = 0 THEN array_to_string(a, chr(10)) ELSE
 array_to_string(list_concat(list_concat(list_slice(a, 1, n), [substr(x, 1, instr(x, 'a') - 1) || 'ZZ' || substr(x, instr(x, 'a') + 1)]), list_slice(a, n + 2, len(a))), chr(10)) END) AS text_hash FROM c""",
)
def line_replace(spark, sf_dir):
    text = hcl.line_replace(F.col("text"), (F.col("doc_id") % 60).cast("int"), "a", "ZZ")
    return hcl_configs(spark, sf_dir).select("doc_id", F.md5(text).alias("text_hash"))


# ---- 2.5 structure of templates


@query(
    "template_nodes",
    rf"""WITH {TPL} SELECT doc_id, CASE WHEN starts_with(text, '{{') THEN len(regexp_extract_all(text, '"[^"]+":', 0))
  ELSE len(regexp_extract_all(text, '(?m)^\s*(?:- )?\w+:(?: |$)', 0)) + len(regexp_extract_all(text, '!(Ref|Sub|Select|GetAZs|If|Join|GetAtt|Equals)\b', 0)) END::BIGINT AS nodes FROM tpl""",
)
def template_nodes(spark, sf_dir):
    return tpl.template_nodes(template_configs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("nodes"))


@query(
    "intrinsic_nodes",
    rf"""WITH {TPL}, i AS (SELECT * FROM (VALUES ('Ref'), ('GetAtt'), ('Sub'), ('Select'), ('If'), ('Join')) t(name)),
c AS (SELECT doc_id, name, len(regexp_extract_all(text, '!' || name || '\b', 0)) + len(regexp_extract_all(text, '"(Fn::)?' || name || '":', 0)) AS nodes FROM tpl CROSS JOIN i)
SELECT doc_id, name, nodes::BIGINT AS nodes FROM c WHERE nodes > 0""",
)
def intrinsic_nodes(spark, sf_dir):
    docs = tpl.with_nodes(template_configs(spark, sf_dir))
    counts = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.size(tpl.intrinsic(F.col("nodes"), n)).cast("bigint").alias("nodes"))
            for n in tpl.INTRINSICS
        ]
    )
    return docs.select("doc_id", F.explode(counts).alias("c")).select("doc_id", "c.*").filter("nodes > 0")


_RES = r"""CASE WHEN starts_with(text, '{') THEN regexp_extract_all(text, '(?m)^    "(\w+)": \{\n      "Type": "AWS::', 1)
  ELSE regexp_extract_all(text, '(?m)^  (\w+):\n    Type: AWS::', 1) END"""
_TYP = r"""CASE WHEN starts_with(text, '{') THEN regexp_extract_all(text, '(?m)^    "(\w+)": \{\n      "Type": "(AWS::[\w:]+)', 2)
  ELSE regexp_extract_all(text, '(?m)^  (\w+):\n    Type: (AWS::[\w:]+)', 2) END"""
_PAR = r"""CASE WHEN starts_with(text, '{') THEN regexp_extract_all(text, '(?m)^    "(\w+)": \{\n      "Type": "String', 1)
  ELSE regexp_extract_all(text, '(?m)^  (\w+):\n    Type: String', 1) END"""


@query(
    "template_names",
    f"""WITH {TPL} SELECT doc_id, 'Resources' AS section, unnest({_RES}) AS name FROM tpl
UNION ALL SELECT doc_id, 'Parameters', unnest({_PAR}) FROM tpl
UNION ALL SELECT doc_id, 'Conditions', 'IsLive' FROM tpl WHERE NOT starts_with(text, '{{')""",
)
def template_names(spark, sf_dir):
    docs = tpl.with_nodes(template_configs(spark, sf_dir))
    sections = F.array(
        *[
            F.struct(F.lit(s).alias("section"), tpl.section_names(F.col("nodes"), s).alias("names"))
            for s in ("Resources", "Parameters", "Conditions")
        ]
    )
    rows = docs.select("doc_id", F.explode(sections).alias("s"))
    return rows.select("doc_id", "s.section", F.explode("s.names").alias("name"))


@query(
    "resource_type_lookup",
    f"""WITH {TPL}, r AS (SELECT doc_id, {_RES} AS names, {_TYP} AS types FROM tpl), w AS (SELECT * FROM (VALUES ('Network'), ('Guard'), ('Nowhere')) t(logical_id))
SELECT doc_id, logical_id, CASE WHEN list_contains(names, logical_id) THEN types[list_position(names, logical_id)] END AS type FROM r CROSS JOIN w""",
)
def resource_type_lookup(spark, sf_dir):
    docs = tpl.with_nodes(template_configs(spark, sf_dir))
    found = F.transform(
        F.array(F.lit("Network"), F.lit("Guard"), F.lit("Nowhere")),
        lambda n: F.struct(n.alias("logical_id"), tpl.resource_type(F.col("nodes"), n).alias("type")),
    )
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


@query(
    "nested_get",
    rf"""WITH {TPL} SELECT doc_id, CASE WHEN starts_with(text, '{{') THEN regexp_extract(text, '"CidrBlock": "([^"]*)"', 1) ELSE regexp_extract(text, 'CidrBlock: (\S+)', 1) END AS cidr,
  CASE WHEN starts_with(text, '{{') THEN NULL ELSE 'String' END AS node_type, NULL::VARCHAR AS nothing FROM tpl""",
)
def nested_get(spark, sf_dir):
    docs, n = tpl.with_nodes(template_configs(spark, sf_dir)), F.col("nodes")
    return docs.select(
        "doc_id",
        tpl.nested_get(n, ["Resources", "Network", "Properties", "CidrBlock"]).alias("cidr"),
        tpl.nested_get(n, ["Parameters", "NodeType", "Type"]).alias("node_type"),
        tpl.nested_get(n, ["Resources", "Missing", "Type"]).alias("nothing"),
    )


@query(
    "nested_set",
    rf"""WITH {TPL} SELECT doc_id, md5(CASE WHEN starts_with(text, '{{') THEN regexp_replace(text, '("CidrBlock": )"[^"]*"', '\1"10.9.0.0/16"')
  ELSE regexp_replace(text, '(CidrBlock: )\S+', '\1"10.9.0.0/16"') END) AS replaced_hash,
  md5(CASE WHEN starts_with(text, '{{') THEN regexp_replace(text, '("Network": \{{)', '\1"Metadata": {{"Owner": "me"}}, ')
  ELSE replace(text, '    Type: AWS::EC2::VPC' || chr(10), '    Metadata: {{"Owner": "me"}}' || chr(10) || '    Type: AWS::EC2::VPC' || chr(10)) END) AS added_hash FROM tpl""",
)
def nested_set(spark, sf_dir):
    here, there = ["Resources", "Network", "Properties", "CidrBlock"], ["Resources", "Network", "Metadata", "Owner"]
    docs = tpl.with_nodes(template_configs(spark, sf_dir), [*tpl.on_the_way(here), *tpl.on_the_way(there)])
    docs, n, t, plain = docs.withColumn("plain", plain_bytes(F.col("text"))), F.col("nodes"), F.col("text"), F.col("plain")
    replaced = tpl.nested_set(t, n, here, "10.9.0.0/16")
    added = tpl.nested_set(t, n, there, "me")
    return docs.select(
        "doc_id",
        F.md5(splice(t, F.array(replaced), plain)).alias("replaced_hash"),
        F.md5(splice(t, F.array(added), plain)).alias("added_hash"),
    )


