"""Static rules over configs: each finds in a text what one kind of fault leaves behind.

A rule yields array<struct<code,message>> in the document's row (code E.. is an error, W.. a
warning), so all rules of a document run in one pass without a shuffle. Only the two rules that
learn from a corpus (`unknown_types`, `type_drift`) aggregate and join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from mendset.functions import braces as scan
from mendset.functions import graphs
from mendset.functions.text import WHITESPACE, let, plain_bytes, text_slice
from mendset.operators.faults_hcl import REQUIRED_ARGUMENTS
from mendset.operators.faults_template import ENCRYPTION_PROPERTIES, REQUIRED_PROPERTIES
from mendset.operators.structure_hcl import (
    _without_quotes,
    attribute_table,
    resource_words,
    variable_refs,
)
from mendset.operators.structure_template import (
    PROPERTIES,
    calls_of,
    intrinsic,
    is_property,
    names_of,
    node_at,
    resource_key,
    section_names,
)
from mendset.sources.corpus import materialized

FINDINGS = "array<struct<code:string,message:string>>"

# Shapes of valid literals and the encryption settings of resource types.
REGION = r"(us|eu|ap|ca|sa|me|af|il|mx|cn)-(gov-|iso-|isob-)?(north|south|east|west|central)(east|west)?-[1-9]"
ENCRYPTION_ARGUMENTS = {
    "aws_instance": "encrypted",
    "aws_ebs_volume": "encrypted|kms_key_id",
    "aws_db_instance": "storage_encrypted|kms_key_id",
    "aws_s3_bucket": "server_side_encryption_configuration",
}


def _none() -> Column:
    return F.expr(f"cast(array() as {FINDINGS})")


def _each(items: Column, code: str, message) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(code).alias("code"), message(x).alias("message"))).cast(FINDINGS)


def _when(test: Column, code: str, message: Column) -> Column:
    one = F.array(F.struct(F.lit(code).alias("code"), message.alias("message"))).cast(FINDINGS)
    return F.when(F.coalesce(test, F.lit(False)), one).otherwise(_none())


def _says(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


# ---- brace-structured texts: need `text` and `resource_spans`


def braces(text: Column) -> Column:
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return let(
        _without_quotes(text),
        lambda t: _when(count(t, "{") != count(t, "}"), "E001", F.lit("Unbalanced braces")),
    )


def undeclared_var(text: Column) -> Column:
    declared = F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*variable\s+"([^"]+)"'), F.lit(1))
    used = F.array_distinct(F.transform(variable_refs(text), lambda r: r["name"]))
    return _each(F.array_except(used, declared), "E002", lambda n: _says("Undeclared variable ", n))


def undeclared_resource(text: Column, blocks: Column) -> Column:
    declared = F.transform(blocks, lambda b: F.concat_ws(".", b["type"], b["name"]))
    # the references that start with a type's name; a letter first, as all strict ones
    typed = F.filter(resource_words(text), lambda m: m["found"].rlike("^(?!var)[a-z][a-z0-9]*_"))
    used = F.array_distinct(F.transform(typed, lambda m: F.substring_index(m["found"], ".", 2)))
    return _each(F.array_except(used, declared), "E003", lambda n: _says("Undeclared resource ", n))


def required_arguments(text: Column, blocks: Column) -> Column:
    table = F.create_map(
        *[x for k, v in REQUIRED_ARGUMENTS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))]
    )

    def of_block(b, plain):
        wanted = F.coalesce(F.try_element_at(table, b["type"]), F.array().cast("array<string>"))
        # at any depth: an argument whose value opens a bracket counts as given
        body = text_slice(text, b["start"], b["end"], plain)
        held = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*(\w+)[ \t]*="), F.lit(1))
        return _each(
            F.array_except(wanted, held), "E005", lambda n: _says("Missing argument ", n, " in ", b["type"], ".", b["name"])
        )

    return let(plain_bytes(text), lambda plain: F.flatten(F.transform(blocks, lambda b: of_block(b, plain))))


def literals(text: Column) -> Column:
    nets = F.array_distinct(F.regexp_extract_all(text, F.lit(r'"(\d+\.\d+\.\d+\.\d+/\d+)"'), F.lit(1)))

    def bad_net(n):
        # a number too long for a bigint is null, and out of range
        numbers = F.transform(F.split(n, "[./]"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(256)))
        return F.exists(F.slice(numbers, 1, 4), lambda x: x > 255) | (F.get(numbers, F.lit(4)) > 32)

    images = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*(?:ami|image_id)\s*=\s*"([^"$]*)"'), F.lit(1)))
    regions = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*region\s*=\s*"([^"$]*)"'), F.lit(1)))
    zones = F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*availability_zone\s*=\s*"([^"$]*)"'), F.lit(1)))
    return F.concat(
        _each(F.filter(nets, bad_net), "E008", lambda n: _says("Invalid network ", n)),
        _each(F.filter(images, lambda i: ~i.rlike("^ami-[0-9a-f]+$")), "E008", lambda n: _says("Invalid image ", n)),
        _each(F.filter(regions, lambda i: ~i.rlike(f"^{REGION}$")), "E008", lambda n: _says("Unknown region ", n)),
        _each(F.filter(zones, lambda i: ~i.rlike(f"^{REGION}[a-z]$")), "E008", lambda n: _says("Unknown zone ", n)),
    )


@F.arrow_udf(BooleanType())
def _text_cyclic(texts: pa.Array) -> pa.Array:
    parts = [graphs.cyclic(scan.dependencies(some)) for some in scan.slices(texts)]
    return pa.array(np.concatenate([np.zeros(0, bool), *parts]))


def cycle(text: Column) -> Column:
    return _when(_text_cyclic(text), "E009", F.lit("Dependency cycle"))


def provider(text: Column, blocks: Column) -> Column:
    needed = F.array_distinct(F.transform(blocks, lambda b: F.split(b["type"], "_", 2)[0]))
    named = F.concat(
        F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*provider\s+"([^"]+)"'), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(\w+)\s*=\s*\{\s*source\s*="), F.lit(1)),
    )
    return _each(F.array_except(needed, named), "E010", lambda n: _says("No provider for ", n))


def open_ingress(text: Column) -> Column:
    inside = F.regexp_extract_all(text, F.lit(r"ingress\s*\{([^}]*)\}"), F.lit(1))
    alone = F.regexp_extract_all(text, F.lit(r'resource\s+"aws_security_group_rule"\s+"[^"]*"\s*\{([^}]*)\}'), F.lit(1))
    rules = F.concat(inside, F.filter(alone, lambda r: r.rlike(r'\btype\s*=\s*"ingress"')))
    wide = lambda r: (
        r.contains("0.0.0.0/0") & r.rlike(r"from_port\s*=\s*0\b") & r.rlike(r"to_port\s*=\s*65535\b")
    )
    return _when(F.exists(rules, wide), "W001", F.lit("Ingress open to the world on all ports"))


def encryption(text: Column, blocks: Column) -> Column:
    def bare(b, plain):
        # a bucket may be covered by a resource of its own, so the whole text is searched for it
        own = text_slice(text, b["start"], b["end"], plain)
        place = F.when(b["type"] == "aws_s3_bucket", text).otherwise(own)
        tests = [
            (b["type"] == t) & ~place.rlike(rf"\b(\w+_)?({names})\b") for t, names in ENCRYPTION_ARGUMENTS.items()
        ]
        any_test = tests[0]
        for t in tests[1:]:
            any_test = any_test | t
        return any_test

    bare_ones = let(plain_bytes(text), lambda plain: F.filter(blocks, lambda b: bare(b, plain)))
    return _each(
        bare_ones, "W002", lambda b: _says("No encryption in ", b["type"], ".", b["name"])
    )


def hcl_findings(text: Column, blocks: Column) -> Column:
    return F.concat(
        braces(text), undeclared_var(text), undeclared_resource(text, blocks), required_arguments(text, blocks),
        literals(text), cycle(text), provider(text, blocks), open_ingress(text), encryption(text, blocks),
    )


# ---- templates: need `text` and `nodes`


#: The nodes that the template checks below look at.
READS = {
    "dangling_ref": [names_of("Resources"), names_of("Parameters"), calls_of("Ref"), calls_of("GetAtt")],
    "required_properties": [PROPERTIES, resource_key("Type")],
    "intrinsics": [names_of("Conditions"), *(calls_of(n) for n in ("Sub", "Select", "If", "Join"))],
    "template_cycle": [resource_key("DependsOn")],
    "template_open_ingress": [(3, None, None, ("Type",)), (None, None, None, ("CidrIp", "FromPort", "ToPort"))],
    "template_encryption": [PROPERTIES, resource_key("Type")],
}


def dangling_ref(nodes: Column) -> Column:
    resources, parameters = section_names(nodes, "Resources"), section_names(nodes, "Parameters")
    refs = F.array_distinct(F.transform(intrinsic(nodes, "Ref"), lambda n: n["value"]))
    heads = F.array_distinct(
        F.filter(
            F.transform(
                intrinsic(nodes, "GetAtt"),
                lambda n: F.coalesce(F.split(n["value"], r"\.", 2)[0], F.get(n["items"], F.lit(0))["value"]),
            ),
            lambda x: x.isNotNull(),
        )
    )
    pseudo = lambda x: ~x.startswith("AWS::")
    return F.concat(
        _each(
            F.filter(F.array_except(refs, F.concat(resources, parameters)), pseudo),
            "E004", lambda n: _says("Ref to nothing: ", n),
        ),
        _each(F.array_except(heads, resources), "E004", lambda n: _says("GetAtt of nothing: ", n)),
    )


#: Between the name of a resource and that of its property, where both are one key of a hash set.
OWNS = "\0"


def _resource_types(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: (F.size(n["path"]) == 3) & (n["path"][0] == "Resources") & (n["key"] == "Type"))


def _held(nodes: Column) -> Column:
    """The properties that resources have, each as one key."""
    return F.transform(F.filter(nodes, is_property), lambda p: F.concat(p["path"][1], F.lit(OWNS), p["key"]))


def _wanted(types: Column, table: dict[str, list[str]]) -> Column:
    """The properties that a table lists for the resources' types, each as one key."""
    names = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(OWNS + a) for a in v]).cast("array<string>"))])

    def of_resource(t):
        ends = F.coalesce(F.try_element_at(names, t["value"]), F.array().cast("array<string>"))
        return F.transform(ends, lambda end: F.concat(t["path"][1], end))

    return F.flatten(F.transform(types, of_resource))


def required_properties(nodes: Column) -> Column:
    """Set operations on keys of resource and property, so the work is linear in the nodes."""
    missing = F.array_except(_wanted(_resource_types(nodes), REQUIRED_PROPERTIES), _held(nodes))
    name = lambda key, k: F.substring_index(key, OWNS, k)
    return _each(missing, "E005", lambda key: _says("Missing property ", name(key, -1), " in ", name(key, 1)))


def template_literals(nodes: Column) -> Column:
    bad = F.filter(
        nodes,
        lambda n: (n["key"] == "ImageId") & (n["kind"] == "str") & ~n["value"].rlike("^ami-[0-9a-f]+$"),
    )
    return _each(bad, "E008", lambda n: _says("Invalid image ", n["value"]))


def intrinsics(nodes: Column) -> Column:
    subs = F.transform(
        intrinsic(nodes, "Sub"), lambda n: F.coalesce(n["value"], F.get(n["items"], F.lit(0))["value"])
    )
    opened = F.filter(subs, lambda s: s.rlike(r"\$\{[^}]*$"))

    def out_of_range(n):
        index = F.get(n["items"], F.lit(0))
        source = F.get(n["items"], F.lit(1))
        # only a list that stands in the text has a known size
        known = (index["kind"] == "int") & (source["kind"] == "list")
        return F.coalesce(known & (F.coalesce(index["value"].try_cast("bigint"), F.lit(1 << 62)) >= source["size"]), F.lit(False))

    conditions = section_names(nodes, "Conditions")
    names = F.array_distinct(
        F.transform(intrinsic(nodes, "If"), lambda n: F.get(n["items"], F.lit(0))["value"])
    )
    bad_joins = F.filter(intrinsic(nodes, "Join"), lambda n: (n["kind"] != "list") | (n["size"] != 2))
    return F.concat(
        _each(opened, "E011", lambda s: _says("Unclosed variable in Sub: ", s)),
        _each(
            F.filter(intrinsic(nodes, "Select"), out_of_range), "E011",
            lambda n: _says("Select index out of range: ", F.get(n["items"], F.lit(0))["value"]),
        ),
        _each(F.array_except(names, conditions), "E011", lambda n: _says("Condition not defined: ", n)),
        _each(bad_joins, "E011", lambda n: _says("Join needs a delimiter and a list: ", F.array_join(n["path"], "."))),
    )


def layout(text: Column) -> Column:
    is_json = F.ltrim(text, F.lit(WHITESPACE)).startswith("{")
    return F.concat(
        _when(~is_json & text.rlike(r"(?m)^[ ]*\t"), "E012", F.lit("Tab in indentation")),
        _when(is_json & F.try_parse_json(F.when(is_json, text)).isNull(), "E012", F.lit("Not valid JSON")),
    )


def template_cycle(nodes: Column) -> Column:
    return _when(F.exists(nodes, lambda n: n["circular"]), "E009", F.lit("Dependency cycle"))


def template_open_ingress(nodes: Column) -> Column:
    parent = lambda n: F.slice(n["path"], 1, F.size(n["path"]) - 1)
    in_group = lambda n: F.get(n["path"], F.lit(3)) == "SecurityGroupIngress"
    own_type = lambda n: node_at(nodes, F.concat(F.slice(n["path"], 1, 2), F.array(F.lit("Type"))))["value"]
    alone = lambda n: (F.size(n["path"]) == 4) & (own_type(n) == "AWS::EC2::SecurityGroupIngress")
    world = F.filter(
        nodes,
        lambda n: (n["key"] == "CidrIp") & (n["value"] == "0.0.0.0/0") & F.coalesce(in_group(n) | alone(n), F.lit(False)),
    )

    def wide(n):
        low = node_at(nodes, F.concat(parent(n), F.array(F.lit("FromPort"))))["value"]
        high = node_at(nodes, F.concat(parent(n), F.array(F.lit("ToPort"))))["value"]
        return F.coalesce((low == "0") & (high == "65535"), F.lit(False))

    return _when(F.exists(world, wide), "W001", F.lit("Ingress open to the world on all ports"))


def template_encryption(nodes: Column) -> Column:
    types = F.filter(_resource_types(nodes), lambda t: t["value"].isin(*ENCRYPTION_PROPERTIES))
    covered = F.array_intersect(_wanted(types, ENCRYPTION_PROPERTIES), _held(nodes))
    covered = F.transform(covered, lambda key: F.substring_index(key, OWNS, 1))
    bare = F.array_except(F.transform(types, lambda t: t["path"][1]), covered)
    return _each(bare, "W002", lambda name: _says("No encryption in ", name))


#: The nodes that all template checks together look at.
ALL_READS = list(dict.fromkeys([*(r for reads in READS.values() for r in reads), (None, None, None, ("ImageId",))]))


def template_findings(text: Column, nodes: Column) -> Column:
    return F.concat(
        layout(text), dangling_ref(nodes), required_properties(nodes), template_literals(nodes),
        intrinsics(nodes),
        template_cycle(nodes), template_open_ingress(nodes), template_encryption(nodes),
    )


# ---- rules learned from a corpus

#: The nodes that the two rules look at in templates.
TYPE_READS, DRIFT_READS = [resource_key("Type")], [PROPERTIES]

LEARNED_ROWS = 200_000  # a learned table up to this size is broadcast; a larger one is shuffled


def _learned(table: DataFrame) -> DataFrame:
    """A learned table, written once and counted: broadcast if it is small, so that a type which
    fills a third of the corpus never meets in one task; else adaptive execution splits its join."""
    once = materialized(table)
    return F.broadcast(once) if once.count() <= LEARNED_ROWS else once


def template_type_table(with_nodes: DataFrame) -> DataFrame:
    rows = with_nodes.select("doc_id", F.explode(_resource_types(F.col("nodes"))).alias("n"))
    return rows.select("doc_id", F.col("n.path")[1].alias("name"), F.col("n.value").alias("type"))


def unknown_types(resources: DataFrame, known: DataFrame) -> DataFrame:
    """Resources (doc_id, type, name) whose type no valid config uses."""
    return resources.join(_learned(known.select("type").distinct()), "type", "left_anti")


def literal_kind(line: Column) -> Column:
    value = F.regexp_extract(line, r"=\s*(.*?)\s*$", 1)
    return (
        F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .when(value.isin("true", "false"), "bool")
        .when(value.startswith('"'), "string")
        .when(value.startswith("["), "list")
        .otherwise("expression")
    )


def _against_majority(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows (doc_id, type, block, attribute, kind) of another kind than most of the corpus has.

    The majority table has one row per (type, attribute); counts are combined map-side, so a type
    that fills a third of the corpus costs nothing extra. Expressions are never judged.
    """
    literal = F.col("kind") != "expression"
    counts = corpus.filter(literal).groupBy("type", "attribute", "kind").agg(F.count("*").alias("n"))
    usual = counts.groupBy("type", "attribute").agg(F.max_by("kind", F.struct("n", "kind")).alias("usual_kind"))
    return (
        found.filter(literal)
        .join(_learned(usual), ["type", "attribute"])
        .filter(F.col("kind") != F.col("usual_kind"))
        .select("doc_id", "type", "block", "attribute", "kind", "usual_kind")
    )


def type_drift(configs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attributes written with another kind of literal than the corpus mostly uses for them."""

    def kinds(d: DataFrame) -> DataFrame:
        rows = attribute_table(d).withColumnRenamed("name", "attribute")
        return rows.withColumn("kind", literal_kind(F.col("text")))

    return _against_majority(kinds(configs), kinds(corpus))


def template_type_drift(configs: DataFrame, corpus: DataFrame) -> DataFrame:
    """The same for template properties; both inputs carry `nodes`."""

    def kinds(d: DataFrame) -> DataFrame:
        staged = d.select("doc_id", "text", F.explode(F.filter("nodes", is_property)).alias("p"))
        tagged = F.substring("text", F.col("p.start") + 1, F.lit(1)) == "!"
        return staged.select(
            "doc_id",
            F.col("p.owner_type").alias("type"),
            F.col("p.path")[1].alias("block"),
            F.col("p.key").alias("attribute"),
            F.when(tagged | F.col("p.called"), "expression").otherwise(F.col("p.kind")).alias("kind"),
        )

    return _against_majority(kinds(configs), kinds(corpus))
