"""The 19 faults of brace-structured configurations, as edit columns.

Each builder sees one document row (text and its resource spans) and yields an edit, or null when
the fault does not apply.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendset.functions.draws import pick
from mendset.functions.text import fill, first_match, let, strip
from mendset.operators.edits import Document, edit, fault, first_group_edit, part, text_of
from mendset.operators.structure_hcl import (
    attributes,
    block_spans,
    newlines,
    resource_refs,
    variable_refs,
)

# Arguments that each resource type cannot do without.
REQUIRED_ARGUMENTS = {
    "aws_instance": ["ami", "instance_type"],
    "aws_launch_configuration": ["image_id", "instance_type"],
    "aws_security_group": ["name"],
    "aws_subnet": ["vpc_id", "cidr_block"],
    "aws_vpc": ["cidr_block"],
    "aws_s3_bucket": [],
    "aws_db_instance": ["engine", "instance_class"],
    "aws_lambda_function": ["function_name", "handler", "runtime", "role"],
    "aws_iam_role": ["assume_role_policy"],
}

# Misspelt resource types.
TYPE_TYPOS = {
    "aws_instance": "aws_ec2_instance",
    "aws_s3_bucket": "aws_s3_storage",
    "aws_lambda_function": "aws_lambda",
    "aws_security_group": "aws_firewall_group",
    "aws_vpc": "aws_virtual_private_cloud",
    "aws_subnet": "aws_network_subnet",
    "aws_db_instance": "aws_rds_database",
    "aws_iam_role": "aws_iam_service_role",
}

# Wrong zones, bad literals and the added ingress rule.
WRONG_ZONES = ["ap-southeast-99a", "eu-fictional-1b", "us-nowhere-2c"]
BAD_AMI = "INVALID-ami-format"
BAD_CIDR = "999.999.999.999/33"
BAD_REGION = "us-fictional-1"
BAD_MODULE = "./nonexistent_module_path"
BAD_VERSION = ">= 99.0.0, < 99.0.1"
OPEN_INGRESS = """
  ingress {
    from_port   = 0
    to_port     = 65535
    protocol    = "tcp"
    cidr_blocks = ["0.0.0.0/0"]
  }"""

# Patterns of targets; groups are (prefix)(value)(suffix).
AMI = [r'(ami\s*=\s*")(ami-[0-9a-f]+)(")', r'(image_id\s*=\s*")(ami-[0-9a-f]+)(")']
CIDR = r'(")(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d{1,2})(")'
REGION = r'(region\s*=\s*")([\w-]+)(")'
ZONE = r'(availability_zone\s*=\s*")([\w-]+)(")'
VERSION = r'(version\s*=\s*")([^"]*)(")'
NETWORK_IDS = [r"(vpc_id\s*=\s*)(\S+)()", r"(subnet_id\s*=\s*)(\S+)()"]
SOURCE_LINE = r"(?m)(^[ \t]*source\s*=[^\n]*)"
SOURCE_VALUE = r'(source\s*=\s*)("[^"]*")()'
DEPENDS_ON = r"\n[ \t]*depends_on\s*=\s*\[[^\]]*\]"
NUMBER_VALUE, BOOLEAN_VALUE = r"(=\s*)(\d+)", r"(=\s*)(true|false)"
EQUALS = r"\s*=\s*"

# What an edit says about itself.
SAYS = {
    "brace": "Removed closing brace from resource %s.%s",
    "number": "Changed numeric value to string for %s",
    "boolean": "Changed boolean to string for %s",
    "equals": "Removed equals sign from attribute %s",
    "required": "Removed required argument '%s' from %s.%s",
    "argument": "Removed argument '%s' from %s.%s",
    "variable": "Changed variable reference from %s to %s",
    "resource": "Misspelled resource reference from %s to %s",
    "module": "Changed module source to non-existent path",
    "type": "Changed resource type from %s to %s",
    "ami": "Corrupted AMI ID from %s to %s",
    "cidr": "Changed CIDR from %s to %s",
    "region": "Changed region from %s to %s",
    "cycle": "Added circular dependency between %s and %s",
    "depends_on": "Removed depends_on declaration",
    "terraform": "Removed terraform/required_providers block",
    "provider": "Removed provider configuration block",
    "version": "Changed version constraint to impossible range: %s",
    "ingress": "Added overly permissive ingress rule (0.0.0.0/0 all TCP ports)",
    "encryption": "Removed %s",
    "network": "Replaced %s reference with hardcoded invalid ID",
    "zone": "Changed availability zone from %s to %s",
}

# Encryption settings in the order they are looked for.
ENCRYPTION = [
    (r"\n[ \t]*server_side_encryption_configuration\s*\{[^}]*\{[^}]*\}[^}]*\}", "server_side_encryption_configuration block"),
    (r"\n[ \t]*encrypted\s*=\s*true", "encrypted = true"),
    (r'\n[ \t]*kms_key_id\s*=\s*"[^"]*"', "kms_key_id"),
    (r"\n[ \t]*storage_encrypted\s*=\s*true", "storage_encrypted = true"),
]


def _says(what: str, *values: Column) -> Column:
    return fill(SAYS[what], *values)


def _place(b: Column) -> Column:
    return text_of('resource "', b["type"], '" "', b["name"], '"')


def _lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def _on_block(d: Document, fault_id: str, build) -> Column:
    """Draw one resource block and build on it."""
    return let(pick(d.blocks, d.draw(fault_id), given=True), lambda b: F.when(b.isNotNull(), build(b)))


def _whole_line(d: Document, a: Column) -> Column:
    """The part that removes an attribute's line together with one newline."""
    end = a["start"] + F.length(a["text"])
    has_newline = end < d.size
    return part(
        F.when(has_newline, a["start"]).otherwise(F.greatest(a["start"] - 1, F.lit(0))),
        F.when(has_newline, end + 1).otherwise(end),
        "",
    )


@fault("SYNTACTIC.missing_closing_brace")
def missing_closing_brace(d: Document) -> Column:
    def build(b):
        at = b["end"] - 1
        lo = F.greatest(at - 20, F.lit(0))
        return edit(
            [part(at, b["end"], "")],
            d.slice(lo, at + 20),
            F.concat(d.slice(lo, at), d.slice(at + 1, at + 20)),
            _place(b),
            _says("brace", b["type"], b["name"]),
        )

    return _on_block(d, "SYNTACTIC.missing_closing_brace", build)


@fault("SYNTACTIC.wrong_attribute_type")
def wrong_attribute_type(d: Document) -> Column:
    number, boolean = NUMBER_VALUE, BOOLEAN_VALUE

    def build(b):
        typed = F.filter(attributes(b), lambda a: a["text"].rlike(f"{number}|{boolean}"))

        def change(a):
            is_number = a["text"].rlike(number)
            regex = lambda g: F.when(is_number, F.regexp_extract(a["text"], number, g)).otherwise(
                F.regexp_extract(a["text"], boolean, g)
            )
            before = F.when(is_number, F.split(a["text"], number, 2)[0]).otherwise(
                F.split(a["text"], boolean, 2)[0]
            )
            new = F.when(is_number, text_of('"', a["name"], '_value"')).otherwise(F.lit('"yes"'))
            start = a["start"] + F.length(before) + F.length(regex(1))
            tail = F.length(before) + F.length(regex(0))
            line = F.concat(
                before, regex(1), new, F.substring(a["text"], tail + 1, F.length(a["text"]))
            )
            return edit(
                [part(start, start + F.length(regex(2)), new)],
                strip(a["text"]),
                strip(line),
                text_of(_place(b), ", attribute ", a["name"]),
                F.when(is_number, _says("number", a["name"])).otherwise(_says("boolean", a["name"])),
            )

        return let(F.get(typed, F.lit(0)), lambda a: F.when(a.isNotNull(), change(a)))

    return _on_block(d, "SYNTACTIC.wrong_attribute_type", build)


@fault("SYNTACTIC.invalid_hcl_syntax")
def invalid_hcl_syntax(d: Document) -> Column:
    me = "SYNTACTIC.invalid_hcl_syntax"

    def build(b):
        def change(a):
            cut = F.split(a["text"], EQUALS, 2)
            start = a["start"] + F.length(cut[0])
            end = a["start"] + F.length(a["text"]) - F.length(cut[1])
            return edit(
                [part(start, end, " ")],
                strip(a["text"]),
                strip(F.concat_ws(" ", cut[0], cut[1])),
                text_of(_place(b), ", line ", (a["line"] + 1).cast("string")),
                _says("equals", a["name"]),
            )

        chosen = pick(attributes(b), d.draw(me, "attribute"))
        return let(chosen, lambda a: F.when(a.isNotNull(), change(a)))

    return _on_block(d, me, build)


@fault("SYNTACTIC.missing_required_argument")
def missing_required_argument(d: Document) -> Column:
    me = "SYNTACTIC.missing_required_argument"
    required = F.create_map(
        *[x for k, v in REQUIRED_ARGUMENTS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))]
    )
    # blocks in drawn order, each with its attributes and the first required one among them
    shuffled = F.array_sort(
        F.transform(
            d.blocks,
            lambda b, i: F.struct(d.draw(me, i.cast("string")).alias("order"), i.alias("i"), b.alias("b")),
        )
    )

    def candidate(s):
        wanted = F.coalesce(F.try_element_at(required, s["b"]["type"]), F.array().cast("array<string>"))
        return F.struct(
            s["b"].alias("b"),
            F.get(
                F.filter(attributes(s["b"]), lambda a: F.array_contains(wanted, a["name"])), F.lit(0)
            ).alias("a"),
        )

    def change(b, a, label):
        return edit(
            [_whole_line(d, a)],
            strip(a["text"]),
            "(line removed)",
            _place(b),
            _says(label, a["name"], b["type"], b["name"]),
        )

    def build(order):
        typed = F.filter(order, lambda s: s["b"]["type"].isin(*[t for t, v in REQUIRED_ARGUMENTS.items() if v]))
        hit = F.get(F.filter(F.transform(typed, candidate), lambda c: c["a"].isNotNull()), F.lit(0))
        first = F.get(order, F.lit(0))["b"]
        fallback = let(
            F.get(attributes(first), F.lit(0)),
            lambda a: F.when(a.isNotNull(), change(first, a, "argument")),
        )
        return let(
            hit,
            lambda h: F.when(h.isNotNull(), change(h["b"], h["a"], "required")).otherwise(fallback),
        )

    return F.when(F.size(d.blocks) > 0, let(shuffled, build))


@fault("REFERENCE.undefined_variable", sees="scans")
def undefined_variable(d: Document) -> Column:
    me = "REFERENCE.undefined_variable"

    def build(r):
        old = text_of("var.", r["name"])
        new = text_of(old, "_undefined")
        return edit(
            [part(r["start"], r["start"] + F.length(old), new)],
            old,
            new,
            text_of("offset ", r["start"].cast("string")),
            _says("variable", old, new),
        )

    return let(pick(variable_refs(d.text), d.draw(me)), lambda r: F.when(r.isNotNull(), build(r)))


@fault("REFERENCE.bad_resource_reference", sees="scans")
def bad_resource_reference(d: Document) -> Column:
    me = "REFERENCE.bad_resource_reference"

    def build(r):
        old = text_of(r["type"], ".", r["name"])
        new = text_of(old, "_typo")
        return edit(
            [part(r["start"], r["start"] + F.length(old), new)],
            old,
            new,
            text_of("offset ", r["start"].cast("string")),
            _says("resource", old, new),
        )

    return let(pick(resource_refs(d.text), d.draw(me)), lambda r: F.when(r.isNotNull(), build(r)))


@fault("REFERENCE.broken_module_source", sees="scans")
def broken_module_source(d: Document) -> Column:
    me = "REFERENCE.broken_module_source"

    def build(b):
        body = d.slice(b["start"], b["end"])

        def change(m):
            old_line = m["found"]

            def swap(start, value, prefix):
                at = b["start"] + m["start"] + start
                line = newlines(d.slice(F.lit(0), at)) + 1
                return edit(
                    [part(at, at + F.length(value), f'"{BAD_MODULE}"')],
                    strip(old_line),
                    strip(F.regexp_replace(old_line, SOURCE_VALUE, f'$1"{BAD_MODULE}"')),
                    text_of("module block, line ", line.cast("string")),
                    _says("module"),
                )

            return first_group_edit(old_line, [SOURCE_VALUE], swap)

        return let(first_match(body, SOURCE_LINE), lambda m: F.when(m.isNotNull(), change(m)))

    return let(
        pick(block_spans(d.text, "module"), d.draw(me)), lambda b: F.when(b.isNotNull(), build(b))
    )


@fault("SEMANTIC.invalid_resource_type")
def invalid_resource_type(d: Document) -> Column:
    def build(b):
        new = _lookup(TYPE_TYPOS, b["type"], text_of(b["type"], "_invalid"))
        head = F.regexp_extract(
            d.slice(b["start"], b["end"]), r'^([ \t]*resource\s+")[^"]+"', 1
        )
        start = b["start"] + F.length(head)
        return edit(
            [part(start, start + F.length(b["type"]), new)],
            text_of('resource "', b["type"], '"'),
            text_of('resource "', new, '"'),
            _place(b),
            _says("type", b["type"], new),
        )

    return _on_block(d, "SEMANTIC.invalid_resource_type", build)


@fault("SEMANTIC.bad_ami_format", sees="text")
def bad_ami_format(d: Document) -> Column:
    def build(start, value, _):
        return edit(
            [part(start, start + F.length(value), BAD_AMI)],
            value,
            BAD_AMI,
            text_of("AMI ID at offset ", start.cast("string")),
            _says("ami", value, F.lit(BAD_AMI)),
        )

    return first_group_edit(d.text, AMI, build, d.plain)


@fault("SEMANTIC.invalid_cidr", sees="text")
def invalid_cidr(d: Document) -> Column:
    def build(start, value, _):
        return edit(
            [part(start, start + F.length(value), BAD_CIDR)],
            value,
            BAD_CIDR,
            text_of("CIDR block at offset ", start.cast("string")),
            _says("cidr", value, F.lit(BAD_CIDR)),
        )

    return first_group_edit(d.text, [CIDR], build, d.plain)


@fault("SEMANTIC.invalid_region", sees="text")
def invalid_region(d: Document) -> Column:
    def build(start, value, _):
        return edit(
            [part(start, start + F.length(value), BAD_REGION)],
            value,
            BAD_REGION,
            text_of("region at offset ", start.cast("string")),
            _says("region", value, F.lit(BAD_REGION)),
        )

    return first_group_edit(d.text, [REGION], build, d.plain)


@fault("DEPENDENCY.circular_dependency")
def circular_dependency(d: Document) -> Column:
    def build(a, b):
        to_b = text_of("  depends_on = [", b["type"], ".", b["name"], "]")
        to_a = text_of("  depends_on = [", a["type"], ".", a["name"], "]")
        return edit(
            [
                part(a["end"] - 1, a["end"] - 1, text_of("\n", to_b, "\n")),
                part(b["end"] - 1, b["end"] - 1, text_of("\n", to_a, "\n")),
            ],
            "(no depends_on)",
            text_of(to_b, "\n", to_a),
            text_of(a["type"], ".", a["name"], " <-> ", b["type"], ".", b["name"]),
            _says("cycle", a["name"], b["name"]),
        )

    return F.when(F.size(d.blocks) >= 2, build(F.get(d.blocks, F.lit(0)), F.get(d.blocks, F.lit(1))))


@fault("DEPENDENCY.missing_depends_on", sees="text")
def missing_depends_on(d: Document) -> Column:
    def build(m):
        return edit(
            [part(m["start"], m["start"] + F.length(m["found"]), "")],
            strip(m["found"]),
            "(removed)",
            text_of("offset ", m["start"].cast("string")),
            _says("depends_on"),
        )

    hit = d.first_match(DEPENDS_ON)
    return let(hit, lambda m: F.when(m.isNotNull(), build(m)))


@fault("PROVIDER.missing_provider", sees="scans")
def missing_provider(d: Document) -> Column:
    def remove(kind: str) -> Column:
        def build(b):
            body = d.slice(b["start"], b["end"])
            return edit(
                [part(b["start"], b["end"], "")],
                F.when(F.length(body) > 80, text_of(F.left(body, F.lit(80)), "...")).otherwise(body),
                "(block removed)",
                f"{kind} block",
                _says(kind),
            )

        first = F.get(block_spans(d.text, kind), F.lit(0))
        return let(first, lambda b: F.when(b.isNotNull(), build(b)))

    return F.coalesce(remove("terraform"), remove("provider"))


@fault("PROVIDER.version_constraint_mismatch", sees="text")
def version_constraint_mismatch(d: Document) -> Column:
    def build(start, value, _):
        return edit(
            [part(start, start + F.length(value), BAD_VERSION)],
            value,
            BAD_VERSION,
            text_of("version constraint at offset ", start.cast("string")),
            _says("version", F.lit(BAD_VERSION)),
        )

    # the pattern is not anchored, so it also finds required_version
    return first_group_edit(d.text, [VERSION], build, d.plain)


@fault("SECURITY.overly_permissive_security_group")
def overly_permissive_security_group(d: Document) -> Column:
    def build(b):
        return edit(
            [part(b["end"] - 1, b["end"] - 1, OPEN_INGRESS + "\n")],
            "(security group without open ingress)",
            OPEN_INGRESS.strip(),
            text_of('resource "aws_security_group" "', b["name"], '"'),
            _says("ingress"),
        )

    groups = F.filter(d.blocks, lambda b: b["type"] == "aws_security_group")
    return let(F.get(groups, F.lit(0)), lambda b: F.when(b.isNotNull(), build(b)))


@fault("SECURITY.missing_encryption", sees="text")
def missing_encryption(d: Document) -> Column:
    def one(pattern: str, what: str) -> Column:
        def build(m):
            return edit(
                [part(m["start"], m["start"] + F.length(m["found"]), "")],
                F.left(strip(m["found"]), F.lit(80)),
                "(removed)",
                "encryption config",
                _says("encryption", F.lit(what)),
            )

        return let(d.first_match(pattern), lambda m: F.when(m.isNotNull(), build(m)))

    # a word of the pattern is found sooner than that the pattern is nowhere
    word = lambda p: max(re.findall(r"[a-z_]{4,}", p), key=len)
    return F.coalesce(*[F.when(d.text.contains(word(p)), one(p, w)) for p, w in ENCRYPTION])


@fault("CROSS_RESOURCE.subnet_vpc_mismatch", sees="text")
def subnet_vpc_mismatch(d: Document) -> Column:
    def build(start, value, prefix):
        fake = F.when(prefix.contains("vpc_id"), F.lit('"vpc-00000000"')).otherwise(F.lit('"subnet-00000000"'))
        return edit(
            [part(start, start + F.length(value), fake)],
            F.concat(prefix, value),
            F.concat(prefix, fake),
            text_of("offset ", start.cast("string")),
            _says("network", strip(prefix)),
        )

    return first_group_edit(d.text, NETWORK_IDS, build, d.plain)


@fault("CROSS_RESOURCE.wrong_az_reference", sees="text")
def wrong_az_reference(d: Document) -> Column:
    me = "CROSS_RESOURCE.wrong_az_reference"
    zone = pick(F.array(*[F.lit(z) for z in WRONG_ZONES]), d.draw(me))

    def build(start, value, _):
        return edit(
            [part(start, start + F.length(value), zone)],
            value,
            zone,
            text_of("availability_zone at offset ", start.cast("string")),
            _says("zone", value, zone),
        )

    return first_group_edit(d.text, [ZONE], build, d.plain)
