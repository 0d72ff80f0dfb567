"""The 18 faults of YAML/JSON templates, as edit columns over the document's node array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendset.functions.draws import pick
from mendset.functions.text import WHITESPACE, fill, let, strip
from mendset.operators.edits import Document, edit, fault, part, text_of
from mendset.operators.structure_template import (
    PROPERTIES,
    RESOURCES,
    calls_of,
    intrinsic,
    names_of,
    resource_key,
    section_names,
)

# Properties each resource type cannot do without.
REQUIRED_PROPERTIES = {
    "AWS::EC2::Instance": ["ImageId"],
    "AWS::EC2::SecurityGroup": ["GroupDescription"],
    "AWS::EC2::Subnet": ["VpcId", "CidrBlock"],
    "AWS::EC2::VPC": ["CidrBlock"],
    "AWS::EC2::InternetGateway": [],
    "AWS::EC2::RouteTable": ["VpcId"],
    "AWS::EC2::Route": ["RouteTableId"],
    "AWS::S3::Bucket": [],
    "AWS::RDS::DBInstance": ["DBInstanceClass", "Engine"],
    "AWS::Lambda::Function": ["Code", "Handler", "Role", "Runtime"],
    "AWS::IAM::Role": ["AssumeRolePolicyDocument"],
    "AWS::IAM::Policy": ["PolicyDocument", "PolicyName"],
    "AWS::SNS::Topic": [],
    "AWS::SQS::Queue": [],
    "AWS::DynamoDB::Table": ["KeySchema", "AttributeDefinitions"],
    "AWS::ECS::Cluster": [],
    "AWS::ECS::TaskDefinition": ["ContainerDefinitions"],
    "AWS::ECS::Service": ["TaskDefinition"],
    "AWS::ElasticLoadBalancingV2::LoadBalancer": [],
    "AWS::ElasticLoadBalancingV2::TargetGroup": [],
    "AWS::AutoScaling::AutoScalingGroup": ["MinSize", "MaxSize"],
    "AWS::AutoScaling::LaunchConfiguration": ["ImageId", "InstanceType"],
    "AWS::CloudWatch::Alarm": ["ComparisonOperator", "EvaluationPeriods", "MetricName", "Namespace", "Period", "Statistic", "Threshold"],
}

# Misspelt resource types.
TYPE_TYPOS = {
    "AWS::EC2::Instance": "AWS::EC2::VirtualMachine",
    "AWS::S3::Bucket": "AWS::S3::Storage",
    "AWS::Lambda::Function": "AWS::Lambda::Lambda",
    "AWS::RDS::DBInstance": "AWS::RDS::Database",
    "AWS::IAM::Role": "AWS::IAM::ServiceRole",
    "AWS::EC2::SecurityGroup": "AWS::EC2::FirewallGroup",
    "AWS::EC2::VPC": "AWS::EC2::VirtualPrivateCloud",
    "AWS::DynamoDB::Table": "AWS::DynamoDB::Database",
    "AWS::SNS::Topic": "AWS::SNS::Notification",
    "AWS::SQS::Queue": "AWS::SQS::MessageQueue",
}

# Bad property values, in the order they are tried.
BAD_VALUES = {
    "InstanceType": "x1.superlarge",
    "Engine": "postgres-invalid-engine",
    "Runtime": "python2.5",
    "Protocol": "INVALID",
}

# Encryption properties by type.
ENCRYPTION_PROPERTIES = {
    "AWS::S3::Bucket": ["BucketEncryption"],
    "AWS::RDS::DBInstance": ["StorageEncrypted", "KmsKeyId"],
    "AWS::EBS::Volume": ["Encrypted", "KmsKeyId"],
    "AWS::DynamoDB::Table": ["SSESpecification"],
}

# Replacements, the added rule, and what an edit says about itself.
BAD_AMI = "INVALID-ami-format"
BAD_CONDITION = "NonExistentCondition"
BAD_JOIN = "invalid-join-not-a-list"
OPEN_SUB = " ${UndefinedVar"
SAYS = {
    "tab": "Inserted tab character in YAML indentation",
    "comma": "Added trailing comma to create invalid JSON",
    "list": "Changed list property %s to string",
    "map": "Changed dict property %s to string",
    "required": "Removed required property '%s' from %s",
    "property": "Removed property '%s' from %s",
    "ref": "Changed Ref target from %s to %s",
    "getatt": "Corrupted GetAtt resource reference",
    "parameter": "Removed parameter '%s' that is referenced in Resources",
    "type": "Changed resource type from %s to %s",
    "value": "Changed %s to invalid value '%s'",
    "ami": "Corrupted AMI ID from %s to %s",
    "cycle": "Created circular DependsOn between %s and %s",
    "depends_on": "Removed DependsOn from %s",
    "sub": "Added unclosed variable reference in !Sub",
    "select": "Set !Select index to 999 (out of bounds)",
    "if": "Changed !If condition from '%s' to '%s'",
    "join": "Changed !Join value to invalid string (should be [delimiter, list])",
    "ingress": "Added overly permissive ingress rule to %s",
    "encryption": "Removed encryption property '%s' from %s",
}
OPEN_RULE = [("IpProtocol", "tcp"), ("FromPort", "0"), ("ToPort", "65535"), ("CidrIp", "0.0.0.0/0")]


def _says(what: str, *values: Column) -> Column:
    return fill(SAYS[what], *values)


def _list_map(table: dict[str, list[str]]) -> Column:
    return F.create_map(
        *[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]).cast("array<string>"))]
    )


def _source(d: Document, n: Column) -> Column:
    return d.slice(n["start"], n["end"])


def _styled(d: Document, n: Column, value: Column | str) -> Column:
    """A scalar written the way the one it replaces was: same quotes; quoted inside JSON."""
    v = F.lit(value) if isinstance(value, str) else value
    q = d.slice(n["start"], n["start"] + 1)
    return F.when(q.isin('"', "'"), F.concat(q, v, q)).when(d.is_json, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)


def _replace(d: Document, n: Column, value: Column | str) -> Column:
    return part(n["start"], n["end"], _styled(d, n, value))


def _cut(n: Column) -> Column:
    return part(n["cut_start"], n["cut_end"], n["cut_text"])


def _dotted(n: Column) -> Column:
    return F.array_join(n["path"], ".")


def _first(nodes: Column, test, build) -> Column:
    return let(F.get(F.filter(nodes, test), F.lit(0)), lambda n: F.when(n.isNotNull(), build(n)))


def _resources(d: Document) -> Column:
    return F.filter(d.top, lambda n: (F.size(n["path"]) == 2) & (n["path"][0] == "Resources"))


def _resource_keys(d: Document, key: str) -> Column:
    return F.filter(
        d.top,
        lambda n: (n["key"] == key) & (F.size(n["path"]) == 3) & (n["path"][0] == "Resources"),
    )


def _listed_property(d: Document, table: dict[str, list[str]]) -> Column:
    """First resource (in order) that has one of its type's properties: struct(type, node)."""
    wanted = _list_map(table)

    def of_type(props: Column):
        def one(t: Column) -> Column:
            names = F.try_element_at(wanted, t["value"])
            hits = F.transform(
                names,
                lambda name: F.get(
                    F.filter(props, lambda p: (p["key"] == name) & (p["path"][1] == t["path"][1])), F.lit(0)
                ),
            )
            return F.struct(
                t["value"].alias("type"),
                F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0)).alias("node"),
            )

        return one

    return let(
        d.properties,
        lambda props: F.get(
            F.filter(
                F.transform(_resource_keys(d, "Type"), of_type(props)), lambda h: h["node"].isNotNull()
            ),
            F.lit(0),
        ),
    )


def _line_fault(d: Document, fault_id: str, keep, change, description: Column) -> Column:
    """Draw one line among those kept and rewrite it; only the place of the line drawn is summed up."""

    def drawn(lines: Column) -> Column:
        kept = F.filter(F.transform(lines, lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())
        return let(pick(kept, d.draw(fault_id)), lambda i: F.when(i.isNotNull(), placed(lines, i)))

    def placed(lines: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda at, x: at + F.length(x) + 1)
        return F.struct(start.alias("start"), i.alias("line"), F.get(lines, i).alias("text"))

    def build(c: Column) -> Column:
        start, end, new, line = change(c)
        return edit(
            [part(start, end, new)],
            strip(c["text"]),
            strip(line),
            text_of("line ", (c["line"] + 1).cast("string")),
            description,
        )

    chosen = let(F.split(d.text, "\n", -1), drawn)
    return let(chosen, lambda c: F.when(c.isNotNull(), build(c)))


@fault("SYNTACTIC.invalid_yaml", reads=[])
def invalid_yaml(d: Document) -> Column:
    def change(c):
        body = F.ltrim(c["text"], F.lit(WHITESPACE))
        indent = F.length(c["text"]) - F.length(body)
        return c["start"], c["start"] + indent, F.lit("\t"), F.concat(F.lit("\t"), body)

    keep = lambda x: x.contains(":") & ~F.ltrim(x, F.lit(WHITESPACE)).startswith("#")
    found = _line_fault(
        d, "SYNTACTIC.invalid_yaml", keep, change, _says("tab")
    )
    return F.when(~d.is_json, found)


@fault("SYNTACTIC.invalid_json_template", reads=[])
def invalid_json_template(d: Document) -> Column:
    def change(c):
        kept = F.rtrim(c["text"], F.lit(WHITESPACE))
        return c["start"] + F.length(kept), c["start"] + F.length(c["text"]), F.lit(","), F.concat(kept, F.lit(","))

    keep = lambda x: F.right(F.rtrim(x, F.lit(WHITESPACE)), F.lit(1)).isin("}", '"')
    found = _line_fault(
        d, "SYNTACTIC.invalid_json_template", keep, change, _says("comma")
    )
    return F.when(d.is_json, found)


@fault("SYNTACTIC.wrong_property_type", reads=[PROPERTIES])
def wrong_property_type(d: Document) -> Column:
    def build(n):
        is_list = n["kind"] == "list"
        bad = F.when(is_list, F.lit("not-a-list")).otherwise(F.lit("not-a-dict"))
        return edit(
            [_replace(d, n, bad)],
            text_of(n["key"], ": ", F.left(_source(d, n), F.lit(60))),
            text_of(n["key"], ': "', bad, '"'),
            _dotted(n),
            F.when(is_list, _says("list", n["key"])).otherwise(_says("map", n["key"])),
        )

    # a property whose map is an intrinsic call is left alone
    return _first(d.properties, lambda n: (n["kind"] == "list") | ((n["kind"] == "map") & ~n["called"]), build)


@fault("SYNTACTIC.missing_required_property", reads=[PROPERTIES, resource_key("Type")])
def missing_required_property(d: Document) -> Column:
    def build(n, description):
        return edit(
            [_cut(n)],
            text_of(n["key"], ": ", F.left(_source(d, n), F.lit(60))),
            "(property removed)",
            _dotted(n),
            description,
        )

    def fallback(n):
        own_type = F.get(
            F.filter(_resource_keys(d, "Type"), lambda t: t["path"][1] == n["path"][1]), F.lit(0)
        )["value"]
        return build(n, _says("property", n["key"], F.coalesce(own_type, F.lit("unknown"))))

    return let(
        _listed_property(d, REQUIRED_PROPERTIES),
        lambda h: F.when(
            h.isNotNull(),
            build(h["node"], _says("required", h["node"]["key"], h["type"])),
        ).otherwise(_first(d.properties, lambda n: F.lit(True), fallback)),
    )


@fault("REFERENCE.broken_ref", reads=[names_of("Resources"), names_of("Parameters"), calls_of("Ref")])
def broken_ref(d: Document) -> Column:
    me = "REFERENCE.broken_ref"

    def build(n):
        bad = text_of(n["value"], "Nonexistent")
        return edit(
            [_replace(d, n, bad)],
            text_of("Ref: ", n["value"]),
            text_of("Ref: ", bad),
            _dotted(n),
            _says("ref", n["value"], bad),
        )

    known = F.concat(section_names(d.top, "Resources"), section_names(d.top, "Parameters"))
    hits = let(known, lambda k: F.filter(intrinsic(d.calls, "Ref"), lambda n: F.array_contains(k, n["value"])))
    return let(pick(hits, d.draw(me)), lambda n: F.when(n.isNotNull(), build(n)))


@fault("REFERENCE.bad_getatt", reads=[calls_of("GetAtt")])
def bad_getatt(d: Document) -> Column:
    me = "REFERENCE.bad_getatt"

    def build(n):
        text_form = (n["kind"] == "str") & n["value"].contains(".")
        list_form = (n["kind"] == "list") & (n["size"] >= 2)
        head, attribute = F.split(n["value"], r"\.", 2)[0], F.split(n["value"], r"\.", 2)[1]
        item = F.get(n["items"], F.lit(0))
        bad = F.when(text_form, text_of(head, "Broken.", attribute)).otherwise(
            text_of(item["value"], "Broken.", F.get(n["items"], F.lit(1))["value"])
        )
        change = F.when(text_form, _replace(d, n, bad)).otherwise(
            _replace(d, item, text_of(item["value"], "Broken"))
        )
        return F.when(
            text_form | list_form,
            edit(
                [change],
                text_of("GetAtt: ", _source(d, n)),
                text_of("GetAtt: ", bad),
                _dotted(n),
                _says("getatt"),
            ),
        )

    return let(
        pick(intrinsic(d.calls, "GetAtt"), d.draw(me)), lambda n: F.when(n.isNotNull(), build(n))
    )


@fault("REFERENCE.undefined_parameter", reads=[(1, None, None, ("Parameters",)), names_of("Parameters"), calls_of("Ref")])
def undefined_parameter(d: Document) -> Column:
    me = "REFERENCE.undefined_parameter"
    parameters = F.filter(d.top, lambda n: (F.size(n["path"]) == 2) & (n["path"][0] == "Parameters"))
    section = F.get(
        F.filter(d.top, lambda n: (F.size(n["path"]) == 1) & (n["key"] == "Parameters")), F.lit(0)
    )

    def build(ref):
        own = F.get(F.filter(parameters, lambda p: p["key"] == ref["value"]), F.lit(0))
        return let(
            F.when(section["size"] == 1, section).otherwise(own),
            lambda gone: edit(
                [_cut(gone)],
                text_of("Parameter: ", ref["value"]),
                "(parameter removed)",
                text_of("Parameters.", ref["value"]),
                _says("parameter", ref["value"]),
            ),
        )

    names = section_names(d.top, "Parameters")
    hits = let(names, lambda k: F.filter(intrinsic(d.calls, "Ref"), lambda n: F.array_contains(k, n["value"])))
    return let(pick(hits, d.draw(me)), lambda n: F.when(n.isNotNull(), build(n)))


@fault("SEMANTIC.cf_invalid_resource_type", reads=[resource_key("Type")])
def cf_invalid_resource_type(d: Document) -> Column:
    typos = F.create_map(*[F.lit(x) for kv in TYPE_TYPOS.items() for x in kv])
    bad_type = lambda t: F.coalesce(F.try_element_at(typos, t), F.concat(t, F.lit("Invalid")))

    def build(n):
        return let(
            bad_type(n["value"]),
            lambda bad: edit(
                [_replace(d, n, bad)],
                text_of("Type: ", n["value"]),
                text_of("Type: ", bad),
                _dotted(n),
                _says("type", n["value"], bad),
            ),
        )

    return _first(_resource_keys(d, "Type"), lambda n: n["value"].startswith("AWS::"), build)


@fault("SEMANTIC.wrong_property_value", reads=[PROPERTIES])
def wrong_property_value(d: Document) -> Column:
    bad_values = F.create_map(*[F.lit(x) for kv in BAD_VALUES.items() for x in kv])
    order = F.array(*[F.lit(k) for k in BAD_VALUES])

    def build(n):
        bad = F.try_element_at(bad_values, n["key"])
        return edit(
            [_replace(d, n, bad)],
            text_of(n["key"], ": ", n["value"]),
            text_of(n["key"], ": ", bad),
            _dotted(n),
            _says("value", n["key"], bad),
        )

    # first resource with a hit; inside it the order of the value table decides
    hits = F.filter(d.properties, lambda n: n["key"].isin(*BAD_VALUES) & (n["kind"] == "str"))
    best = let(
        hits,
        lambda h: F.get(
            F.array_sort(
                F.transform(
                    F.filter(h, lambda n: n["path"][1] == F.get(h, F.lit(0))["path"][1]),
                    lambda n: F.struct(F.array_position(order, n["key"]).alias("o"), n["start"].alias("s"), n.alias("n")),
                ),
                lambda x, y: (x["o"] - y["o"]).cast("int"),
            ),
            F.lit(0),
        )["n"],
    )
    return let(best, lambda n: F.when(n.isNotNull(), build(n)))


@fault("SEMANTIC.cf_bad_ami", reads=[PROPERTIES])
def cf_bad_ami(d: Document) -> Column:
    def build(n):
        return edit(
            [_replace(d, n, BAD_AMI)],
            text_of("ImageId: ", n["value"]),
            text_of("ImageId: ", BAD_AMI),
            _dotted(n),
            _says("ami", n["value"], F.lit(BAD_AMI)),
        )

    return _first(d.properties, lambda n: (n["key"] == "ImageId") & (n["kind"] == "str"), build)


def _new_entry(d: Document, owner: Column, key: str, block: Column, flow: Column) -> Column:
    """The part that puts a first entry into a map."""
    tail = F.when(owner["size"] > 0, F.lit(", ")).otherwise(F.lit(""))
    indent = F.rpad(F.lit(""), owner["column"], F.lit(" "))
    return F.when(
        owner["flow"],
        part(owner["start"] + 1, owner["start"] + 1, text_of(f'"{key}": ', flow, tail)),
    ).otherwise(part(owner["start"], owner["start"], text_of(f"{key}: ", block, "\n", indent)))


@fault("DEPENDENCY.circular_depends_on", reads=[RESOURCES, resource_key("DependsOn")])
def circular_depends_on(d: Document) -> Column:
    def point(owner, target):
        held = F.get(
            F.filter(_resource_keys(d, "DependsOn"), lambda n: n["path"][1] == owner["key"]), F.lit(0)
        )
        quoted = text_of('["', target["key"], '"]')
        plain = text_of("[", target["key"], "]")
        fresh = _new_entry(d, owner, "DependsOn", plain, quoted)
        return let(
            held,
            lambda h: F.when(
                h.isNotNull(), part(h["start"], h["end"], F.when(d.is_json, quoted).otherwise(plain))
            ).otherwise(fresh),
        )

    def build(a, b):
        return edit(
            [point(a, b), point(b, a)],
            "(no circular dependency)",
            text_of(a["key"], " -> ", b["key"], " -> ", a["key"]),
            text_of("Resources.", a["key"], " <-> Resources.", b["key"]),
            _says("cycle", a["key"], b["key"]),
        )

    return let(
        _resources(d),
        lambda r: F.when(F.size(r) >= 2, build(F.get(r, F.lit(0)), F.get(r, F.lit(1)))),
    )


@fault("DEPENDENCY.missing_dependency", reads=[resource_key("DependsOn")])
def missing_dependency(d: Document) -> Column:
    def build(n):
        return edit(
            [_cut(n)],
            text_of("DependsOn: ", _source(d, n)),
            "(DependsOn removed)",
            _dotted(n),
            _says("depends_on", n["path"][1]),
        )

    return _first(_resource_keys(d, "DependsOn"), lambda n: F.lit(True), build)


@fault("INTRINSIC.malformed_sub", reads=[calls_of("Sub")])
def malformed_sub(d: Document) -> Column:
    me = "INTRINSIC.malformed_sub"
    tail = OPEN_SUB

    def build(n):
        text_form = n["kind"] == "str"
        item = F.get(n["items"], F.lit(0))
        list_form = (n["kind"] == "list") & (item["kind"] == "str")
        at = F.when(text_form, F.struct(n["start"].alias("start"), n["end"].alias("end"))).otherwise(
            F.struct(item["start"].alias("start"), item["end"].alias("end"))
        )

        def insert(s):
            source = d.slice(s["start"], s["end"])
            quoted = F.substring(source, 1, 1).isin('"', "'") & (F.length(source) >= 2)
            # a plain scalar inside [..] or {..} could not hold the brace, so it gets quotes
            wrap = (n["flow"] | ~text_form) & ~quoted
            change = (
                F.when(quoted, part(s["end"] - 1, s["end"] - 1, tail))
                .when(wrap, part(s["start"], s["end"], text_of('"', source, tail, '"')))
                .otherwise(part(s["end"], s["end"], tail))
            )
            value = F.coalesce(n["value"], item["value"])
            return edit(
                [change],
                text_of("Sub: ", F.left(value, F.lit(60))),
                text_of("Sub: ", F.left(text_of(value, tail), F.lit(60))),
                _dotted(n),
                _says("sub"),
            )

        return F.when(text_form | list_form, let(at, insert))

    return let(pick(intrinsic(d.calls, "Sub"), d.draw(me)), lambda n: F.when(n.isNotNull(), build(n)))


@fault("INTRINSIC.wrong_select_index", reads=[calls_of("Select")])
def wrong_select_index(d: Document) -> Column:
    me = "INTRINSIC.wrong_select_index"

    def build(n):
        index = F.get(n["items"], F.lit(0))
        return F.when(
            (n["kind"] == "list") & (n["size"] == 2),
            edit(
                [part(index["start"], index["end"], "999")],
                text_of("Select: [", F.coalesce(index["value"], _source(d, index)), ", ...]"),
                "Select: [999, ...]",
                _dotted(n),
                _says("select"),
            ),
        )

    return let(
        pick(intrinsic(d.calls, "Select"), d.draw(me)), lambda n: F.when(n.isNotNull(), build(n))
    )


@fault("INTRINSIC.bad_if_condition", reads=[calls_of("If")])
def bad_if_condition(d: Document) -> Column:
    me = "INTRINSIC.bad_if_condition"

    def build(n):
        name = F.get(n["items"], F.lit(0))
        old = F.coalesce(name["value"], _source(d, name))
        return F.when(
            (n["kind"] == "list") & (n["size"] >= 1),
            edit(
                [_replace(d, name, BAD_CONDITION)],
                text_of("If: [", old, ", ...]"),
                f"If: [{BAD_CONDITION}, ...]",
                _dotted(n),
                _says("if", old, F.lit(BAD_CONDITION)),
            ),
        )

    return let(pick(intrinsic(d.calls, "If"), d.draw(me)), lambda n: F.when(n.isNotNull(), build(n)))


@fault("INTRINSIC.invalid_join", reads=[calls_of("Join")])
def invalid_join(d: Document) -> Column:
    me = "INTRINSIC.invalid_join"
    bad = BAD_JOIN

    def build(n):
        return edit(
            [_replace(d, n, bad)],
            text_of("Join: ", F.left(_source(d, n), F.lit(60))),
            f'Join: "{bad}"',
            _dotted(n),
            _says("join"),
        )

    return let(pick(intrinsic(d.calls, "Join"), d.draw(me)), lambda n: F.when(n.isNotNull(), build(n)))


@fault("SECURITY.open_ingress", reads=[PROPERTIES, resource_key("Properties"), resource_key("Type")])
def open_ingress(d: Document) -> Column:
    numbers = {"FromPort", "ToPort"}
    flow_rule = "{" + ", ".join(f'"{k}": ' + (v if k in numbers else f'"{v}"') for k, v in OPEN_RULE) + "}"

    def block_rule(indent):
        lines = [text_of("\n", indent, "- " if i == 0 else "  ", f"{k}: {v}") for i, (k, v) in enumerate(OPEN_RULE)]
        return F.concat(*lines)

    def build(group):
        ingress = F.get(
            F.filter(d.properties, lambda p: (p["key"] == "SecurityGroupIngress") & (p["path"][1] == group["path"][1])),
            F.lit(0),
        )
        owner = F.get(
            F.filter(_resource_keys(d, "Properties"), lambda p: p["path"][1] == group["path"][1]), F.lit(0)
        )

        def change(i):
            indent = F.rpad(F.lit(""), i["column"], F.lit(" "))
            comma = F.when(i["size"] > 0, F.lit(", ")).otherwise(F.lit(""))
            grown = F.when(
                i["flow"], part(i["end"] - 1, i["end"] - 1, text_of(comma, flow_rule))
            ).otherwise(part(i["end"], i["end"], block_rule(indent)))
            fresh = F.lit(f"[{flow_rule}]")
            return (
                F.when(i.isNull(), _new_entry(d, owner, "SecurityGroupIngress", fresh, fresh))
                .when(i["kind"] == "list", grown)
                .otherwise(part(i["start"], i["end"], fresh))
            )

        return F.when(
            owner.isNotNull(),
            edit(
                [let(ingress, change)],
                "(restricted ingress)",
                "CidrIp: 0.0.0.0/0, Ports: 0-65535",
                text_of("Resources.", group["path"][1], ".Properties.SecurityGroupIngress"),
                _says("ingress", group["path"][1]),
            ),
        )

    return _first(_resource_keys(d, "Type"), lambda n: n["value"] == "AWS::EC2::SecurityGroup", build)


@fault("SECURITY.cf_missing_encryption", reads=[PROPERTIES, resource_key("Type")])
def cf_missing_encryption(d: Document) -> Column:
    def build(h):
        n = h["node"]
        return edit(
            [_cut(n)],
            text_of(n["key"], ": ", F.left(_source(d, n), F.lit(60))),
            "(property removed)",
            _dotted(n),
            _says("encryption", n["key"], h["type"]),
        )

    return let(
        _listed_property(d, ENCRYPTION_PROPERTIES), lambda h: F.when(h.isNotNull(), build(h))
    )
