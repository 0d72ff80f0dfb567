"""Node rows of YAML and JSON templates, with the source offsets that edits need.

Only the parse itself runs in Python, one Arrow batch at a time inside the row's own task; the
nodes stay in the document's row as an array and all later work is array expressions on it.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from mendset.functions import braces, graphs, plain_templates, template_arrays

NODE_TYPE = (
    "struct<path:array<string>,key:string,value:string,kind:string,size:int,start:int,end:int,"
    "column:int,flow:boolean,items:array<struct<value:string,kind:string,size:int,start:int,end:int>>,"
    "cut_start:int,cut_end:int,cut_text:string,owner_type:string,called:boolean,circular:boolean>"
)
# path     the keys that lead to the node, its own key last; list positions as text
# kind     str, int, float, bool, null, list, map;  size  number of children of a list or map
# start/end  the value in the source;  column  of its start;  flow  written inside or as [..] or {..}
# items    the elements of a list;  cut_*  the edit that deletes the whole entry
# owner_type  the type of the resource that holds the node;  called  the value is an intrinsic function's
# circular  a DependsOn of a template in which these lead in circles


# texts composed one by one before their nodes are put together; keeps few Python objects alive at a time
PARSE_ROWS = 200
PARSE_BYTES = 512 << 10  # text read at a time: its arrays stay in a core's cache
LOOSE = 500_000  # objects that may stay behind before cycles are looked for: aliases inside themselves make some
EDGES = pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string())]))
SHORTHAND = re.compile(r"!(\w+)\s*")


def _compose(text: str):
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        return yaml.compose(text, Loader=loader)
    except (yaml.YAMLError, ValueError):
        return None


def _owners(rows: list[tuple]) -> tuple[list[str | None], list[bool]]:
    """owner_type and called of a template's rows, from one index of the resources and one of the intrinsics."""
    types: dict[str, str | None] = {}
    calls = set()
    paths = [row[0] for row in rows]
    inside = [(i, p) for i, p in enumerate(paths) if len(p) > 2 and p[0] == "Resources"]
    for i, path in inside:
        if len(path) == 3:
            if path[2] == "Type":
                types.setdefault(path[1], rows[i][2])
        elif len(path) == 5 and (path[4] == "Ref" or path[4].startswith("Fn::")):
            calls.add((path[1], path[2], path[3]))
    owners: list[str | None] = [None] * len(rows)
    called = [False] * len(rows)
    for i, path in inside:
        owners[i] = types.get(path[1])
        if len(path) == 4 and calls and (path[1], path[2], path[3]) in calls:
            called[i] = True
    return owners, called


def _circular(found: list[list[tuple]]) -> list[bool]:
    """circular of the rows of many templates, whose dependencies are followed together."""
    edges, depends, first = [], [], 0
    for rows in found:
        at = [i for i, r in enumerate(rows) if r[1] == "DependsOn" and len(r[0]) == 3 and r[0][0] == "Resources"]
        own = []
        for row in (rows[i] for i in at):
            targets = [item[0] for item in row[9]] if row[3] == "list" else [row[2]]
            own += [{"src": row[0][1], "dst": t} for t in targets]
        edges.append(own)
        depends.append([first + i for i in at])
        first += len(rows)
    out = [False] * first
    for at, circle in zip(depends, graphs.cyclic(pa.array(edges, EDGES)).tolist()):
        for i in at:
            out[i] = circle
    return out


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    """Lists as one flat array of their elements and where each begins."""
    flat = [*chain.from_iterable(values)]
    if pa.types.is_struct(kind):
        columns = [*zip(*flat)] or [()] * kind.num_fields
        inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=[*kind])
    else:
        inner = pa.array(flat, kind)
    offsets = np.append(0, np.cumsum([*map(len, values)])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def _nodes(texts: list[str | None], node: pa.StructType, reads: list[tuple] | None = None) -> pa.Array:
    """The nodes of many templates: those of plain ones from flat arrays, others one by one."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    plain = template_arrays.Templates(texts, loader.yaml_implicit_resolvers)
    read = plain.nodes(node, reads)
    if not plain.bad.any():
        return read
    rest = np.flatnonzero(plain.bad)
    order = np.argsort(np.append(np.flatnonzero(~plain.bad), rest), kind="stable")
    others = [_made([texts[i] for i in rest[k : k + PARSE_ROWS].tolist()], node, reads) for k in range(0, len(rest), PARSE_ROWS)]
    return pa.concat_arrays([read, *others]).take(pa.array(order))


def _made(texts: list[str | None], node: pa.StructType, reads: list[tuple] | None = None) -> pa.Array:
    """The nodes of templates read one by one, put together column by column."""
    found = [_rows(t) if t else [] for t in texts]
    owned = [_owners(rows) for rows in found]
    circles = iter(_circular(found))
    whole = [[(*row, *more, next(circles)) for row, *more in zip(rows, *own)] for rows, own in zip(found, owned)]
    if reads is not None:
        whole = [[row for row in rows if _matches(row[0], reads)] for rows in whole]
    columns = [*zip(*chain.from_iterable(whole))] or [()] * node.num_fields
    fields = [
        _lists(c, f.type.value_type) if pa.types.is_list(f.type) else pa.array(c, f.type)
        for c, f in zip(columns, node, strict=True)
    ]
    offsets = np.append(0, np.cumsum([len(rows) for rows in whole])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=[*node]))


def _matches(path: list[str], reads: list[tuple]) -> bool:
    return any(
        (deep is None or len(path) == deep)
        and (top is None or path[0] == top)
        and (third is None or len(path) > 2 and path[2] == third)
        and (keys is None or path[-1] in keys)
        for deep, top, third, keys in reads
    )


def _rows(text: str) -> list[tuple]:
    """All map entries of a template in document order: the fields of NODE_TYPE up to cut_text."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    plain = plain_templates.rows(text, loader.yaml_implicit_resolvers)
    return _composed_rows(text) if plain is None else plain


def _composed_rows(text: str) -> list[tuple]:
    """The same of any text, from its composed tree."""
    out: list[tuple] = []
    open_: set[int] = set()  # nodes being visited: an alias inside itself is not followed

    def shape(node) -> tuple[str | None, str, int]:
        value = node.value
        if isinstance(value, str):
            kind = node.tag[18:]  # after "tag:yaml.org,2002:"
            return value, kind if kind in ("int", "float", "bool", "null") else "str", 0
        return None, "map" if node.id == "mapping" else "list", len(value)

    def inside(node, path: list[str], flow: bool, start: int) -> tuple[int, list[tuple]]:
        """Emit what lies below a node; its end in the source and, for a list, its elements."""
        end = node.end_mark.index
        value = node.value
        if isinstance(value, str):
            if node.style in ("|", ">"):
                end = start + len(text[start:end].rstrip())
            return end, []
        if id(node) in open_ or not value:
            return end, []
        open_.add(id(node))
        block = node.flow_style is False
        flow = flow or not block
        items: list[tuple] = []
        last = start
        if node.id == "mapping":
            for i, (k, v) in enumerate(value):
                name = k.value if isinstance(k.value, str) else "?"
                here = [*path, name]
                at, v_start = len(out), v.start_mark.index
                out.append(())
                v_end, v_items = entry(v, here, flow)
                if len(value) == 1:
                    cut = (start, v_end if block else end, "{}")
                elif block:
                    after = text.find("\n", v_end)
                    k_start = k.start_mark.index
                    cut = (k_start - k.start_mark.column, len(text) if after < 0 else after + 1, "")
                elif i + 1 < len(value):
                    cut = (k.start_mark.index, value[i + 1][0].start_mark.index, "")
                else:
                    cut = (last, v_end, "")
                tagged = v.tag[0] == "!"
                what = (None, "map", 1) if tagged else shape(v)
                inner = flow or getattr(v, "flow_style", None) is True
                listed = [] if tagged else v_items
                out[at] = (here, name, *what, v_start, v_end, v.start_mark.column, inner, listed, *cut)
                last = v_end
        else:
            for i, item in enumerate(value):
                last, _ = entry(item, [*path, str(i)], flow)
                what = (None, "map", 1) if item.tag[0] == "!" and not isinstance(item.value, str) else shape(item)
                items.append((*what, item.start_mark.index, last))
        open_.discard(id(node))
        return (last if block else end), items

    def entry(node, path: list[str], flow: bool) -> tuple[int, list[tuple]]:
        begin = node.start_mark.index
        tag = SHORTHAND.match(text, begin) if node.tag[0] == "!" else None
        if tag is None:
            return inside(node, path, flow, begin)
        # shorthand: the value becomes the only entry of a map named after the tag
        name, start = tag.group(1), tag.end()
        here, at = [*path, name], len(out)
        out.append(())
        end, items = inside(node, here, flow, start)
        end = max(end, start)
        what = (node.value, "str", 0) if isinstance(node.value, str) else shape(node)
        column = node.start_mark.column + start - begin if "\n" not in tag.group() else start - text.rfind("\n", 0, start) - 1
        inner = flow or getattr(node, "flow_style", None) is True
        out[at] = (here, name, *what, start, end, column, inner, items, begin, end, "{}")
        return end, items

    root = _compose(text)
    if root is not None and root.id == "mapping":
        inside(root, [], False, root.start_mark.index)
    del inside, entry  # they hold each other
    return out


# What a reader of nodes needs, as (depth, first step, third step, keys) of their paths; None stands for any.
PROPERTIES = (4, "Resources", "Properties", None)
RESOURCES = (2, "Resources", None, None)


def resource_key(key: str) -> tuple:
    return (3, "Resources", None, (key,))


def names_of(section: str) -> tuple:
    return (2, section, None, None)


def calls_of(name: str) -> tuple:
    return (None, None, None, (name, f"Fn::{name}"))


def on_the_way(path: list[str]) -> list[tuple]:
    """The nodes at a path and above it, and others like them."""
    third = lambda k: path[2] if k > 2 else None
    return list(dict.fromkeys((k, path[0], third(k), (path[k - 1],)) for k in range(1, len(path) + 1)))


def with_nodes(configs: DataFrame, reads: list[tuple] | None = None) -> DataFrame:
    """Add `nodes array<NODE_TYPE>`; a text that does not parse to a map has none.

    With `reads`, only nodes that match one of these are handed over, for callers that look at no others.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(_parse_datatype_string(f"array<{NODE_TYPE}>"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are many small objects without cycles: looking for cycles among them takes longer than the rest
        gc.disable()
        try:
            for batch in batches:
                at = 0
                for texts in braces.slices(batch.column(batch.schema.get_field_index("text")), PARSE_BYTES):
                    if gc.get_count()[0] > LOOSE:
                        gc.collect()
                    part = batch.slice(at, len(texts))
                    at += len(texts)
                    nodes = _nodes(texts.to_pylist(), arrow_type.value_type, reads)
                    yield pa.RecordBatch.from_arrays([*part.columns, nodes], [*batch.schema.names, "nodes"])
        finally:
            gc.enable()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in configs.schema.fields)
    return configs.mapInArrow(parse, f"{schema}, nodes array<{NODE_TYPE}>")


def template_nodes(configs: DataFrame) -> DataFrame:
    rows = with_nodes(configs).select("doc_id", F.posexplode("nodes").alias("i", "n"))
    return rows.select("doc_id", "i", "n.*").drop("owner_type", "called", "circular")


# Intrinsic functions in short and long spelling.
INTRINSICS = ["Ref", "GetAtt", "Sub", "Select", "If", "Join"]


def intrinsic(nodes: Column, name: str) -> Column:
    """Nodes of one intrinsic; a Ref must hold text."""
    hit = lambda n: n["key"].isin(name, f"Fn::{name}")
    return F.filter(nodes, (lambda n: hit(n) & (n["kind"] == "str")) if name == "Ref" else hit)


def is_property(n: Column) -> Column:
    """Is the node a property of a resource?"""
    return (F.size(n["path"]) == 4) & (n["path"][0] == "Resources") & (n["path"][2] == "Properties")


def section_names(nodes: Column, section: str) -> Column:
    """Names defined in a top-level section: Resources, Parameters or Conditions."""
    inside = F.filter(nodes, lambda n: (F.size(n["path"]) == 2) & (n["path"][0] == section))
    return F.transform(inside, lambda n: n["key"])


def node_at(nodes: Column, path: Column) -> Column:
    """The node at a path; null when missing."""
    return F.get(F.filter(nodes, lambda n: n["path"] == path), F.lit(0))


def nested_get(nodes: Column, path: list[str]) -> Column:
    """The scalar at a path as text; null when missing or not a scalar."""
    return node_at(nodes, F.array(*[F.lit(p) for p in path]))["value"]


def resource_type(nodes: Column, logical_id: Column) -> Column:
    return node_at(nodes, F.array(F.lit("Resources"), logical_id, F.lit("Type")))["value"]


def nested_set(text: Column, nodes: Column, path: list[str], value: str) -> Column:
    """The edit part that sets a scalar at a path, creating the maps that are missing.

    Null when something on the way exists but is not a map.
    """
    quoted = f'"{value}"'
    answer = F.lit(None).cast("struct<start:int,end:int,replacement:string>")
    for depth in range(1, len(path) + 1):
        # deepest existing node first, so build the fallbacks from the root downwards
        rest = path[depth:]
        at = node_at(nodes, F.array(*[F.lit(p) for p in path[:depth]]))
        if not rest:
            found = F.struct(at["start"].alias("start"), at["end"].alias("end"), F.lit(quoted).alias("replacement"))
        else:
            inner = quoted
            for key in reversed(rest[1:]):
                inner = f'{{"{key}": {inner}}}'
            flow = F.concat(F.lit(f'"{rest[0]}": {inner}'), F.when(at["size"] > 0, F.lit(", ")).otherwise(""))
            block = F.concat(F.lit(f"{rest[0]}: {inner}\n"), F.rpad(F.lit(""), at["column"], F.lit(" ")))
            spot = at["start"] + F.when(at["flow"], 1).otherwise(0)
            found = F.when(
                at["kind"] == "map",
                F.struct(
                    spot.alias("start"), spot.alias("end"), F.when(at["flow"], flow).otherwise(block).alias("replacement")
                ),
            )
        answer = F.when(at.isNotNull(), found).otherwise(answer)
    return answer
