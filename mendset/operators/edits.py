"""The edit: what a fault does to one document, as a value in the document's row.

An edit is struct<fault_id, parts array<struct<start,end,replacement>>, original_snippet,
modified_snippet, location, description>; offsets are 0-based code points. Most faults have one
part, the two cycle faults have two.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.functions.draws import draw
from mendset.functions.text import WHITESPACE, first_match, let, plain_bytes, text_slice
from mendset.operators.structure_template import INTRINSICS, is_property

EDIT_TYPE = (
    "struct<fault_id:string,parts:array<struct<start:int,end:int,replacement:string>>,"
    "original_snippet:string,modified_snippet:string,location:string,description:string>"
)


class Document:
    """The columns of one document row that fault builders may use."""

    def __init__(self, seed: int = 42, salt: str = ""):
        self.seed = seed
        self.salt = salt
        self.text = F.col("text")
        self.blocks = F.col("resource_spans")
        self.nodes = F.col("nodes")
        self.properties = F.col(OWN_PROPERTIES)
        self.top = F.col(TOP)
        self.calls = F.col(CALLS)
        self.plain = F.col(PLAIN)
        self.size = F.col(SIZE)
        self.is_json = F.col(IS_JSON)

    def slice(self, start: Column, end: Column) -> Column:
        """text[start:end] with 0-based code-point offsets."""
        return text_slice(self.text, start, end, self.plain)

    def first_match(self, regex: str) -> Column:
        return first_match(self.text, regex, self.plain)

    def draw(self, fault_id: str, slot: str | Column = "") -> Column:
        return draw(self.seed, F.col("doc_id"), fault_id, slot, self.salt)


# Names of what a Document reads of its text besides: its plain_bytes, its code points, whether it is JSON.
PLAIN, SIZE, IS_JSON = "text in plain bytes", "size of the text", "text is JSON"
# Of its nodes: the properties of resources, those at most three steps deep, the calls of intrinsic functions.
OWN_PROPERTIES, TOP, CALLS = "nodes of properties", "nodes near the top", "nodes of calls"


def with_measures(prepared: DataFrame, family: str) -> DataFrame:
    """Add what a Document tells of its text and nodes, found once for all faults."""
    text = F.col("text")
    found = {PLAIN: plain_bytes(text), SIZE: F.length(text)}
    if family == "template":
        found[IS_JSON] = F.ltrim(text, F.lit(WHITESPACE)).startswith("{")
        found[OWN_PROPERTIES] = F.filter("nodes", is_property)
        found[TOP] = F.filter("nodes", lambda n: F.size(n["path"]) <= 3)
        found[CALLS] = F.filter("nodes", lambda n: n["key"].isin(*INTRINSICS, *[f"Fn::{name}" for name in INTRINSICS]))
    return prepared.withColumns(found)


Builder = Callable[[Document], Column]
REGISTRY: dict[str, Builder] = {}
#: The nodes that the builder of a template's fault looks at; one that is not listed looks at all.
READS: dict[str, list[tuple]] = {}
#: What the builder of a brace text's fault sees: "text" alone, its own "scans" of it, or "blocks" if not listed.
SEES: dict[str, str] = {}


def fault(fault_id: str, reads: list[tuple] | None = None, sees: str | None = None) -> Callable[[Builder], Builder]:
    """Register the builder of a fault; users add their own faults the same way."""

    def keep(fn: Builder) -> Builder:
        REGISTRY[fault_id] = fn
        for told, what in ((READS, reads), (SEES, sees)):
            told.pop(fault_id, None)
            if what is not None:
                told[fault_id] = what
        return fn

    return keep


def text_of(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def part(start: Column, end: Column, replacement: Column | str) -> Column:
    r = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), r.alias("replacement")
    )


def edit(
    parts: list[Column],
    original: Column | str,
    modified: Column | str,
    location: Column | str,
    description: Column | str,
) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.array(*parts).alias("parts"),
        as_col(original).alias("original_snippet"),
        as_col(modified).alias("modified_snippet"),
        as_col(location).alias("location"),
        as_col(description).alias("description"),
    )


def _without_groups(regex: str) -> str:
    """A pattern of plain groups without these: a search for one that begins with a word can skip places."""
    plain = not re.search(r"\\[()]|\(\?|\[[^\]]*[()|]|[|]|\)[*+?{]", regex)
    return regex.replace("(", "").replace(")", "") if plain else regex


def first_group_edit(
    text: Column, patterns: list[str], build: Callable[[Column, Column, Column], Column], plain: Column | None = None
) -> Column:
    """First pattern (in order) that matches; its groups are (prefix)(value)(suffix).

    `build` gets the 0-based start of the value, the value and the prefix; `plain` as first_match takes it.
    """

    def one(regex: str) -> Column:
        def inner(m: Column) -> Column:
            prefix = F.regexp_extract(m["found"], f"(?s)^{regex}", 1)
            value = F.regexp_extract(m["found"], f"(?s)^{regex}", 2)
            return F.struct(
                (m["start"] + F.length(prefix)).alias("start"), value.alias("value"), prefix.alias("prefix")
            )

        return let(first_match(text, _without_groups(regex), plain), lambda m: F.when(m.isNotNull(), inner(m)))

    hit = F.coalesce(*[one(p) for p in patterns])
    return let(hit, lambda h: F.when(h.isNotNull(), build(h["start"], h["value"], h["prefix"])))
