"""Block, attribute and reference spans of brace-structured texts.

All structure of a document is found in its own row, so that neither the text nor its tokens ever
cross a shuffle. Blocks, their assignments and references are found in flat arrays of many texts
(functions/braces.py), in Arrow batches; everything built on them is column expressions. The table
forms at the end explode the arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.functions import braces
from mendset.functions.text import code_point_slice, let, strip

# names of the parts of a dotted word; a word starts where none goes on
VARIABLE_REF = r"var\.(\w+)"
RESOURCE_REF = r"(?<!\w)(\w+)\.(\w+)\.(\w+)"


def _scanned(text: Column, kind: str, scan: Callable[[pa.Array], pa.Array]) -> Column:
    """array<kind>: what `scan` lists for each text, found for many texts at once.

    Not a function of iterators: Spark runs all scans of a text in one Python step only without these.
    """

    @F.arrow_udf(f"array<{kind}>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([scan(some) for some in braces.slices(texts)] or [scan(texts)])

    return found(text)


def _without_quotes(segment: Column) -> Column:
    """The text without quoted parts and # comments, in one scan: for counts, where offsets do not matter."""
    plain = F.replace(F.replace(segment, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    return F.regexp_replace(plain, '"[^"]*"?|#[^\n]*', "")


def block_spans(text: Column, kind: str, label: str | None = None) -> Column:
    """array<struct<start,end>> of `kind ... {...}` blocks; quoted text and # comments skipped."""
    pattern = braces.header_pattern(braces.kind_header(kind, label))
    return _scanned(text, "struct<start:int,end:int>", lambda t: braces.block_spans(t, pattern, comments=True))


def resource_spans(text: Column) -> Column:
    """array<struct<type,name,start,end,line,attrs>> of resource blocks; # comments are not skipped here.

    `line` is the number of the block's first line, `attrs` are its own assignments.
    """
    attrs = "array<struct<name:string,line:int,start:int,text:string>>"
    kind = f"struct<type:string,name:string,start:int,end:int,line:int,attrs:{attrs}>"
    return _scanned(text, kind, braces.resource_spans)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def attributes(block: Column) -> Column:
    """array<struct<name,line,start,text>> of the resource block's own assignments (brace depth <= 1)."""
    return block["attrs"]


def attribute_line(text: Column, block: Column, name: str) -> Column:
    """0-based line of the first assignment to `name` in the block at any depth; null if none."""
    lines = F.split(code_point_slice(text, block["start"], block["end"]), "\n", -1)
    hits = F.filter(
        F.transform(lines, lambda x, i: F.when(strip(x).rlike(rf"^\Q{name}\E\s*="), i)),
        lambda i: i.isNotNull(),
    )
    return block["line"] + F.get(hits, F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    compiled = re.compile(pattern)
    return _scanned(text, "struct<start:int,found:string>", lambda t: braces.matches(t, compiled))


def variable_refs(text: Column) -> Column:
    """array<struct<name,start>> of var.X."""
    return F.transform(
        _matches(text, VARIABLE_REF),
        lambda m: F.struct(F.substr(m["found"], F.lit(5)).alias("name"), m["start"].alias("start")),
    )


def resource_words(text: Column) -> Column:
    """array<struct<start,found>> of A.B.C, whatever A is."""
    return _matches(text, RESOURCE_REF)


def resource_refs(text: Column, strict: bool = True) -> Column:
    """array<struct<type,name,start>> of A.B.C with A not starting with var.

    strict also asks A to start with a letter or underscore, so that dotted numbers do not count.
    """

    def parts(m: Column) -> Column:
        return let(
            F.split(m["found"], r"\."),
            lambda a: F.struct(a[0].alias("type"), a[1].alias("name"), m["start"].alias("start")),
        )

    found = F.transform(resource_words(text), parts)
    keep = F.filter(found, lambda r: ~r["type"].startswith("var"))
    return F.filter(keep, lambda r: r["type"].rlike(r"(?U)^[\p{L}_]")) if strict else keep


def line_delete(text: Column, first: Column | int, last: Column | int) -> Column:
    """Text without lines first..last (0-based, inclusive)."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: (i < a) | (i > b)), "\n")


def line_replace(text: Column, line: Column | int, old: Column | str, new: Column | str) -> Column:
    """Replace the first occurrence of `old` in one line; an unknown line changes nothing."""
    n, o, w = (F.lit(x) if isinstance(x, (int, str)) else x for x in (line, old, new))

    def change(x: Column) -> Column:
        at = F.position(o, x)
        return F.when(at == 0, x).otherwise(
            F.concat(F.substring(x, F.lit(1), at - 1), w, F.substring(x, at + F.length(o), F.length(x)))
        )

    return F.array_join(
        F.transform(F.split(text, "\n", -1), lambda x, i: F.when(i == n, change(x)).otherwise(x)), "\n"
    )


def block_table(configs: DataFrame, kind: str) -> DataFrame:
    spans = F.posexplode(block_spans(F.col("text"), kind)).alias("i", "b")
    return configs.select("doc_id", spans).select("doc_id", "i", F.lit(kind).alias("kind"), "b.*")


def resource_table(configs: DataFrame) -> DataFrame:
    spans = F.posexplode(resource_spans(F.col("text"))).alias("i", "b")
    return configs.select("doc_id", spans).select("doc_id", "i", "b.type", "b.name", "b.start", "b.end")


def attribute_table(configs: DataFrame) -> DataFrame:
    staged = configs.withColumn("blocks", resource_spans(F.col("text")))
    per_block = F.transform(
        "blocks",
        lambda b: F.struct(b["type"].alias("type"), b["name"].alias("block"), attributes(b).alias("attrs")),
    )
    blocks = staged.select("doc_id", F.posexplode(per_block).alias("i", "b"))
    rows = blocks.select("doc_id", "i", "b.type", "b.block", F.explode("b.attrs").alias("a"))
    return rows.select("doc_id", "i", "type", "block", "a.name", "a.line", "a.start", "a.text")
