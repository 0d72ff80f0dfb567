"""Scalar text helpers as Spark columns (everything here stays in the JVM)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip() removes and what str.splitlines() breaks on.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """Null or nothing but whitespace."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(F.replace(c, F.lit(needle), F.lit("")))
    return ((F.length(c) - gone) / F.lit(len(needle))).cast("int")


def split_lines(c: Column) -> Column:
    """Lines without their breaks; a final break does not open another line; '' has no line."""
    return let(
        F.split(c, LINE_BREAK, -1),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a),
    )


BREAK_CHARS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def line_count(c: Column) -> Column:
    # most texts break lines with \n only, which counts without a regex
    plain = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rare = reduce(or_, [c.contains(b) for b in BREAK_CHARS[1:]])
    breaks = F.when(rare, F.regexp_count(c, F.lit(LINE_BREAK))).otherwise(plain)
    open_tail = (F.length(c) > 0) & ~F.right(c, F.lit(1)).isin(*BREAK_CHARS)
    return breaks + F.when(open_tail, 1).otherwise(0)


def code_point_slice(c: Column, start: Column, end: Column) -> Column:
    """c[start:end] with 0-based code-point offsets."""
    return F.substring(c, (start + 1).cast("int"), (end - start).cast("int"))


def plain_bytes(c: Column) -> Column:
    """The bytes of an ASCII text, whose places are those of its code points; null for any other text.

    Places in the bytes are reached at once, those of code points by walking over all before them.
    """
    return F.when(F.length(c) == F.octet_length(c), c.cast("binary"))


def text_slice(c: Column, start: Column, end: Column, plain: Column) -> Column:
    """code_point_slice of a text whose plain_bytes are at hand."""
    quick = code_point_slice(plain, start, end).cast("string")
    return F.when(plain.isNotNull(), quick).otherwise(code_point_slice(c, start, end))


def splice(c: Column, parts: Column, plain: Column | None = None) -> Column:
    """Apply non-overlapping parts array<struct<start,end,replacement>> from right to left.

    `plain` holds the text's plain_bytes, where a caller has them.
    """
    ordered = F.reverse(F.array_sort(parts))
    one = F.get(parts, F.lit(0))

    def with_part(t: Column, p: Column, size: Callable[[Column], Column], kind: str) -> Column:
        after = F.substring(t, p["end"] + 1, size(t))
        return F.concat(F.substring(t, F.lit(1), p["start"]), p["replacement"].cast(kind), after)

    def applied(text: Column, size: Callable[[Column], Column], kind: str) -> Column:
        all_of_them = F.aggregate(ordered, text, lambda t, p: with_part(t, p, size, kind))
        return F.when(F.size(parts) == 1, with_part(text, one, size, kind)).otherwise(all_of_them)

    whole = applied(c, F.length, "string")
    if plain is None:
        return whole
    return F.when(plain.isNotNull(), applied(plain, F.octet_length, "binary").cast("string")).otherwise(whole)


def first_match(c: Column, regex: str, plain: Column | None = None) -> Column:
    """struct(start, found) of the first match, null if there is none. One scan of the text.

    `plain` holds the text's plain_bytes, where a caller has them.
    """

    def found(a: Column, text: Column, size: Callable[[Column], Column]) -> Column:
        before = size(a[0])
        match = F.substring(text, before + 1, size(text) - before - size(a[1]))
        return F.struct(before.alias("start"), match.cast("string").alias("found"))

    def hit(a: Column) -> Column:
        whole = found(a, c, F.length)
        quick = whole if plain is None else F.when(plain.isNotNull(), found(a, plain, F.octet_length)).otherwise(whole)
        return F.when(F.size(a) == 2, quick)

    return let(F.split(c, regex, 2), hit)


def all_matches(c: Column, regex: str) -> Column:
    """array<struct<start,found>> of all matches in text order."""
    gaps = F.split(c, regex, -1)
    # split drops an empty leading piece only for zero-width matches, which callers never use
    return let(
        F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(c, F.lit(regex), F.lit(0)).alias("hit")),
        lambda z: F.aggregate(
            F.filter(z, lambda e: e["hit"].isNotNull()),
            F.struct(
                F.lit(0).alias("at"),
                F.expr("cast(array() as array<struct<start:int,found:string>>)").alias("out"),
            ),
            lambda acc, e: let(
                acc["at"] + F.length(e["gap"]),
                lambda s: F.struct(
                    (s + F.length(e["hit"])).alias("at"),
                    F.concat(
                        acc["out"], F.array(F.struct(s.alias("start"), e["hit"].alias("found")))
                    ).alias("out"),
                ),
            ),
            lambda acc: acc["out"],
        ),
    )


def fence_strip(c: Column) -> Column:
    """Strip, then drop an opening ``` line and a closing ``` line; lines rejoined with \\n."""

    def close(a: Column) -> Column:
        last_is_fence = (F.size(a) > 0) & (strip(F.try_element_at(a, F.lit(-1))) == "```")
        return F.when(last_is_fence, F.slice(a, 1, F.size(a) - 1)).otherwise(a)

    def open_(a: Column) -> Column:
        first_is_fence = (F.size(a) > 0) & F.try_element_at(a, F.lit(1)).startswith("```")
        return F.when(first_is_fence, F.slice(a, 2, F.size(a))).otherwise(a)

    return let(split_lines(strip(c)), lambda a: F.array_join(let(open_(a), close), "\n"))


def fill(template: str, *values: Column) -> Column:
    """The template with its %s slots filled, as one concat."""
    pieces = template.split("%s")
    out: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [value, F.lit(piece)]
    return F.concat(*out)
