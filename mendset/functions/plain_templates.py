"""The entries of templates that keep to plain spelling, in one pass over their lines.

Most templates use a small part of YAML: printable ASCII, one entry a line, values that end with their
line, and JSON in its usual form. Such a text is read here, and gives the same rows as a composed tree
(operators/structure_template.py). Whatever else may stand in a text (other characters, escapes, block
and folded scalars, anchors, comments after values, lists no deeper than their key, empty values, several
documents, bad indentation) is answered by None: the caller then composes the text.
"""

from __future__ import annotations

import re

# indent, dash, key, the rest of the line
LINE = re.compile(r"^( *)(- )?(?:([A-Za-z0-9_][\w./-]*(?:::?[\w./-]+)*):(?: +(?=[!-~])|$))?(.*)$", re.M | re.A)
# a key, and where the value is quoted text, the value and what follows it
FLOW_KEY = re.compile(r'"([^"\\\n]{0,500})" {0,9}:[ \n]*(?:"([^"\\\n]*)"[ \n]*([,}])[ \n]*)?')
BLANK = re.compile(r"[ \n]*")
QUOTED = re.compile(r'"([^"\\\n]*)"|\'([^\'\n]*)\'')
FLOW_PLAIN = re.compile(r"-?[A-Za-z0-9_/.](?:[\w./+*=-]|:(?=\w))*", re.A)
PLAIN_TAG = re.compile(r"!(\w+) +(?=[A-Za-z0-9_])", re.A)
TAG = re.compile(r"!(\w+) +(?=[!-~])", re.A)
UNPLAIN = re.compile(r"[^ -~\n]")
INDICATORS = frozenset("?:,[]{}#&*!|>'\"%@`")
DEEPEST, LONGEST = 40, 500


class Unusual(Exception):
    """The text is to be composed."""


class _Reader:
    def __init__(self, text: str, resolvers: dict):
        self.text = text
        self.resolvers = resolvers
        self.out: list[tuple] = []

    def plain(self, value: str) -> tuple[str, str, int]:
        found = self.resolvers.get(value[0])
        if found is not None:
            for tag, pattern in found:
                if pattern.match(value):
                    kind = tag[18:]  # after "tag:yaml.org,2002:"
                    return value, kind if kind in ("int", "float", "bool", "null") else "str", 0
        return value, "str", 0

    # A value is read as (what, start, end, its own flow style, elements, tagged): what is value, kind, size.

    def flow(self, at: int, path: list[str], deep: int) -> tuple:
        """A value inside brackets."""
        text = self.text
        c = text[at : at + 1]
        if c == '"' or c == "'":
            m = QUOTED.match(text, at)
            if m is None or text[m.end() : m.end() + 1] in ("'", '"'):
                raise Unusual
            return (m[1] if c == '"' else m[2], "str", 0), at, m.end(), None, [], False
        if c == "{":
            return self.flow_map(at, at, path, deep)
        if c == "[":
            return self.flow_list(at, path, deep)
        if c == "!":
            m = TAG.match(text, at)
            if m is None:
                raise Unusual
            return self.tagged(m[1], at, m.end(), path, deep, None)
        m = FLOW_PLAIN.match(text, at)
        if m is None:
            raise Unusual
        return self.plain(m[0]), at, m.end(), None, [], False

    def column(self, at: int) -> int:
        return at - self.text.rfind("\n", 0, at) - 1

    def tagged(self, name: str, begin: int, start: int, path: list[str], deep: int, stop: int | None) -> tuple:
        """A value behind a shorthand; in a block it ends at `stop`, with its line."""
        here, at = [*path, name], len(self.out)
        self.out.append(())
        what, _, end, style, items, again = self.flow(start, here, deep) if stop is None else self.value(start, stop, here, deep)
        if again:  # a shorthand behind a shorthand
            raise Unusual
        if what[1] not in ("list", "map"):
            what = (what[0], "str", 0)
        column = self.column(begin) + start - begin
        inner = stop is None or style is True
        self.out[at] = (here, name, *what, start, end, column, inner, items, begin, end, "{}")
        return what, begin, end, style, items, True

    def flow_list(self, at: int, path: list[str], deep: int) -> tuple:
        if deep > DEEPEST:
            raise Unusual
        text, items, i = self.text, [], 0
        begin, at = at, BLANK.match(text, at + 1).end()
        if text[at : at + 1] != "]":
            while True:
                what, start, end, _, _, tagged = self.flow(at, [*path, str(i)], deep + 1)
                if tagged and what[1] in ("list", "map"):
                    what = (None, "map", 1)
                items.append((*what, start, end))
                i += 1
                at = BLANK.match(text, end).end()
                c = text[at : at + 1]
                if c == "]":
                    break
                if c != ",":
                    raise Unusual
                at = BLANK.match(text, at + 1).end()
        return (None, "list", i), begin, at + 1, True, items, False

    def flow_map(self, at: int, begin: int, path: list[str], deep: int) -> tuple:
        if deep > DEEPEST:
            raise Unusual
        text, out = self.text, self.out
        at = BLANK.match(text, at + 1).end()
        rows: list[int] = []
        keys: list[int] = []
        last = begin
        if text[at : at + 1] != "}":
            while True:
                m = FLOW_KEY.match(text, at)
                if m is None:
                    raise Unusual
                keys.append(at)
                rows.append(len(out))
                name, here = m[1], [*path, m[1]]
                if m[2] is not None:
                    start, end = m.start(2) - 1, m.end(2) + 1
                    out.append((here, name, m[2], "str", 0, start, end, self.column(start), True, [], last, end, ""))
                    last = end
                    if m[3] == "}":
                        at = m.start(3)
                        break
                    at = m.end()
                    continue
                out.append(())
                what, start, end, style, items, tagged = self.flow(m.end(), here, deep + 1)
                if tagged:
                    what, items = (None, "map", 1), []
                out[rows[-1]] = (here, name, *what, start, end, self.column(start), True, items, last, end, "")
                last = end
                at = BLANK.match(text, end).end()
                c = text[at : at + 1]
                if c == "}":
                    break
                if c != ",":
                    raise Unusual
                at = BLANK.match(text, at + 1).end()
        if len(rows) == 1:
            out[rows[0]] = (*out[rows[0]][:10], begin, at + 1, "{}")
        else:
            for row, key, after in zip(rows, keys, keys[1:]):
                out[row] = (*out[row][:10], key, after, "")
        return (None, "map", len(rows)), begin, at + 1, True, [], False

    def value(self, at: int, stop: int, path: list[str], deep: int) -> tuple:
        """A value that ends with its line."""
        text = self.text
        c = text[at]
        if c not in INDICATORS:
            value = text[at:stop]
            if ": " in value or " #" in value or value[-1] == ":" or c == "-" and value[1:2] in (" ", ""):
                raise Unusual
            return self.plain(value), at, stop, None, [], False
        if c == "!":
            m = TAG.match(text, at, stop)
            if m is None:
                raise Unusual
            return self.tagged(m[1], at, m.end(), path, deep, stop)
        if c not in "[{\"'":
            raise Unusual
        got = self.flow(at, path, deep)
        if got[2] != stop:
            raise Unusual
        return got

    def block(self) -> None:
        """All lines of a block text. `open_` holds the maps and lists that a line may still belong to: column,
        whether a list, path, first byte, number of entries, and the first row of a map or the elements of a list."""
        text, out, resolvers = self.text, self.out, self.resolvers
        size = len(text)
        open_: list[list] = []
        waiting: list[tuple] = []  # keys whose value is the map or list above them: row, path, key, line start
        column, listed, path, at, count, held = 0, False, [], 0, 0, 0
        end = bare = -1  # the end of the last value; the column of a key whose value is still to come

        def close() -> None:
            nonlocal column, listed, path, at, count, held
            what = (None, "list" if listed else "map", count, at, end)
            items = held if listed else []
            if not listed and count == 1:
                out[held] = (*out[held][:10], at, end, "{}")
            below = column
            column, listed, path, at, count, held = open_.pop()
            if listed:
                held.append(what)
            else:
                row, here, name, start = waiting.pop()
                out[row] = (here, name, *what, below, False, items, start, end + 1 if end < size else size, "")

        for m in LINE.finditer(text):
            indent, dash, name, rest = m.groups()
            if rest:
                if dash is name is None and rest[0] == "#":
                    continue
                if rest[0] == " " or rest[-1] == " ":
                    raise Unusual
            elif name is None:
                if dash is not None:
                    raise Unusual
                continue
            start, stop = m.span()
            here_column = len(indent)
            if bare >= 0:
                if here_column <= bare or len(open_) > DEEPEST:
                    raise Unusual
                open_.append([column, listed, path, at, count, held])
                path = waiting[-1][1]
                column, listed, at, count = here_column, dash is not None, start + here_column, 0
                held = [] if listed else len(out)
                bare = -1
            elif here_column != column:
                if end < 0:  # the first line
                    raise Unusual
                while here_column < column:
                    close()
                if here_column > column:
                    raise Unusual
            if listed is (dash is None):
                raise Unusual
            if end < 0:
                at = start
            if listed:
                here = [*path, str(count)]
                count += 1
                if name is None:
                    what, v_start, end, _, _, tagged = self.value(stop - len(rest), stop, here, 0)
                    if tagged and what[1] in ("list", "map"):
                        what = (None, "map", 1)
                    held.append((*what, v_start, end))
                    continue
                open_.append([column, listed, path, at, count, held])
                column, listed, path, at, count, held = column + 2, False, here, start + column + 2, 0, len(out)
            elif name is None:
                raise Unusual
            if len(name) > LONGEST:
                raise Unusual
            count += 1
            here = [*path, name]
            if not rest:
                waiting.append((len(out), here, name, start))
                out.append(())
                bare, end = column, stop
                continue
            c = rest[0]
            v_start = stop - len(rest)
            if c not in INDICATORS:
                if ": " in rest or " #" in rest or rest[-1] == ":" or c == "-" and rest[1:2] in (" ", ""):
                    raise Unusual
                kind = "str" if c not in resolvers else self.plain(rest)[1]
                out.append((here, name, rest, kind, 0, v_start, stop, v_start - start, False, [], start, stop + 1 if stop < size else size, ""))
            elif c == "!" and (m := PLAIN_TAG.match(rest)) and ": " not in rest and " #" not in rest and rest[-1] != ":":
                value_start, name_of = v_start + m.end(), m[1]
                cut = stop + 1 if stop < size else size
                out.append((here, name, None, "map", 1, v_start, stop, v_start - start, False, [], start, cut, ""))
                out.append(([*here, name_of], name_of, rest[m.end() :], "str", 0, value_start, stop, value_start - start, False, [], v_start, stop, "{}"))
            else:
                row = len(out)
                out.append(())
                what, _, _, style, items, tagged = self.value(v_start, stop, here, 0)
                if tagged:
                    what, items = (None, "map", 1), []
                out[row] = (here, name, *what, v_start, stop, v_start - start, style is True, items, start, stop + 1 if stop < size else size, "")
            end = stop
        if end < 0 or bare >= 0:
            raise Unusual
        while open_:
            close()
        if count == 1:
            out[0] = (*out[0][:10], at, end, "{}")

    def read(self) -> list[tuple]:
        text = self.text
        if UNPLAIN.search(text):
            raise Unusual
        at = BLANK.match(text).end()
        if text[at : at + 1] == "{":
            _, _, end, *_ = self.flow_map(at, at, [], 0)
            if BLANK.match(text, end).end() != len(text):
                raise Unusual
        else:
            self.block()
        return self.out


def rows(text: str, resolvers: dict) -> list[tuple] | None:
    """All map entries in document order, or None; `resolvers` are the loader's, by first character."""
    try:
        return _Reader(text, resolvers).read()
    except Unusual:
        return None
