"""A text at a time, in plain loops: what mendset/functions/braces.py must equal.

Offsets are 0-based code points. Quoted text (and `#` comments, where asked for) hides braces; a
backslash hides a quote or a backslash everywhere; quoting starts afresh at each header, so a stray
quote cannot hide the blocks after it. Nesting may be as deep as the text is long.
"""

from __future__ import annotations

import re

from mendset.functions.braces import ASSIGNMENT

HIDE = str.maketrans("{}", "  ")
TOKEN = re.compile(r'\\[\\"]|"(?:\\[\\"]|[^"])*"?')
TOKEN_OR_COMMENT = re.compile(TOKEN.pattern + r"|#[^\n]*")
BRACE = re.compile(r"[{}]")
RESOURCE = r'[ \t]*resource\s+"([^"]+)"\s+"([^"]+)"\s*'
def _hidden(m: re.Match) -> str:
    t = m[0]
    if t[0] == "\\":
        return "__"
    if "\\" in t:
        t = re.sub(r'\\[\\"]', "__", t)
    return t.translate(HIDE)


class Blocks:
    """The balanced blocks under one header pattern."""

    def __init__(self, header: str, comments: bool):
        self.at_line = re.compile(rf"(?m)^(?={header}\{{)", re.ASCII)
        self.header = re.compile(rf"{header}\{{", re.ASCII)
        self.token = TOKEN_OR_COMMENT if comments else TOKEN

    def find(self, text: str) -> list[tuple[int, int]]:
        """(start, end) in text order."""
        cuts = [m.start() for m in self.at_line.finditer(text)]
        if not cuts:
            return []
        bounds = [0, *cuts, len(text)]
        shown = "".join(self.token.sub(_hidden, text[a:b]) for a, b in zip(bounds, bounds[1:]))
        opened: list[int] = []
        closes: dict[int, int] = {}
        for m in BRACE.finditer(shown):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                closes[opened.pop()] = m.end()
        out = []
        for m in self.at_line.finditer(shown):
            end = closes.get(self.header.match(shown, m.start()).end() - 1)
            if end is not None and self.header.match(text, m.start(), end):
                out.append((m.start(), end))
        return out


def assignments(text: str, start: int, end: int, line: int) -> list[dict]:
    """The block's own assignments (brace depth <= 1); `line` is the number of its first line."""
    out, depth, at = [], 0, start
    for n, row in enumerate(text[start:end].split("\n")):
        if "{" in row or "}" in row:
            depth += row.count("{") - row.count("}")
        if depth <= 1 and "=" in row and (m := ASSIGNMENT.match(row.strip())):
            out.append({"name": m[1], "line": line + n, "start": at, "text": row})
        at += len(row) + 1
    return out


def resources(blocks: Blocks, text: str | None) -> list[dict]:
    """Resource blocks with type, name, span, first line and own assignments."""
    out, at, line = [], 0, 0
    for start, end in blocks.find(text or ""):
        line += text.count("\n", at, start)
        at = start
        m = blocks.header.match(text, start)
        own = assignments(text, start, end, line)
        out.append({"type": m[1], "name": m[2], "start": start, "end": end, "line": line, "attrs": own})
    return out


def matches(pattern: re.Pattern, text: str | None) -> list[dict]:
    return [{"start": m.start(), "found": m[0]} for m in pattern.finditer(text or "")]
