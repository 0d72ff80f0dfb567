"""The flat scan of many texts equals the scan of each text in plain loops."""

import re
import time

import plain_braces
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mendset.functions import braces
from mendset.operators.structure_hcl import RESOURCE_REF, VARIABLE_REF

PLAIN = {c: plain_braces.Blocks(plain_braces.RESOURCE, comments=c) for c in (False, True)}
PIECES = [
    'resource "a" "b" {', 'resource  "é{" "b}"  {', '  resource "a\n" "c"\n{', 'resource "a\\" "b" {', "module m {", 'module "m{" {', "module\n x {",
    "{", "}", '"', "\\", '\\"', "#", "\n", "\n", "\n}", " ", "\t", "x = 1", "é = {", "　y = 2", "\x1cz =", "b {\n  c = 3\n}", "var.x", "a.b.c", "d.é_1.f.g.h", "\x85", "=", "𝒳", "\r\n",
]
TEXTS = st.lists(st.none() | st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=5)


def sliced(scan, texts, **more):
    return pa.concat_arrays([scan(t, **more) for t in braces.slices(pa.array(texts, pa.string()))] or [scan(pa.array([], pa.string()), **more)]).to_pylist()


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_resources(texts):
    assert sliced(braces.resource_spans, texts) == [plain_braces.resources(PLAIN[False], t) for t in texts]


@settings(max_examples=600, deadline=None)
@given(TEXTS, st.sampled_from([("module", None), ("module", "m"), ("resource", None), ("x", None)]))
def test_blocks_without_comments(texts, kind):
    header = braces.kind_header(*kind)
    plain = plain_braces.Blocks(header, comments=True)
    got = sliced(braces.block_spans, texts, pattern=braces.header_pattern(header), comments=True)
    assert [[(b["start"], b["end"]) for b in row] for row in got] == [plain.find(t or "") for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([VARIABLE_REF, RESOURCE_REF]))
def test_references(texts, pattern):
    compiled = re.compile(pattern)
    assert sliced(braces.matches, texts, pattern=compiled) == [plain_braces.matches(compiled, t) for t in texts]


def test_slices_and_views(monkeypatch):
    monkeypatch.setattr(braces, "SLICE", 64)
    texts = ['resource "a" "b" {\n x = 1\n}\n' * k for k in range(12)] + [None, "", "é" * 100]
    assert sliced(braces.resource_spans, texts) == [plain_braces.resources(PLAIN[False], t) for t in texts]
    view = pa.array(["{" * 9, *texts], pa.string()).slice(1)
    assert sum(len(s) for s in braces.slices(view)) == len(texts)
    assert pa.concat_arrays([braces.resource_spans(s) for s in braces.slices(view)]).to_pylist() == [plain_braces.resources(PLAIN[False], t) for t in texts]


def test_scan_is_linear():
    one = "".join(f'resource "t" "n{i}" {{\n  a = 1\n  b {{\n    c = 2\n  }}\n}}\n' for i in range(6000))

    def seconds(text):
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            assert len(braces.resource_spans(pa.array([text]))[0]) == text.count("resource")
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(one * 2) < 3.5 * seconds(one)
