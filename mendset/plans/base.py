"""The catalogue of registered queries, and SQL fragments their cross-checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendset.functions.text import WHITESPACE
from mendset.operators.taxonomy import FAULTS
from mendset.sources import rendered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


HCL = f"hcl AS (SELECT o_orderkey AS doc_id, {rendered.HCL_PATH} AS path, {rendered.HCL_TEXT} AS text FROM orders)"
TPL = (
    f"tpl AS (SELECT o_orderkey AS doc_id, {rendered.TEMPLATE_PATH} AS path, "
    f"{rendered.TEMPLATE_TEXT} AS text FROM orders)"
)
CONFIGS = f"""{HCL}, {TPL}, configs AS (
  SELECT doc_id * 2 AS doc_id, path, 'terraform' AS format, text, doc_id * 2 AS seq FROM hcl
  UNION ALL SELECT doc_id * 2 + 1, path, 'cloudformation', text, doc_id * 2 + 1 FROM tpl)"""

BLOCKS = (
    HCL
    + r""", found AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?m)^resource "[^"]+" "[^"]+" \{\n(?:  [^\n]*\n)*\}', 0) AS bodies FROM hcl),
blocks AS (
  SELECT doc_id, text, len(bodies) AS n, i - 1 AS i, body, instr(text, body) - 1 AS s,
         instr(text, body) - 1 + length(body) AS e,
         regexp_extract(body, '"([^"]+)" "([^"]+)"', 1) AS type, regexp_extract(body, '"([^"]+)" "([^"]+)"', 2) AS name
  FROM (SELECT doc_id, text, bodies, unnest(bodies) AS body, generate_subscripts(bodies, 1) AS i FROM found))"""
)
ATTRS = (
    BLOCKS
    + r""", lines AS (
  SELECT doc_id, text, i, type, name AS block, s, n, unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) AS j FROM blocks),
placed AS (
  SELECT *, s + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, i ORDER BY j
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines),
attrs AS (
  SELECT doc_id, text, i, n, type, block, start, line, j,
         length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + j - 1 AS line_no,
         regexp_extract(line, '^\s*(\w+)\s*=', 1) AS attr,
         row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS a,
         count(*) OVER (PARTITION BY doc_id, i) AS n_attrs
  FROM placed WHERE regexp_matches(line, '^  \w+\s*=') AND NOT ends_with(line, '{'))"""
)


def draw_sql(fault: str, slot: str = "''", salt: str = "''", doc: str = "doc_id", seed: int = 42) -> str:
    key = f"concat_ws('|', '{seed}', {doc}::VARCHAR, '{fault}', {slot}, {salt})"
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def kth_match(pattern: str, k: str, text: str = "text") -> str:
    """0-based start of the k-th match (k from 1)."""
    gaps = f"list_sum(list_transform(list_slice(string_split_regex({text}, '{pattern}'), 1, {k}), lambda x: length(x)))"
    hits = f"list_sum(list_transform(list_slice(regexp_extract_all({text}, '{pattern}', 0), 1, {k} - 1), lambda x: length(x)))"
    return f"({gaps} + coalesce({hits}, 0))::BIGINT"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def taxonomy_sql() -> str:
    rows = []
    for i, (category, name, severity, formats, error, tags, description) in enumerate(FAULTS):
        cells = [f"{category}.{name}", category, name, severity, ",".join(formats), error, ",".join(tags), description]
        rows.append(f"({i}, " + ", ".join(quote(c) for c in cells) + ")")
    columns = "ord, fault_id, category, name, severity, formats, example_error, tags, description"
    return f"faults({columns}) AS (VALUES {', '.join(rows)})"


WHITESPACE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
LINE_COUNT_SQL = (
    "(length(regexp_replace({t}, '[^\n]', '', 'g')) + CASE WHEN length({t}) > 0 AND right({t}, 1) <> chr(10) THEN 1 ELSE 0 END)"
)
