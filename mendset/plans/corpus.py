"""Registered queries: sources, sinks, corpus filters and format rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.operators import filters, formats
from mendset.plans.base import CONFIGS, HCL, TPL, WHITESPACE_SQL, query, table
from mendset.sources import corpus, landing
from mendset.sources.rendered import HCL_PATH, TEMPLATE_PATH, configs, hcl_configs, template_configs

# ---- 2.1 sources and sinks

_FILE = """concat('corpus', CASE WHEN page_id % 7 = 0 THEN '/.cache' ELSE '' END, '/p', CAST(page_id AS STRING),
  CASE page_id % 6 WHEN 0 THEN '.tf' WHEN 1 THEN '.yaml' WHEN 2 THEN '.yml' WHEN 3 THEN '.json' WHEN 4 THEN '.template' ELSE '.md' END)"""


@query(
    "corpus_scan",
    rf"""SELECT path, strlen(html)::BIGINT AS length, md5(html) AS text_md5
FROM (SELECT {_FILE} AS path, page_id, coalesce(html, '') AS html FROM pages)
WHERE regexp_matches(path, '\.(tf|yaml|yml|json|template)$') AND NOT contains(path, '/.') AND strlen(html) > 50 AND page_id % 11 <> 0""",
)
def corpus_scan(spark, sf_dir):
    """The pages as a folder of files, some in a hidden folder, some of another extension and some with bad bytes, scanned."""
    root = corpus.new_path(spark)
    bad = F.when(F.col("page_id") % 11 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.coalesce("html", F.lit("")).cast("binary"), bad)
    corpus.write_files(table(spark, sf_dir, "pages").select(F.expr(_FILE).alias("path"), content.alias("content")), root)
    found = corpus.corpus_scan(spark, root, ordered=False)
    return found.select(F.regexp_extract("path", "/(corpus/.*)$", 1).alias("path"), "length", F.md5("text").alias("text_md5"))


@query(
    "record_scan",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS note FROM events",
)
def record_scan(spark, sf_dir):
    """The events as JSON lines, written and scanned with fewer and more columns than they have."""
    path = corpus.new_path(spark)
    line = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"unknown":[1],'), F.substring("props", F.lit(2), F.length("props")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return corpus.record_scan(spark, path, "event_id bigint, k bigint, note string")


_LANDED = r"""WITH files AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS repo, 'src/v' || (page_id % 3) || CASE page_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.tf' ELSE '' END AS path,
    CASE WHEN page_id % 2 = 0 THEN 'cloudformation' ELSE 'terraform' END AS format FROM pages),
e AS (SELECT *, CASE WHEN format = 'terraform' THEN '.tf' WHEN ends_with(path, '.json') THEN '.json' ELSE '.yaml' END AS ext FROM files),
k AS (SELECT *, replace(replace(repo || '__' || path, '/', '_'), '\', '_') AS safe FROM e)
SELECT format, CASE WHEN ends_with(safe, ext) THEN safe ELSE safe || ext END AS key, max(page_id) AS seq FROM k GROUP BY ALL"""


def _landing_files(spark, sf_dir) -> DataFrame:
    path = F.concat(
        F.lit("src/v"), (F.col("page_id") % 3).cast("string"),
        F.when(F.col("page_id") % 4 == 0, ".json").when(F.col("page_id") % 4 == 1, ".tf").otherwise(""),
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), F.regexp_extract("url", "//([^/]+)", 1).alias("repo"), path.alias("path"),
        F.when(F.col("page_id") % 2 == 0, "cloudformation").otherwise("terraform").alias("format"),
        F.col("html").alias("content"),
    )


@query("landing_key", _LANDED)
def landing_key(spark, sf_dir):
    return corpus.land(_landing_files(spark, sf_dir)).select("format", "key", "seq")


@query("landing_store", _LANDED)
def landing_store(spark, sf_dir):
    """The same files landed in two runs, which both meet most keys; the later run holds older files, too."""
    files = _landing_files(spark, sf_dir)
    first = F.col("seq") % 3 != 0
    name = f"landed_{uuid.uuid4().hex}"
    landing.begin(files.filter(first), name, 8, corpus.new_path(spark))
    return landing.merged(spark, name, files.filter(~first)).select("format", "key", "seq")


@query(
    "module_flatten",
    """SELECT 'registry__' || source || '__d' || doc_id || '__part' || (i - 1) || '.tf' AS key, md5(content) AS content_hash
FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
)
def module_flatten(spark, sf_dir):
    files = F.transform(
        F.split("text", "\n", -1),
        lambda c, i: F.struct(F.concat(F.lit("part"), i.cast("string"), F.lit(".tf")).alias("filename"), c.alias("content")),
    )
    modules = table(spark, sf_dir, "documents").select(
        F.col("source").alias("namespace"), F.concat(F.lit("d"), F.col("doc_id")).alias("name"), files.alias("configs")
    )
    return corpus.module_flatten(modules).select("key", F.md5("content").alias("content_hash"))


@query(
    "landing_counts",
    """WITH d AS (SELECT source, CASE WHEN doc_id % 3 = 0 AND source <> 'src1' THEN 'cloudformation' ELSE 'terraform' END AS format FROM documents),
f AS (SELECT * FROM (VALUES ('terraform'), ('cloudformation')) t(format))
SELECT s.source, f.format, count(d.format) AS rows FROM (SELECT DISTINCT source FROM d) s CROSS JOIN f
LEFT JOIN d ON d.source = s.source AND d.format = f.format GROUP BY ALL""",
)
def landing_counts(spark, sf_dir):
    template = (F.col("doc_id") % 3 == 0) & (F.col("source") != "src1")
    files = table(spark, sf_dir, "documents").select(
        "source", F.when(template, "cloudformation").otherwise("terraform").alias("format")
    )
    return corpus.landing_counts(files)


# ---- 2.2 filters, dedup, caps


@query(
    "secret_filter",
    r"""SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)(AKIA[0-9A-Z]{16}|aws_secret_access_key|password\s*=\s*".{8,}")')""",
)
def secret_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(filters.has_no_secret(F.col("text"))).select("doc_id")


@query(
    "length_filter",
    f"SELECT doc_id FROM documents WHERE length(text) <= 20000 AND length(trim(text, {WHITESPACE_SQL})) >= 300",
)
def length_filter(spark, sf_dir):
    fair = filters.has_fair_length(F.col("text"), 20000, 300)
    return table(spark, sf_dir, "documents").filter(fair).select("doc_id")


_COUNT = "((length(text) - length(replace(text, {0}, ''))) // length({0}))"


@query(
    "tf_density_filter",
    f"""WITH {HCL}, c AS (SELECT doc_id, ({_COUNT.format("'resource '")} + {_COUNT.format("'data '")} + {_COUNT.format("'module '")})::BIGINT AS blocks FROM hcl)
SELECT * FROM c WHERE blocks >= 5""",
)
def tf_density_filter(spark, sf_dir):
    kept = hcl_configs(spark, sf_dir).filter(filters.is_dense_hcl(F.col("text"), 5))
    return kept.select("doc_id", filters.hcl_block_count(F.col("text")).cast("bigint").alias("blocks"))


@query(
    "cf_density_filter",
    f"""WITH {TPL} SELECT doc_id FROM tpl WHERE (contains(text, 'AWSTemplateFormatVersion') OR contains(text, 'Resources:') OR contains(text, '"Resources"'))
AND {_COUNT.format("'Type: AWS::'")} + {_COUNT.format("""'"Type": "AWS::'""")} >= 4""",
)
def cf_density_filter(spark, sf_dir):
    return template_configs(spark, sf_dir).filter(filters.is_dense_template(F.col("text"), 4)).select("doc_id")


_NAME = """concat(CASE page_id % 5 WHEN 0 THEN 'My-Stack' WHEN 1 THEN 'CFN_main' WHEN 2 THEN 'notes' WHEN 3 THEN 'Template' ELSE 'x.cloudformation' END,
  CAST(page_id AS STRING), CASE page_id % 4 WHEN 0 THEN '.YAML' WHEN 1 THEN '.json' WHEN 2 THEN '.yml' ELSE '.txt' END)"""


@query(
    "filename_hint_filter",
    rf"""SELECT page_id, name FROM (SELECT page_id, {_NAME} AS name FROM pages)
WHERE regexp_matches(lower(name), '\.(yaml|yml|json)$') AND regexp_matches(lower(name), 'template|cfn|cloudformation|stack')""",
)
def filename_hint_filter(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select("page_id", F.expr(_NAME).alias("name"))
    return named.filter(filters.has_name_hint(F.col("name")))


@query(
    "content_marker_filter",
    f"WITH {CONFIGS} SELECT doc_id, path FROM configs WHERE contains(text, 'AWSTemplateFormatVersion') OR contains(text, 'Resources')",
)
def content_marker_filter(spark, sf_dir):
    return configs(spark, sf_dir).filter(filters.has_marker(F.col("text"))).select("doc_id", "path")


@query(
    "sha_dedup",
    "SELECT doc_id, md5(text) AS sha FROM documents WHERE n_chars >= 100 QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
)
def sha_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.md5("text").alias("sha"), "n_chars"
    )
    return filters.sha_dedup(docs, F.col("n_chars") >= 100).select(F.col("seq").alias("doc_id"), "sha")


_SOFT = """counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
taken AS (SELECT source FROM (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts) WHERE before < 120)"""


@query("soft_cap", f"WITH {_SOFT} SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM taken)")
def soft_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return filters.soft_cap(docs, "source", 120)


@query(
    "hard_cap",
    f"WITH {_SOFT} SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM taken) ORDER BY source, doc_id LIMIT 120",
)
def hard_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return filters.hard_cap(docs, "source", "doc_id", 120)


@query("gold_filter", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gold_filter(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    return filters.gold_filter(table(spark, sf_dir, "documents").select("doc_id", "source"), verdicts, "doc_id")


_ODD = "concat('docs/note_', CAST(o_custkey AS STRING), '.md')"


@query(
    "changed_set",
    f"""SELECT DISTINCT path FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN {_ODD} ELSE {HCL_PATH} END AS path FROM orders
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN {HCL_PATH} ELSE {TEMPLATE_PATH} END FROM orders) WHERE NOT ends_with(path, '.md')""",
)
def changed_set(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = orders.select(
        F.expr(f"CASE WHEN o_orderkey % 4 = 0 THEN {_ODD} ELSE {HCL_PATH} END").alias("path")
    )
    two = orders.select(
        F.expr(f"CASE WHEN o_orderkey % 2 = 0 THEN {HCL_PATH} ELSE {TEMPLATE_PATH} END").alias("path")
    )
    return filters.changed_set(one, two)


# ---- 2.3 formats

_ANY_PATH = """concat(CASE WHEN doc_id % 11 = 0 THEN 'CloudFormation/' ELSE 'x/' END, 'f', CAST(doc_id AS STRING),
  CASE doc_id % 8 WHEN 0 THEN '.tf' WHEN 1 THEN '.YAML' WHEN 2 THEN '.json' WHEN 3 THEN '.template' WHEN 4 THEN '.hcl' WHEN 5 THEN '.yml' WHEN 6 THEN '.TF' ELSE '' END)"""
_ANY = f"{CONFIGS}, files AS (SELECT doc_id, {_ANY_PATH} AS path, text FROM configs)"


def _any_files(spark, sf_dir):
    return configs(spark, sf_dir).select("doc_id", F.expr(_ANY_PATH).alias("path"), "text")


@query(
    "format_by_suffix",
    rf"""WITH {_ANY} SELECT doc_id, path, CASE WHEN regexp_matches(lower(path), '\.(yaml|yml|json|template)$') THEN 'cloudformation' ELSE 'terraform' END AS format FROM files""",
)
def format_by_suffix(spark, sf_dir):
    return _any_files(spark, sf_dir).select("doc_id", "path", formats.format_by_suffix(F.col("path")).alias("format"))


@query(
    "format_by_path_content",
    rf"""WITH {_ANY} SELECT doc_id, path, CASE WHEN ends_with(path, '.tf') THEN 'terraform' WHEN contains(lower(path), 'cloudformation') THEN 'cloudformation'
  WHEN regexp_matches(path, '\.(yaml|yml|json|template)$') AND regexp_matches(text, '(?m)^ {{0,2}}"?(AWSTemplateFormatVersion|Resources)"?:') THEN 'cloudformation' ELSE 'terraform' END AS format FROM files""",
)
def format_by_path_content(spark, sf_dir):
    fmt = formats.format_by_path_content(F.col("path"), F.col("text"))
    return _any_files(spark, sf_dir).select("doc_id", "path", fmt.alias("format"))


@query(
    "format_with_confidence",
    rf"""WITH {_ANY}, s AS (SELECT doc_id, path, regexp_extract(lower(path), '\.[a-z]+$', 0) AS x, contains(text, 'AWSTemplateFormatVersion') AS v,
  contains(text, 'Type: AWS::') OR contains(text, '"Type": "AWS::') AS t, contains(text, 'resource ') AND contains(text, 'provider ') AS b FROM files)
SELECT doc_id, path, CASE WHEN x = '.tf' THEN 'terraform' WHEN x IN ('.yaml', '.yml', '.json') AND (v OR t) THEN 'cloudformation' WHEN x = '.hcl' THEN 'terraform' WHEN b THEN 'terraform' WHEN v THEN 'cloudformation' ELSE 'terraform' END AS format,
 CASE WHEN x = '.tf' THEN 1.0::DOUBLE WHEN x IN ('.yaml', '.yml', '.json') AND v THEN 1.0 WHEN x IN ('.yaml', '.yml', '.json') AND t THEN 0.9 WHEN x = '.hcl' THEN 0.8 WHEN b THEN 0.6 WHEN v THEN 0.9 ELSE 0.3 END AS confidence FROM s""",
)
def format_with_confidence(spark, sf_dir):
    answer = formats.format_with_confidence(F.col("path"), F.col("text"))
    rows = _any_files(spark, sf_dir).select("doc_id", "path", answer.alias("a"))
    return rows.select("doc_id", "path", "a.format", "a.confidence")


