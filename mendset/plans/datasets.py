"""Registered queries: records, splits, statistics and benchmark curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.functions.text import line_count as count_lines
from mendset.operators import curation, records
from mendset.operators.inject import HCL_FAULTS, TEMPLATE_FAULTS, inject
from mendset.operators.taxonomy import category_of, fault_dim
from mendset.plans.base import CONFIGS, HCL, LINE_COUNT_SQL, SQL, TPL, longs, query, table, taxonomy_sql
from mendset.plans.faults import ALL_BROKEN, both_formats
from mendset.sources import corpus
from mendset.sources.corpus import materialized
from mendset.sources.rendered import configs

# A record table out of `documents`: every branch of filters, quotas and defaults occurs in it.
_FAULTS = [
    "SYNTACTIC.missing_closing_brace", "REFERENCE.undefined_variable", "SEMANTIC.invalid_cidr", "DEPENDENCY.circular_dependency",
    "PROVIDER.missing_provider", "SECURITY.missing_encryption", "CROSS_RESOURCE.wrong_az_reference", "INTRINSIC.invalid_join",
]
_REC = f"""rec AS (SELECT doc_id AS seq, doc_id::VARCHAR AS id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'cloudformation' ELSE 'terraform' END AS format,
  text AS broken_config, md5(text) AS gold_hash, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 9 = 0 THEN 2 ELSE 1 END AS n_faults, {_FAULTS!r}[1 + n_chars % 8] AS fault,
  {_FAULTS!r}[1 + (n_chars + 3) % 8] AS second_fault, doc_id % 10 <> 0 AS has_errors, ['low', 'medium', 'high'][1 + n_chars // 8 % 3] AS difficulty,
  CASE WHEN doc_id % 4 = 0 THEN 'agentic' ELSE 'programmatic' END AS source FROM documents)"""


def _records(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(f) for f in _FAULTS])
    levels = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    d, n = F.col("doc_id"), F.col("n_chars")
    first, second = F.get(names, (n % 8).cast("int")), F.get(names, ((n + 3) % 8).cast("int"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        d.alias("seq"),
        d.cast("string").alias("id"),
        F.when(d % 13 == 0, None).when(d % 3 == 0, "cloudformation").otherwise("terraform").alias("format"),
        F.col("text").alias("gold_config"),
        F.col("text").alias("broken_config"),
        F.when(d % 10 != 0, F.array(F.lit("an error"))).otherwise(none).alias("errors"),
        F.when(d % 2 == 0, none).alias("warnings"),
        F.when(d % 11 == 0, none).when(d % 9 == 0, F.array(first, second)).otherwise(F.array(first)).alias("fault_types"),
        F.get(levels, (F.floor(n / 8) % 3).cast("int")).alias("difficulty"),
        F.when(d % 4 == 0, "agentic").otherwise("programmatic").alias("source"),
        F.lit("").alias("split"),
        F.md5("text").alias("gold_hash"),
    )


# ---- 2.9 records



_MADE = "\nUNION ALL ".join(
    f"SELECT doc_id, '{fmt}' AS format, '{f}' AS fault_id, description, broken_hash FROM ({SQL[f]}) WHERE part = 0"
    for fmt, names in (("terraform", HCL_FAULTS), ("cloudformation", TEMPLATE_FAULTS))
    for f in names
)


@query(
    "to_record",
    f"""WITH {HCL}, {TPL}, {taxonomy_sql()}, made AS ({_MADE}),
golds AS (SELECT doc_id, 'terraform' AS format, md5(text) AS gold_hash FROM hcl UNION ALL SELECT doc_id, 'cloudformation', md5(text) FROM tpl)
SELECT sha256(concat_ws('|', doc_id::VARCHAR, gold_hash, fault_id, '1')) AS id, format, broken_hash,
 CASE WHEN example_error = '' THEN 'Injected ' || fault_id ELSE example_error END AS errors, 0::BIGINT AS n_warnings, fault_id AS fault_types,
 made.description AS fault_description, severity AS difficulty, 'programmatic' AS source, gold_hash, doc_id * 100 + ord AS seq
FROM made JOIN golds USING (doc_id, format) JOIN faults USING (fault_id)""",
)
def to_record(spark, sf_dir):
    """Records of all faults on every config of their format."""
    broken = inject(both_formats(spark, sf_dir).withColumn("seq", F.col("doc_id")))
    rows = records.to_record(broken, fault_dim(spark))
    return rows.select(
        "id", "format", F.md5("broken_config").alias("broken_hash"), F.array_join("errors", "|").alias("errors"),
        F.size("warnings").cast("bigint").alias("n_warnings"), F.array_join("fault_types", "|").alias("fault_types"),
        "fault_description", "difficulty", "source", "gold_hash", "seq",
    )


@query("gold_hash", "SELECT doc_id, md5(text) AS gold_hash FROM documents")
def gold_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.gold_hash(F.col("text")).alias("gold_hash"))


_SPLIT = f"""{_REC}, h AS (SELECT gold_hash, row_number() OVER (ORDER BY gold_hash) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT gold_hash FROM rec)),
sp AS (SELECT gold_hash, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM h),
srec AS (SELECT rec.*, sp.split FROM rec JOIN sp ON rec.gold_hash = sp.gold_hash)"""


@query("group_split", f"WITH {_SPLIT} SELECT id, gold_hash, split FROM srec")
def group_split(spark, sf_dir):
    return records.group_split(_records(spark, sf_dir)).select("id", "gold_hash", "split")


@query(
    "split_sink",
    f"""WITH {_SPLIT} SELECT split, '{{"id":"' || id || '","gold_hash":"' || gold_hash || '","difficulty":"' || difficulty || '"}}' AS line FROM srec""",
)
def split_sink(spark, sf_dir):
    """Splits written as JSON lines and read back."""
    path = corpus.new_path(spark)
    corpus.split_sink(records.group_split(_records(spark, sf_dir)), path)
    rows = corpus.record_scan(spark, path, f"{corpus.RECORD_SCHEMA}, split_folder string")
    return rows.select(F.col("split_folder").alias("split"), F.to_json(F.struct("id", "gold_hash", "difficulty")).alias("line"))


@query(
    "leakage_check",
    f"""WITH {_REC}, s AS (SELECT gold_hash, CASE WHEN seq % 3 = 0 THEN 'train' WHEN seq % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM rec)
SELECT gold_hash, min(split) AS first_split, max(split) AS last_split FROM s GROUP BY gold_hash HAVING count(DISTINCT split) > 1""",
)
def leakage_check(spark, sf_dir):
    # split by position on purpose, so that copied texts do leak
    split = F.when(F.col("seq") % 3 == 0, "train").when(F.col("seq") % 3 == 1, "val").otherwise("test")
    return records.leakage_check(_records(spark, sf_dir).withColumn("split", split))


@query(
    "dist_fault_type",
    f"""WITH {_REC}, x AS (SELECT fault AS fault_type FROM rec WHERE n_faults >= 1 UNION ALL SELECT second_fault FROM rec WHERE n_faults = 2)
SELECT fault_type, count(*) AS records FROM x GROUP BY fault_type""",
)
def dist_fault_type(spark, sf_dir):
    return records.fault_distribution(_records(spark, sf_dir))


@query("dist_format", f"WITH {_REC} SELECT format, count(*) AS records FROM rec GROUP BY format")
def dist_format(spark, sf_dir):
    return records.distribution(_records(spark, sf_dir), "format")


@query("dist_source", f"WITH {_REC} SELECT source, count(*) AS records FROM rec GROUP BY source")
def dist_source(spark, sf_dir):
    return records.distribution(_records(spark, sf_dir), "source")


@query("dist_difficulty", f"WITH {_REC} SELECT difficulty, count(*) AS records FROM rec GROUP BY difficulty")
def dist_difficulty(spark, sf_dir):
    return records.distribution(_records(spark, sf_dir), "difficulty")


@query(
    "split_counts",
    f"""WITH {_SPLIT} SELECT s.split, count(r.id) AS records FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN srec r ON r.split = s.split GROUP BY s.split""",
)
def split_counts(spark, sf_dir):
    return records.split_counts(records.group_split(_records(spark, sf_dir)))


_HITS = f"""{HCL}, {TPL}, hits AS ({ALL_BROKEN}),
gold AS (SELECT doc_id, 'terraform' AS format, md5(text) AS h FROM hcl UNION ALL SELECT doc_id, 'cloudformation', md5(text) FROM tpl),
per AS (SELECT format, fault_id, count(*) AS n FROM hits GROUP BY ALL),
f AS (SELECT * FROM (VALUES {", ".join(f"('{fmt}', '{f}')" for fmt, names in (("terraform", HCL_FAULTS), ("cloudformation", TEMPLATE_FAULTS)) for f in names)}) t(format, fault_id)),
na AS (SELECT f.fault_id, sum((SELECT count(*) FROM gold g WHERE g.format = f.format) - coalesce(per.n, 0))::BIGINT AS not_applicable
  FROM f LEFT JOIN per ON per.format = f.format AND per.fault_id = f.fault_id GROUP BY f.fault_id),
lost AS (SELECT count(*) AS n FROM gold WHERE h NOT IN (SELECT g.h FROM gold g JOIN hits x ON x.doc_id = g.doc_id AND x.format = g.format))"""


def _run(spark, sf_dir):
    """A run of all faults over all configs: golds, chosen faults, and one narrow row per record."""
    gold = both_formats(spark, sf_dir)
    chosen = fault_dim(spark).select(F.explode("formats").alias("format"), "fault_id").filter(F.col("format").isin("terraform", "cloudformation"))
    hashed = gold.withColumn("gold_hash", records.gold_hash(F.col("text")))  # once for a text, not for each of its edits
    rows = inject(hashed).select("format", "gold_hash", F.array("fault_id").alias("fault_types"))
    return gold, chosen, materialized(rows)


@query("na_counts", f"WITH {_HITS} SELECT * FROM na WHERE not_applicable > 0")
def na_counts(spark, sf_dir):
    return records.na_counts(*_run(spark, sf_dir))


@query("resistant_golds", f"WITH {_HITS} SELECT n AS resistant_configs FROM lost")
def resistant_golds(spark, sf_dir):
    gold, _, rows = _run(spark, sf_dir)
    return records.resistant_golds(gold, rows)


@query(
    "run_stats",
    f"""WITH {_HITS} SELECT (SELECT count(*) FROM gold) AS total_gold, (SELECT count(*) FROM hits) AS total_broken,
 (SELECT n FROM lost) AS resistant_configs, (SELECT not_applicable FROM na WHERE fault_id = 'SEMANTIC.invalid_region') AS no_region, 0::BIGINT AS errors""",
)
def run_stats(spark, sf_dir):
    row = records.run_stats(*_run(spark, sf_dir))
    return row.select(
        "total_gold", "total_broken", "resistant_configs",
        F.try_element_at("faults_not_applicable", F.lit("SEMANTIC.invalid_region")).alias("no_region"), "errors",
    )


@query(
    "metadata_sink",
    f"""WITH {_SPLIT}, x AS (SELECT fault AS fault_type FROM rec WHERE n_faults >= 1 UNION ALL SELECT second_fault FROM rec WHERE n_faults = 2),
ft AS (SELECT string_agg('"' || fault_type || '":' || n, ',' ORDER BY fault_type) AS t FROM (SELECT fault_type, count(*) AS n FROM x GROUP BY fault_type)),
fo AS (SELECT string_agg('"' || format || '":' || n, ',' ORDER BY format) AS t FROM (SELECT coalesce(format, 'none') AS format, count(*) AS n FROM rec GROUP BY 1)),
so AS (SELECT string_agg('"' || source || '":' || n, ',' ORDER BY source) AS t FROM (SELECT source, count(*) AS n FROM rec GROUP BY source)),
di AS (SELECT string_agg('"' || difficulty || '":' || n, ',' ORDER BY difficulty) AS t FROM (SELECT difficulty, count(*) AS n FROM rec GROUP BY difficulty)),
sc AS (SELECT string_agg('"' || split || '":' || n, ',' ORDER BY split) AS t FROM (SELECT split, count(*) AS n FROM srec GROUP BY split))
SELECT '{{"total_records":' || (SELECT count(*) FROM rec) || ',"total_gold_configs":' || (SELECT count(DISTINCT gold_hash) FROM rec) || ',"splits":{{' || sc.t || '}},"ratios":[0.8,0.1,0.1],"fault_type_distribution":{{' || ft.t
 || '}},"format_distribution":{{' || fo.t || '}},"source_distribution":{{' || so.t || '}},"difficulty_distribution":{{' || di.t || '}}}}' AS document FROM ft, fo, so, di, sc""",
)
def metadata_sink(spark, sf_dir):
    rows = records.group_split(_records(spark, sf_dir)).withColumn("format", F.coalesce("format", F.lit("none")))
    path = corpus.new_path(spark)
    records.metadata_sink(rows, path)
    return spark.read.text(path).select(F.col("value").alias("document"))


@query(
    "benchmark_sink",
    f"""WITH {_REC} SELECT id, coalesce(format, '') AS format, 0::BIGINT AS n_warnings, CASE WHEN seq % 6 = 0 THEN '' ELSE gold_hash END AS gold_hash, difficulty, n_faults::BIGINT AS n_faults FROM rec""",
)
def benchmark_sink(spark, sf_dir):
    gap = F.when(F.col("seq") % 6 != 0, F.col("gold_hash"))
    path = corpus.new_path(spark)
    corpus.benchmark_sink(_records(spark, sf_dir).withColumn("gold_hash", gap), path)
    rows = corpus.record_scan(spark, path, corpus.BENCHMARK_SCHEMA)
    return rows.select(
        "id", F.coalesce("format", F.lit("")).alias("format"), F.size("warnings").cast("bigint").alias("n_warnings"),
        "gold_hash", "difficulty", F.size("fault_types").cast("bigint").alias("n_faults"),
    )


# ---- 2.10 curation

_LINES = LINE_COUNT_SQL.format(t="broken_config")
_CAND = f"{_REC}, cand AS (SELECT *, string_split(fault, '.')[1] AS category FROM rec WHERE n_faults = 1 AND has_errors AND {_LINES} >= 10)"
_DEDUP = f"{_CAND}, ded AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY gold_hash, category ORDER BY seq) = 1)"
_PICK = f"""{_DEDUP}, seen AS (SELECT category, difficulty, min(seq) AS d_at FROM ded GROUP BY ALL),
p AS (SELECT *, min(d_at) OVER (PARTITION BY category) AS c_at, count(*) OVER (PARTITION BY category) AS nd FROM seen),
q AS (SELECT *, greatest(1, greatest(1, 60 // (SELECT count(DISTINCT category) FROM seen)) // greatest(nd, 1)) AS quota FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY category, difficulty ORDER BY seq) AS rn FROM ded),
sel AS (SELECT r.*, row_number() OVER (ORDER BY c_at, d_at, rn) AS pos FROM r JOIN q ON r.category = q.category AND r.difficulty = q.difficulty WHERE rn <= quota QUALIFY pos <= 60)"""


def _deduped(spark, sf_dir):
    return curation.bench_dedup(curation.bench_filter(_records(spark, sf_dir)))


@query(
    "fault_category",
    f"WITH {_REC} SELECT id, CASE WHEN seq % 7 = 0 THEN 'plain' ELSE string_split(fault, '.')[1] END AS category FROM rec WHERE n_faults > 0",
)
def fault_category(spark, sf_dir):
    first = F.when(F.col("seq") % 7 == 0, "plain").otherwise(F.get("fault_types", F.lit(0)))
    rows = _records(spark, sf_dir).filter(F.size("fault_types") > 0)
    return rows.select("id", category_of(first).alias("category"))


@query("line_count", f"SELECT doc_id, {LINE_COUNT_SQL.format(t='text')}::BIGINT AS lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", count_lines(F.col("text")).cast("bigint").alias("lines"))


@query("bench_filter", f"WITH {_CAND} SELECT id FROM cand")
def bench_filter(spark, sf_dir):
    return curation.bench_filter(_records(spark, sf_dir)).select("id")


@query("bench_dedup", f"WITH {_DEDUP} SELECT id, category FROM ded")
def bench_dedup(spark, sf_dir):
    return _deduped(spark, sf_dir).select("id", "category")


@query("balanced_select", f"WITH {_PICK} SELECT pos, id, category, difficulty FROM sel")
def balanced_select(spark, sf_dir):
    chosen = curation.balanced_select(_deduped(spark, sf_dir), 60)
    return longs(chosen.select("pos", "id", "category", "difficulty"), "pos")


@query(
    "bench_distributions",
    f"""WITH {_PICK} SELECT 'category' AS dimension, category AS value, count(*) AS entries FROM sel GROUP BY category
UNION ALL SELECT 'difficulty', difficulty, count(*) FROM sel GROUP BY difficulty UNION ALL SELECT 'format', coalesce(format, 'unknown'), count(*) FROM sel GROUP BY 2""",
)
def bench_distributions(spark, sf_dir):
    return curation.bench_distributions(curation.balanced_select(_deduped(spark, sf_dir), 60))


@query("bench_head", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20")
def bench_head(spark, sf_dir):
    entries = table(spark, sf_dir, "benchmark").withColumn("seq", F.col("item_id"))
    return curation.bench_head(entries, 20).select("item_id", "text")


@query(
    "curate_benchmark",
    f"""WITH {CONFIGS}, {taxonomy_sql()} SELECT category, difficulty, count(*) AS entries FROM (SELECT 'SEMANTIC' AS category, 'low' AS difficulty, doc_id, text FROM configs WHERE format = 'terraform' AND contains(text, 'region = "')
  QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 ORDER BY doc_id LIMIT 100) GROUP BY ALL
UNION ALL SELECT 'INTRINSIC', 'medium', least(100, count(DISTINCT md5(text))) FROM configs WHERE contains(text, '!Join')""",
)
def curate_benchmark(spark, sf_dir):
    """From configs to a balanced benchmark, with the records written once in between."""
    broken = inject(configs(spark, sf_dir), ["SEMANTIC.invalid_region"], ["INTRINSIC.invalid_join"])
    rows = corpus.materialized(records.to_record(broken, fault_dim(spark)))
    chosen = curation.balanced_select(curation.bench_dedup(curation.bench_filter(rows)), 200)
    return chosen.groupBy("category", "difficulty").agg(F.count("*").alias("entries"))
