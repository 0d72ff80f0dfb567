"""Registered queries: evaluation, exports and repair logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendset.operators import evaluation as ev
from mendset.operators import export, validation
from mendset.plans.base import HCL, WHITESPACE_SQL, longs, query, quote, table
from mendset.sources import corpus
from mendset.sources.rendered import hcl_configs

# ---- 2.11 entries from orders, attempts from line items

_CATS = ["SYNTACTIC", "REFERENCE", "SEMANTIC", "DEPENDENCY", "PROVIDER", "SECURITY", "CROSS_RESOURCE", "INTRINSIC"]
_LEVEL = "CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium' ELSE 'low' END"


def _entries(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _CATS])
    key = F.col("o_orderkey")
    first = F.concat(F.get(names, (key % 8).cast("int")), F.lit(".a"))
    # some entries carry two faults of one category, some of two categories
    second = F.concat(F.get(names, ((key + key % 2) % 8).cast("int")), F.lit(".b"))
    return table(spark, sf_dir, "orders").select(
        key.alias("entry_id"),
        F.when(key % 2 == 0, "terraform").otherwise("cloudformation").alias("format"),
        F.when(key % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("fault_types"),
        F.expr(_LEVEL).alias("difficulty"),
    )


def _attempts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model"), F.col("l_orderkey").alias("entry_id"),
        (F.col("l_returnflag") == "N").alias("passed"),
    )


_MODELS, _CONFIGURED = ["F", "O"], 20  # attempts configured for each entry; no order has more line items


def _results(spark, sf_dir) -> DataFrame:
    """Every entry with every model, n attempts as configured, and the passes among them."""
    return ev.entry_counts(_entries(spark, sf_dir), _attempts(spark, sf_dir), _MODELS, _CONFIGURED)


def _breakdown(spark, sf_dir) -> DataFrame:
    return ev.pass_breakdown(_results(spark, sf_dir))


_RES = f"""ent AS (SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 2 = 0 THEN 'terraform' ELSE 'cloudformation' END AS format, {_LEVEL} AS difficulty,
  {_CATS!r}[1 + o_orderkey % 8] AS c1, CASE WHEN o_orderkey % 5 = 0 THEN {_CATS!r}[1 + (o_orderkey + o_orderkey % 2) % 8] END AS c2 FROM orders),
cnt AS (SELECT l_linestatus AS model, l_orderkey AS entry_id, count(*) FILTER (l_returnflag = 'N') AS c FROM lineitem GROUP BY ALL),
mdl AS (SELECT * FROM (VALUES ('F'), ('O')) t(model)),
res AS (SELECT mdl.model, ent.entry_id, {_CONFIGURED} AS n, coalesce(cnt.c, 0) AS c, ent.format, ent.difficulty, ent.c1, ent.c2
  FROM ent CROSS JOIN mdl LEFT JOIN cnt ON cnt.entry_id = ent.entry_id AND cnt.model = mdl.model),
sc AS (SELECT *, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE 1 - (n - c)::DOUBLE / n END AS p1,
  CASE WHEN n < 3 THEN (c > 0)::INT::DOUBLE WHEN c = 0 THEN 0 WHEN n - c < 3 THEN 1 ELSE 1 - ((n - c) * (n - c - 1) * (n - c - 2))::DOUBLE / (n * (n - 1) * (n - 2)) END AS p3 FROM res),
lng AS (SELECT *, unnest([1, 3]) AS k, unnest([p1, p3]) AS p FROM sc)"""
_OVERALL = "SELECT model, 'overall' AS dimension, 'all' AS value, k::BIGINT AS k, round(avg(p), 9) AS pass_at_k FROM lng GROUP BY ALL"
_DIFF = "SELECT model, 'difficulty' AS dimension, difficulty AS value, k::BIGINT AS k, round(avg(p), 9) AS pass_at_k FROM lng GROUP BY ALL"
_FMT = "SELECT model, 'format' AS dimension, format AS value, k::BIGINT AS k, round(avg(p), 9) AS pass_at_k FROM lng GROUP BY ALL"
_CAT = """SELECT model, 'category' AS dimension, value, k::BIGINT AS k, round(avg(p), 9) AS pass_at_k
FROM (SELECT model, c1 AS value, k, p FROM lng UNION ALL SELECT model, c2, k, p FROM lng WHERE c2 IS NOT NULL AND c2 <> c1) GROUP BY ALL"""


def _rounded(rows: DataFrame) -> DataFrame:
    return longs(rows.withColumn("pass_at_k", F.round("pass_at_k", 9)), "k")


@query(
    "attempt_verdict",
    f"""SELECT c.conv_id, c.turn, length(trim(c.text, {WHITESPACE_SQL})) > 0 AND c.turn % 3 <> 0 AND coalesce(CASE WHEN c.conv_id % 2 = 0 THEN l.quality = 1 ELSE l.quality = 1 AND l.toxic = 0 END, false) AS passed
FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id""",
)
def attempt_verdict(spark, sf_dir):
    """A response passes if its verdict says so; blank responses and missing verdicts fail."""
    none = F.array().cast("array<string>")
    verdicts = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("valid"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none).alias("errors"),
    )
    fmt = F.when(F.col("conv_id") % 2 == 0, "terraform").otherwise("cloudformation")
    response = F.when(F.col("turn") % 3 == 0, " \n").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").join(verdicts, "conv_id", "left")
    return rows.select(
        "conv_id", "turn", validation.attempt_verdict(response, fmt, F.col("valid"), F.col("errors")).alias("passed")
    )


@query(
    "entry_counts",
    f"""WITH {_RES}, m AS (SELECT * FROM (VALUES ('F'), ('O'), ('X')) t(model))
SELECT m.model, e.entry_id, 5::BIGINT AS n, coalesce(c.c, 0)::BIGINT AS c FROM ent e CROSS JOIN m LEFT JOIN cnt c ON c.model = m.model AND c.entry_id = e.entry_id""",
)
def entry_counts(spark, sf_dir):
    rows = ev.entry_counts(_entries(spark, sf_dir), _attempts(spark, sf_dir), ["F", "O", "X"], 5)
    return longs(rows.select("model", "entry_id", "n", "c"), "n", "c")


@query("pass_at_k", f"WITH {_RES} SELECT model, entry_id, round(p1, 9) AS p1, round(p3, 9) AS p3 FROM sc")
def pass_at_k(spark, sf_dir):
    p = lambda k: F.round(ev.pass_at_k(F.col("n"), F.col("c"), k), 9).alias(f"p{k}")
    return _results(spark, sf_dir).select("model", "entry_id", p(1), p(3))


def _dimension(name: str):
    return lambda spark, sf_dir: _rounded(_breakdown(spark, sf_dir).filter(F.col("dimension") == name))


query("pass_overall", f"WITH {_RES} {_OVERALL}")(_dimension("overall"))
query("pass_by_category", f"WITH {_RES} {_CAT}")(_dimension("category"))
query("pass_by_difficulty", f"WITH {_RES} {_DIFF}")(_dimension("difficulty"))
query("pass_by_format", f"WITH {_RES} {_FMT}")(_dimension("format"))


@query(
    "report_rows",
    f"""WITH {_RES}, b AS ({_OVERALL} UNION ALL {_CAT} UNION ALL {_DIFF})
SELECT model, row_number() OVER (PARTITION BY model ORDER BY list_position(['overall', 'category', 'difficulty'], dimension), value, k)::BIGINT AS pos,
 CASE WHEN dimension = 'overall' THEN '' ELSE value || ' ' END || 'pass@' || k AS metric, printf('%.3f', pass_at_k) AS shown FROM b""",
)
def report_rows(spark, sf_dir):
    breakdown = _breakdown(spark, sf_dir).withColumn("pass_at_k", F.round("pass_at_k", 9))
    return longs(ev.report_rows(breakdown), "pos")


@query(
    "model_comparison",
    f"""WITH {_RES}, o AS ({_OVERALL}) SELECT model, max(pass_at_k) FILTER (k = 1) AS pass_1, max(pass_at_k) FILTER (k = 3) AS pass_3 FROM o GROUP BY model""",
)
def model_comparison(spark, sf_dir):
    wide = ev.model_comparison(_breakdown(spark, sf_dir))
    return wide.select("model", F.round("pass_1", 9).alias("pass_1"), F.round("pass_3", 9).alias("pass_3"))


@query(
    "report_sink",
    f"""WITH {_RES}, o AS ({_OVERALL}), d AS ({_DIFF}), c AS ({_CAT}) SELECT 'lab/m:' || model AS model, 'lab_m_' || model || '.json' AS file,
 (SELECT count(DISTINCT entry_id) FROM res r WHERE r.model = o.model) AS total_entries, pass_at_k AS pass_1,
 (SELECT pass_at_k FROM d WHERE d.model = o.model AND d.value = 'low' AND d.k = 3) AS low_3, (SELECT pass_at_k FROM c WHERE c.model = o.model AND c.value = 'SECURITY' AND c.k = 1) AS security_1 FROM o WHERE k = 1""",
)
def report_sink(spark, sf_dir):
    """Report documents, read back by path to check what is inside."""
    results = _results(spark, sf_dir).withColumn("model", F.concat(F.lit("lab/m:"), "model"))
    totals = results.groupBy("model").agg(F.max("n").alias("n_attempts"), F.count("*").alias("total_entries"))
    path = corpus.new_path(spark)
    written = ev.report_documents(ev.pass_breakdown(results), totals)
    ev.report_sink(written, path)
    docs = spark.read.text(path).select("file", F.col("value").alias("document"), F.get_json_object("value", "$.model_name").alias("model"))
    score = lambda path: F.round(F.get_json_object("document", path).cast("double"), 9)
    return docs.select(
        "model", "file", F.get_json_object("document", "$.total_entries").cast("bigint").alias("total_entries"),
        score("$.pass_at_k.1").alias("pass_1"), score("$.per_difficulty.low.3").alias("low_3"),
        score("$.per_category.SECURITY.1").alias("security_1"),
    )


@query("smoke_gate", f"WITH {_RES}, o AS ({_OVERALL}) SELECT model, pass_at_k, pass_at_k > 0.5 AS proceed FROM o WHERE k = 1")
def smoke_gate(spark, sf_dir):
    return ev.smoke_gate(_breakdown(spark, sf_dir)).withColumn("pass_at_k", F.round("pass_at_k", 9))


# ---- 2.11 / 2.12 responses, prompts, chats

_REPLY = """CASE (conv_id + turn) % 4 WHEN 0 THEN concat('```hcl', chr(10), text, chr(10), '```') WHEN 1 THEN concat(text, '<|im_end|>', 'rest') WHEN 2 THEN concat('  ', text, '<|end|>x<|im_end|>') ELSE concat('```', chr(10), text, '<|endoftext|>', '```') END"""


@query(
    "response_clean",
    f"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace({_REPLY}, '(?s)<\\|(im_end|endoftext|end)\\|>.*$', ''), {WHITESPACE_SQL}) AS r FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(r, '^```[^\n]*(\n|$)', ''), '(^|\n)[ \t]*```[ \t]*$', '')) AS clean_hash FROM c""",
)
def response_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(ev.response_clean(F.expr(_REPLY))).alias("clean_hash")
    )


_CHAT = """conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'terraform' WHEN 1 THEN 'cloudformation' ELSE NULL END AS format, conv_id % 3 AS e, turn % 2 AS w"""
_ERRS = "CASE e WHEN 0 THEN [] WHEN 1 THEN ['bad thing ' || turn] ELSE ['first', 'second'] END"
_WARN = "CASE w WHEN 0 THEN [] ELSE ['careful ' || conv_id] END"


def _chats(spark, sf_dir) -> DataFrame:
    none = F.array().cast("array<string>")
    e, w, t = F.col("conv_id") % 3, F.col("turn") % 2, F.col("turn") % 3
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text",
        F.when(t == 0, "terraform").when(t == 1, "cloudformation").alias("format"),
        F.when(e == 0, none).when(e == 1, F.array(F.concat(F.lit("bad thing "), "turn")))
        .otherwise(F.array(F.lit("first"), F.lit("second"))).alias("errors"),
        F.when(w == 0, none).otherwise(F.array(F.concat(F.lit("careful "), "conv_id"))).alias("warnings"),
    )


def _sql_fill(template: str, *values: str) -> str:
    pieces = template.split("%s")
    out = [quote(pieces[0])]
    for v, p in zip(values, pieces[1:]):
        out += [v, quote(p)]
    return " || ".join(out)


_USER = f"""concat_ws(chr(10) || chr(10), CASE WHEN len(errs) > 0 THEN 'Errors:' || chr(10) || array_to_string(list_transform(errs, lambda x: '- ' || x), chr(10)) END,
 CASE WHEN len(warns) > 0 THEN 'Warnings:' || chr(10) || array_to_string(list_transform(warns, lambda x: '- ' || x), chr(10)) END,
 'Broken config:' || chr(10) || '```' || CASE WHEN coalesce(format, 'terraform') = 'terraform' THEN 'hcl' ELSE 'yaml' END || chr(10) || text || chr(10) || '```')"""
_CHATS = f"ch AS (SELECT *, {_ERRS} AS errs, {_WARN} AS warns FROM (SELECT {_CHAT} FROM conversations))"


@query(
    "chat_record",
    f"""WITH {_CHATS}, m AS (SELECT conv_id, turn, {_USER} AS u, text FROM ch)
SELECT conv_id, turn, 0::BIGINT AS pos, 'system' AS role, {quote(export.SYSTEM_PROMPT)} AS content FROM m
UNION ALL SELECT conv_id, turn, 1, 'user', u FROM m UNION ALL SELECT conv_id, turn, 2, 'assistant', text || ' done' FROM m""",
)
def chat_record(spark, sf_dir):
    chat = export.chat_record(F.col("errors"), F.col("warnings"), F.col("format"), F.col("text"), F.concat("text", F.lit(" done")))
    rows = _chats(spark, sf_dir).select("conv_id", "turn", F.posexplode(chat).alias("pos", "m"))
    return rows.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@query(
    "chat_split_sink",
    """WITH s AS (SELECT CASE conv_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM conversations)
SELECT CASE WHEN split = 'val' THEN 'valid' ELSE split END AS split, count(*) AS chats, 3 * count(*)::BIGINT AS messages FROM s GROUP BY 1""",
)
def chat_split_sink(spark, sf_dir):
    chat = export.chat_record(F.col("errors"), F.col("warnings"), F.col("format"), F.col("text"), F.concat("text", F.lit(" done")))
    five = F.col("conv_id") % 5
    split = F.when(five == 0, "val").when(five == 1, "test").otherwise("train")
    path = corpus.new_path(spark)
    corpus.chat_split_sink(_chats(spark, sf_dir).select(export.chat_split(split).alias("split"), chat.alias("messages")), path)
    rows = corpus.record_scan(spark, path, "messages array<struct<role: string, content: string>>, split string")
    return rows.groupBy("split").agg(F.count("*").alias("chats"), F.sum(F.size("messages")).alias("messages"))


@query(
    "repair_prompt",
    f"""WITH {_CHATS} SELECT conv_id, turn, md5({_sql_fill(export.REPAIR_PROMPT, "CASE WHEN len(errs) = 0 THEN 'Unknown error' ELSE array_to_string(errs, chr(10)) END", "text")}) AS prompt_hash FROM ch""",
)
def repair_prompt(spark, sf_dir):
    prompt = export.repair_prompt(F.col("text"), F.col("errors"))
    return _chats(spark, sf_dir).select("conv_id", "turn", F.md5(prompt).alias("prompt_hash"))


@query(
    "discuss_prompt",
    f"""WITH {_CHATS}, a AS (SELECT *, list_concat(errs, warns) AS both_ FROM ch WHERE NOT (len(errs) = 0 AND len(warns) = 0) OR turn % 5 = 0)
SELECT conv_id, turn, md5({_sql_fill(export.DISCUSS_PROMPT, "CASE WHEN len(both_) = 0 THEN 'No validation errors' ELSE array_to_string(both_, chr(10)) END", "text")}) AS prompt_hash FROM a""",
)
def discuss_prompt(spark, sf_dir):
    valid = (F.size("errors") == 0) & (F.col("turn") % 5 != 0)
    rows = _chats(spark, sf_dir).filter(export.needs_discussion(valid, F.col("warnings")))
    prompt = export.discuss_prompt(F.col("text"), F.col("errors"), F.col("warnings"))
    return rows.select("conv_id", "turn", F.md5(prompt).alias("prompt_hash"))


@query(
    "inject_prompt",
    f"""WITH {HCL} SELECT doc_id, md5({_sql_fill(export.INJECT_PROMPT, "'terraform'", f"{_CATS!r}[1 + doc_id % 8]", f"lower({_CATS!r}[1 + doc_id % 8])", "text")}) AS prompt_hash FROM hcl""",
)
def inject_prompt(spark, sf_dir):
    category = F.get(F.array(*[F.lit(c) for c in _CATS]), (F.col("doc_id") % 8).cast("int"))
    prompt = export.inject_prompt(F.col("text"), category, F.col("format"))
    return hcl_configs(spark, sf_dir).select("doc_id", F.md5(prompt).alias("prompt_hash"))


_REPAIRED = "CASE (conv_id + turn) % 5 WHEN 0 THEN text WHEN 1 THEN concat('  ', text, chr(10)) WHEN 2 THEN '' ELSE concat(text, ' fixed') END"


@query(
    "repair_outcome",
    f"""WITH r AS (SELECT c.conv_id, c.turn, c.text, {_REPAIRED} AS repaired, l.quality FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id)
SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'PASS' WHEN coalesce(repaired, '') = '' OR trim(repaired, {WHITESPACE_SQL}) = trim(text, {WHITESPACE_SQL}) THEN 'NO_CHANGE' WHEN quality = 1 THEN 'FIXED' ELSE 'UNVERIFIED' END AS outcome FROM r""",
)
def repair_outcome(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("verified"))
    rows = table(spark, sf_dir, "conversations").join(verdicts, "conv_id", "left")
    outcome = export.repair_outcome(F.col("turn") % 4 == 3, F.col("text"), F.expr(_REPAIRED), F.col("verified"))
    return rows.select("conv_id", "turn", outcome.alias("outcome"))


@query(
    "repair_summary",
    f"""WITH {_CHATS}, r AS (SELECT ch.*, {_REPAIRED} AS repaired, l.quality, l.toxic FROM ch LEFT JOIN labels l ON ch.conv_id = l.doc_id)
SELECT conv_id, turn, md5(CASE WHEN len(errs) = 0 THEN text ELSE repaired END) AS repaired_hash, len(errs)::BIGINT AS original_errors, CASE WHEN len(errs) = 0 THEN true ELSE coalesce(quality = 1, false) END AS verified,
 CASE WHEN len(errs) = 0 THEN 0 WHEN quality IS NULL THEN -1 ELSE toxic END::BIGINT AS remaining_errors FROM r""",
)
def repair_summary(spark, sf_dir):
    none = F.array().cast("array<string>")
    verdicts = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("conv_id"), (F.col("quality") == 1).alias("valid"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none).alias("left"),
    )
    rows = _chats(spark, sf_dir).join(verdicts, "conv_id", "left")
    summary = export.repair_summary(
        F.col("text"), F.col("errors"), F.expr(_REPAIRED), F.col("valid"), F.col("left")
    )
    flat = rows.select("conv_id", "turn", summary.alias("s"))
    return longs(
        flat.select(
            "conv_id", "turn", F.md5("s.repaired").alias("repaired_hash"), "s.original_errors", "s.verified", "s.remaining_errors"
        ),
        "original_errors", "remaining_errors",
    )
