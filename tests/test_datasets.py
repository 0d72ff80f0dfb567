"""Filters, records, splits, curation, scoring and sinks, against brute force on small inputs."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mendset.operators import curation, evaluation, export, filters, records, synth, validation
from mendset.operators import taxonomy as tax
from mendset.operators.inject import edits_of, inject
from mendset.sources import corpus
from mendset.sources.rendered import configs

# ---- taxonomy


def test_taxonomy(spark):
    faults = tax.fault_dim(spark)
    ids = [r.fault_id for r in faults.orderBy("ord").collect()]
    assert len(ids) == len(set(ids)) == 37
    assert tax.by_format(faults, "terraform").count() == tax.by_format(faults, "opentofu").count() == 19
    assert tax.by_format(faults, "cloudformation").count() == 18
    assert {r.category for r in faults.collect()} == set(tax.CATEGORIES)


def test_registering_an_id_again_replaces_it(spark):
    again = ("SEMANTIC", "invalid_cidr", "high", ["terraform"], "new", [], "new")
    faults = tax.fault_dim(spark, [again])
    row = tax.by_id(faults, "SEMANTIC.invalid_cidr").first()
    assert (row.severity, row.ord, faults.count()) == ("high", 9, 37)


def test_seven_stratified_faults_span_the_categories(spark):
    rows = tax.stratified_faults(tax.fault_dim(spark), 7).filter("format = 'terraform'").orderBy("turn").collect()
    assert [r.category for r in rows] == tax.CATEGORIES[:7]
    everything = tax.stratified_faults(tax.fault_dim(spark), 1000)
    assert everything.filter("format = 'cloudformation'").count() == 18


# ---- filters


def test_first_per_key_keeps_one_of_a_huge_group(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    got = {(r.k, r.seq) for r in filters.first_per_key(rows, ["k"]).filter("k in ('hot', '1', '4999')").collect()}
    assert got == {("hot", 0), ("1", 1), ("4999", 4999)}


def test_dedup_happens_after_the_filter(spark):
    rows = spark.createDataFrame([(0, "s", "bad"), (1, "s", "good"), (2, "s", "good"), (3, "t", "bad")], "seq bigint, sha string, text string")
    assert [r.seq for r in filters.sha_dedup(rows, F.col("text") == "good").collect()] == [1]


@pytest.mark.parametrize("cap", [0, 1, 3, 4, 5, 100])
def test_caps(spark, cap):
    sizes = {1: 3, 2: 1, 3: 4, 5: 2}
    flat = [(q, q * 10 + i) for q, n in sizes.items() for i in range(n)]
    rows = spark.createDataFrame(flat, "q int, seq int")
    want, seen = [], 0
    for q, n in sizes.items():
        want += [x for x in flat if x[0] == q]
        seen += n
        if seen >= cap:
            break
    assert sorted(map(tuple, filters.soft_cap(rows, "q", cap).collect())) == want
    assert sorted(map(tuple, filters.hard_cap(rows, "q", "seq", cap).collect())) == want[:cap]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("AKIA" + "A1" * 8, False), ("akia" + "a1" * 8, False), ("AKIA123", True), ("AWS_SECRET_ACCESS_KEY", False),
        ('password = "12345678"', False), ('password = "1234567"', True), ('password = "1234\n5678"', True),
    ],
)
def test_secrets(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(filters.has_no_secret(F.col("t"))).first()[0] is clean


# ---- records


def make_records(spark, golds, copies):
    rows = [(f"{g}-{i}", records_hash(g), g * copies + i, ["A.x"], "low") for g in range(golds) for i in range(copies)]
    return spark.createDataFrame(rows, "id string, gold_hash string, seq bigint, fault_types array<string>, difficulty string")


def records_hash(g):
    import hashlib

    return hashlib.md5(str(g).encode()).hexdigest()


@pytest.mark.parametrize(
    ("golds", "ratios", "sizes"),
    [(10, (0.8, 0.1, 0.1), (8, 1, 1)), (5, (0.6, 0.2, 0.2), (3, 1, 1)), (1, (0.8, 0.1, 0.1), (0, 0, 1)), (997, (0.8, 0.1, 0.1), (797, 99, 101)), (6, (0.0, 0.5, 0.5), (0, 3, 3))],
)
def test_group_split(spark, golds, ratios, sizes):
    rows = records.group_split(make_records(spark, golds, 3), ratios)
    assert records.leakage_check(rows).count() == 0
    split = {r.gold_hash: r.split for r in rows.collect()}
    ordered = [split[h] for h in sorted(split)]
    assert ordered == ["train"] * sizes[0] + ["val"] * sizes[1] + ["test"] * sizes[2]
    assert {r.split: r.records for r in records.split_counts(rows).collect()} == dict(zip(records.SPLITS, [3 * s for s in sizes]))


def test_no_records_at_all(spark):
    rows = make_records(spark, 1, 1).limit(0)
    assert records.group_split(rows).count() == 0
    assert sum(r.records for r in records.split_counts(records.group_split(rows)).collect()) == 0


def test_record_columns_and_ids(spark, sf):
    docs = configs(spark, sf).filter("doc_id < 60")
    rows = records.to_record(inject(docs, ["SEMANTIC.invalid_cidr"], ["SEMANTIC.cf_bad_ami"]), tax.fault_dim(spark))
    wanted = [c.split()[0] for c in corpus.RECORD_SCHEMA.split(", ")]
    assert rows.columns == [*wanted, "seq"]
    assert rows.select("id").distinct().count() == rows.count() == 60
    assert rows.filter(F.length("gold_hash") != 32).count() == 0


def test_resistant_copies_share_their_fate(spark):
    golds = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "doc_id bigint, text string")
    done = golds.filter("doc_id in (1, 5)").select(F.md5("text").alias("gold_hash"))
    assert records.resistant_golds(golds, done).first()[0] == 2


# ---- curation


def brute_balance(rows, target):
    cats = {}
    for r in rows:
        cats.setdefault(r[1], {}).setdefault(r[2], []).append(r)
    out = []
    if not cats:
        return []
    quota = max(1, target // len(cats))
    for diffs in cats.values():
        for group in diffs.values():
            out += group[: max(1, quota // len(diffs))]
    return out[:target]


@pytest.mark.parametrize("target", [1, 5, 17, 60, 5000])
def test_balanced_select(spark, target):
    rng = random.Random(target)
    rows = [(i, rng.choice("AAAABBC"), rng.choice(["low", "high", "medium"])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, category string, difficulty string").repartition(5)
    got = [(r.seq, r.category, r.difficulty) for r in curation.balanced_select(df, target).collect()]
    assert got == brute_balance(rows, target)


def test_ranking_is_trimmed_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("category"), F.col("lang").alias("difficulty"), "text")
    plan = curation.balanced_select(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 20, Partial" in plan
    # the text is read once, for the chosen rows only, and joined without moving it
    assert plan.count("text") - plan.count("Text") <= 6 and "SortMergeJoin" not in plan


def test_bench_filter_and_dedup(spark):
    ten, nine = "x\n" * 10, "x\n" * 9
    rows = [
        (0, ["A.x"], ["e"], ten, "g"), (1, ["A.y"], ["e"], ten, "g"), (2, ["B.x"], ["e"], ten, "g"), (3, ["A.x"], [], ten, "h"),
        (4, ["A.x", "B.y"], ["e"], ten, "h"), (5, ["A.x"], ["e"], nine, "h"), (6, None, None, None, "h"), (7, ["plain"], ["e"], ten, None),
    ]
    df = spark.createDataFrame(rows, "seq bigint, fault_types array<string>, errors array<string>, broken_config string, gold_hash string")
    kept = curation.bench_dedup(curation.bench_filter(df)).orderBy("seq").collect()
    assert [(r.seq, r.category) for r in kept] == [(0, "A"), (2, "B"), (7, "plain")]


# ---- evaluation


def exact(n, c, k):
    if n < k:
        return float(c > 0)
    if c == 0:
        return 0.0
    return 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_pass_at_k(spark, k):
    grid = [(n, c) for n in range(13) for c in range(n + 1)]
    df = spark.createDataFrame(grid, "n int, c int")
    for r in df.select("n", "c", evaluation.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
        assert r.p == pytest.approx(exact(r.n, r.c, k), abs=1e-12)


def test_breakdown_counts_an_entry_once_per_category(spark):
    rows = [("m", 1, ["A.x", "A.y"], "low", "t", 2, 2), ("m", 2, ["A.x", "B.x"], "low", "t", 2, 0), ("m", 3, ["B.x"], "high", "c", 2, 1)]
    df = spark.createDataFrame(rows, "model string, entry_id int, fault_types array<string>, difficulty string, format string, n int, c int")
    got = {(r.dimension, r.value): r.pass_at_k for r in evaluation.pass_breakdown(df, (1,)).collect()}
    assert got == {
        ("overall", "all"): 0.5, ("category", "A"): 0.5, ("category", "B"): 0.25, ("difficulty", "low"): 0.5,
        ("difficulty", "high"): 0.5, ("format", "t"): 0.5, ("format", "c"): 0.5,
    }


def test_entries_without_attempts_count(spark):
    entries = spark.createDataFrame([(1,), (2,)], "entry_id int")
    attempts = spark.createDataFrame([("m", 1, True), ("m", 1, False), ("m", 1, None)], "model string, entry_id int, passed boolean")
    rows = evaluation.entry_counts(entries, attempts, ["m", "z"], 5).collect()
    assert {(r.model, r.entry_id): (r.n, r.c) for r in rows} == {("m", 1): (5, 1), ("m", 2): (5, 0), ("z", 1): (5, 0), ("z", 2): (5, 0)}


def test_diagnostics(spark):
    raws = [
        json.dumps({"valid": False, "diagnostics": [{"severity": "error", "summary": "a", "detail": "b"}, {"severity": "warning", "summary": "w"}]}),
        json.dumps({"valid": True}), "{oops",
    ]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [tuple(r.v) for r in df.select(validation.diagnostics_parse(F.col("raw")).alias("v")).collect()]
    assert got == [
        (False, ["a: b"], ["w"]), (True, [], []), (False, ["Failed to parse terraform validate output: {oops"], []),
    ]


def test_chat_record(spark):
    df = spark.createDataFrame([(["e1", "e2"], [], "terraform", "b", "g"), ([], ["w"], "cloudformation", "b", "g")], "e array<string>, w array<string>, f string, b string, g string")
    chat = export.chat_record(F.col("e"), F.col("w"), F.col("f"), F.col("b"), F.col("g"))
    users = [r.c[1].content for r in df.select(chat.alias("c")).collect()]
    assert users == ["Errors:\n- e1\n- e2\n\nBroken config:\n```hcl\nb\n```", "Warnings:\n- w\n\nBroken config:\n```yaml\nb\n```"]


# ---- files


def test_corpus_scan(spark, tmp_path):
    body = "x" * 60
    for name, text in {"a.tf": body, "sub/b.yaml": body, "c.json": "short", ".git/d.tf": body, "e.md": body, "sub/.f.tf": body, "g.template": "é" * 30}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = corpus.corpus_scan(spark, str(tmp_path)).collect()
    assert [Path(r.path).name for r in rows] == ["a.tf", "g.template", "b.yaml"]
    assert rows[1].text == "é" * 30


def test_split_sink_keeps_order_and_text(spark, tmp_path):
    rows = records.group_split(make_records(spark, 40, 3)).withColumn("note", F.lit("é漢"))
    corpus.split_sink(rows, str(tmp_path / "out"))
    total = 0
    for split in records.SPLITS:
        files = sorted((tmp_path / "out" / f"split_folder={split}").glob("*.json"))
        lines = [json.loads(x) for f in files for x in f.read_text(encoding="utf-8").splitlines()]
        keys = [(r["gold_hash"], int(r["id"].split("-")[1])) for r in lines]
        assert keys == sorted(keys) and all(r["split"] == split and r["note"] == "é漢" for r in lines)
        total += len(lines)
    assert total == 120


def test_record_scan_ignores_unknown_and_fills_missing(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "surprise": 3, "errors": ["e"]}\n')
    row = corpus.record_scan(spark, str(tmp_path / "r.jsonl")).first()
    assert (row.id, row.errors, row.gold_hash) == ("1", ["e"], None)


def test_landing_last_wins(spark):
    files = [(0, "o/r", "a/b.tf", "terraform", "1"), (1, "o/r", "a\\b.tf", "terraform", "2"), (2, "o/r", "t.json", "cloudformation", "3"), (3, "o/r", "t", "cloudformation", "4")]
    rows = corpus.land(spark.createDataFrame(files, "seq bigint, repo string, path string, format string, content string")).collect()
    assert {(r.key, r.content) for r in rows} == {("o_r__a_b.tf", "2"), ("o_r__t.json", "3"), ("o_r__t.yaml", "4")}


def test_report_and_metadata_files(spark, tmp_path):
    scores = spark.createDataFrame(
        [("a:b/c", "overall", "all", 1, 0.5), ("a:b/c", "category", "A", 1, 0.25)], "model string, dimension string, value string, k int, pass_at_k double"
    )
    totals = spark.createDataFrame([("a:b/c", 5, 2)], "model string, n_attempts int, total_entries int")
    corpus_dir = tmp_path / "reports"
    evaluation.report_sink(evaluation.report_documents(scores, totals), str(corpus_dir))
    (file,) = (corpus_dir / "file=a_b_c.json").glob("*.txt")
    assert json.loads(file.read_text())["per_category"] == {"A": {"1": 0.25}}
    rows = make_records(spark, 4, 2).withColumns({"split": F.lit("train"), "format": F.lit("t"), "source": F.lit("p")})
    records.metadata_sink(rows, str(tmp_path / "meta"))
    (file,) = (tmp_path / "meta").glob("*.txt")
    meta = json.loads(file.read_text())
    assert (meta["total_records"], meta["total_gold_configs"], meta["splits"]["val"]) == (8, 4, 0)


# ---- synthetic corpora


def brute_closure(table, order, count):
    selected, names = [], set()

    def take(name):
        selected.append(name)
        names.add(name)

    for name in order:
        if len(selected) >= count:
            break
        for need in [n for n in table if n in set(table[name]) - names]:
            if need in names:
                continue
            for below in [n for n in table if n in table[need] and n not in names]:
                take(below)
            take(need)
        take(name)
    return [n for n in table if n in names]


@pytest.mark.parametrize("table", [synth.HCL_ARCHETYPES, synth.TEMPLATE_ARCHETYPES])
def test_dependency_closure(spark, table):
    n = F.col("number")
    rows = synth.archetype_pick(spark.range(300).select(F.col("id").alias("number")), table).select(
        "archetypes", synth.archetype_order(table, n, 42).alias("o"), synth.pick_count(n, 42).alias("c")
    )
    for r in rows.collect():
        assert 3 <= r.c <= 7 and r.archetypes == brute_closure(table, r.o, r.c)


# ---- choosing faults


def test_stratified_ids_match_the_table(spark):
    rows = tax.stratified_faults(tax.fault_dim(spark), 8).orderBy("turn").collect()
    for fmt in ("terraform", "opentofu", "cloudformation"):
        assert tax.stratified_ids(fmt, 8) == [r.fault_id for r in rows if r.format == fmt]


def test_rotation_spreads_the_faults(spark, sf):
    docs = configs(spark, sf).filter("format = 'terraform' and doc_id < 1200")
    names = tax.stratified_ids("terraform", 19)
    plain = ["SEMANTIC.invalid_cidr", "SEMANTIC.bad_ami_format", "DEPENDENCY.circular_dependency", "CROSS_RESOURCE.wrong_az_reference"]
    per_doc = edits_of(docs, "hcl", plain, variants=2).groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("fault_id").alias("f"))
    rows = per_doc.collect()
    assert {r.n for r in rows} == {2} and {f for r in rows for f in r.f} == set(plain) and len(names) == 19


def test_line_changes_stay_in_the_row(spark):
    from collections import Counter
    from random import Random

    from mendset.operators import gates

    draw = Random(8)
    text = lambda: draw.choice([None, "", "\n"] + ["\n".join(draw.choices(["a", "b", "é", "", "a "], k=draw.randrange(12))) for _ in range(9)])
    rows = [(i, text(), text()) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, g string, b string")
    changes = gates.line_changes(df, "k", "g", "b")
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
    want = {}
    for k, g, b in rows:
        if g is not None and b is not None and g + b:
            x, y = Counter(g.splitlines()), Counter(b.splitlines())
            want[k] = ((y - x).total(), (x - y).total())
    assert {r.k: (r.added, r.removed) for r in changes.collect()} == want


def test_metadata_is_one_scan(spark):
    from mendset.operators import records

    rows = [("h1", ["A.x", "B.y"], "terraform", None, "low", "train"), ("h1", None, None, "agentic", "low", "train"), ("h2", [], "terraform", "agentic", "high", "other")]
    df = spark.createDataFrame(rows, "gold_hash string, fault_types array<string>, format string, source string, difficulty string, split string")
    made = records.metadata(df)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    r = made.first()
    assert (r.total_records, r.total_gold_configs, r.splits) == (3, 2, {"train": 2, "val": 0, "test": 0})
    assert r.fault_type_distribution == {"A.x": 1, "B.y": 1} and r.format_distribution == {"terraform": 2} and r.source_distribution == {"agentic": 2}
    empty = records.metadata(df.limit(0)).first()
    assert (empty.total_records, empty.total_gold_configs, empty.difficulty_distribution) == (0, 0, {})


def test_write_files(spark, tmp_path):
    files = [("a/x.tf", b"x" * 60), ("a/b/y.yaml", b"\xff" * 60), (".h/z.tf", b"z" * 60)]
    corpus.write_files(spark.createDataFrame(files, "path string, content binary"), f"file://{tmp_path}/tree")
    assert [(r.path.rsplit("tree/", 1)[1], r.length) for r in corpus.corpus_scan(spark, f"{tmp_path}/tree").collect()] == [("a/x.tf", 60)]
    corpus.write_files(spark.createDataFrame([], "path string, content binary"), f"{tmp_path}/none")
    assert corpus.corpus_scan(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        corpus.write_files(spark.createDataFrame(files, "path string, content binary"), "hdfs://host/tree")
