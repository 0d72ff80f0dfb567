"""The bucketed landing store equals one full landing, and merging moves only the new files."""

import random
import re
import uuid

from mendset.sources import corpus, landing

FILES = "seq long, repo string, path string, format string, content string"


def stores(n):
    return [f"store_{uuid.uuid4().hex}" for _ in range(n)]


def test_runs_merge_without_moving_the_store(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, f"r{draw.randrange(6)}", f"p/{draw.randrange(9)}.tf", draw.choice(["terraform", "cloudformation"]), f"text {i}") for i in range(300)]
    draw.shuffle(rows)
    runs = [spark.createDataFrame(r, FILES) for r in (rows[:120], rows[120:220], rows[220:])]
    a, b = stores(2)
    landing.begin(runs[0], a, 4, str(tmp_path / "a"))
    landing.land_again(spark, a, runs[1], b, str(tmp_path / "b"))
    last = landing.merged(spark, b, runs[2])
    plan = last._jdf.queryExecution().executedPlan().toString()
    stored, new = re.split(r"\n\s+[:+]- ", plan.split("SortMergeJoin", 1)[1].split("FullOuter", 1)[1], maxsplit=2)[1:]
    side = stored.split("LogicalRDD")[0].split("ExistingRDD")[0]
    assert "Bucketed: true" in plan and "Exchange" not in side[: side.index("Bucketed: true")]
    want = corpus.land(spark.createDataFrame(rows, FILES)).select("format", "key", "seq", "content")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert landing.buckets_of(spark, b) == 4


def test_empty_runs(spark, tmp_path):
    none = spark.createDataFrame([], FILES)
    one = spark.createDataFrame([(1, "r", "p.tf", "terraform", None)], FILES)
    a, b = stores(2)
    landing.begin(none, a, 2, str(tmp_path / "a"))
    landing.land_again(spark, a, one, b, str(tmp_path / "b"))
    assert [tuple(r) for r in landing.merged(spark, b, none).collect()] == [("terraform", "r__p.tf", 1, None)]
