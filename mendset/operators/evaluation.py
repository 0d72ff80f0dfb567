"""Scoring repair attempts: pass@k and its breakdowns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.functions.text import fence_strip
from mendset.operators.taxonomy import category_of

# Tokens that end a response.
STOPS = r"<\|(?:im_end|endoftext|end)\|>"


def response_clean(response: Column) -> Column:
    """Cut at the earliest stop token, strip, drop the fences."""
    return fence_strip(F.split(response, STOPS, 2)[0])


def entry_counts(entries: DataFrame, attempts: DataFrame, models: list[str], n: int) -> DataFrame:
    """Per model and entry: n as configured and c passes; entries nobody attempted count too."""
    grid = entries.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    passes = attempts.groupBy("model", "entry_id").agg(F.count_if("passed").alias("c"))
    return (
        grid.join(passes, ["model", "entry_id"], "left")
        .withColumn("n", F.lit(n))
        .withColumn("c", F.coalesce("c", F.lit(0)))
    )


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """Per model and entry: n attempt rows and c passes."""
    return attempts.groupBy("model", "entry_id").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("c")
    )


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c,k)/C(n,k) in product form; with fewer than k attempts, whether any passed."""
    factors = [(n - c - j) / F.greatest(n - j, F.lit(1)) for j in range(k)]
    general = F.lit(1.0) - reduce(lambda a, b: a * b, factors, F.lit(1.0))
    return (
        F.when(n < k, F.when(c > 0, 1.0).otherwise(0.0))
        .when(c == 0, 0.0)
        .when(n - c < k, 1.0)
        .otherwise(general)
    )


def pass_breakdown(results: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(model, dimension, value, k, pass_at_k) over all entries and per category, difficulty, format.

    Every entry is expanded to the groups it counts in, once each, and all means come from one
    map-side combined aggregation.
    """
    categories = F.array_distinct(F.transform("fault_types", lambda f: category_of(f)))
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    groups = F.concat(
        F.array(
            pair("overall", F.lit("all")),
            pair("difficulty", F.col("difficulty")),
            pair("format", F.col("format")),
        ),
        F.transform(categories, lambda c: pair("category", c)),
    )
    scores = [pass_at_k(F.col("n"), F.col("c"), k).alias(f"p{k}") for k in ks]
    means = (
        results.select("model", F.explode(groups).alias("g"), *scores)
        .groupBy("model", "g.dimension", "g.value")
        .agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in ks])
    )
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pass_at_k")) for k in ks]))
    return means.select("model", "dimension", "value", long.alias("s")).select(
        "model", "dimension", "value", "s.k", "s.pass_at_k"
    )


def report_rows(breakdown: DataFrame) -> DataFrame:
    """Display rows per model: overall, categories by name, difficulties by name; three decimals.

    A report has a few dozen rows per model whatever the number of entries.
    """
    block = F.expr("array_position(array('overall', 'category', 'difficulty'), dimension)")
    label = F.when(F.col("dimension") == "overall", F.concat(F.lit("pass@"), F.col("k"))).otherwise(
        F.concat(F.col("value"), F.lit(" pass@"), F.col("k"))
    )
    place = F.row_number().over(Window.partitionBy("model").orderBy("block", "value", "k"))
    return (
        breakdown.filter(F.col("dimension") != "format")
        .withColumn("block", block)
        .select(
            "model", place.alias("pos"), label.alias("metric"),
            F.format_string("%.3f", F.col("pass_at_k")).alias("shown"),
        )
    )


def model_comparison(breakdown: DataFrame) -> DataFrame:
    """pass@1 and pass@3 side by side; missing is 0."""
    overall = breakdown.filter(F.col("dimension") == "overall")
    wide = overall.groupBy("model").pivot("k", [1, 3]).agg(F.first("pass_at_k"))
    return wide.select(
        "model", F.coalesce("1", F.lit(0.0)).alias("pass_1"), F.coalesce("3", F.lit(0.0)).alias("pass_3")
    )


def report_documents(breakdown: DataFrame, totals: DataFrame) -> DataFrame:
    """One JSON document per model with its file name; totals are (model, n_attempts, total_entries).

    A breakdown has at most a few dozen rows per model, so collecting them per model is bounded.
    """
    by_k = breakdown.groupBy("model", "dimension", "value").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), "pass_at_k")))
        ).alias("scores")
    )

    def part(dimension: str) -> Column:
        rows = F.collect_list(F.when(F.col("dimension") == dimension, F.struct("value", "scores")))
        return F.map_from_entries(
            F.array_sort(rows, lambda a, b: F.when(a["value"] < b["value"], -1).otherwise(1))
        )

    wide = by_k.groupBy("model").agg(
        F.first(F.when(F.col("dimension") == "overall", F.col("scores")), ignorenulls=True).alias("pass_at_k"),
        part("category").alias("per_category"),
        part("difficulty").alias("per_difficulty"),
        part("format").alias("per_format"),
    )
    name = F.concat(F.translate("model", ":/", "__"), F.lit(".json"))
    return wide.join(totals, "model").select(
        "model",
        name.alias("file"),
        F.to_json(
            F.struct(
                F.col("model").alias("model_name"), "n_attempts", "total_entries",
                "pass_at_k", "per_category", "per_difficulty", "per_format",
            )
        ).alias("document"),
    )


def report_sink(documents: DataFrame, path: str) -> None:
    documents.select("file", F.col("document").alias("value")).write.partitionBy("file").mode(
        "overwrite"
    ).text(path)


def smoke_gate(breakdown: DataFrame, threshold: float = 0.5) -> DataFrame:
    """May the full evaluation go ahead? Overall pass@1 must exceed the threshold."""
    score = breakdown.filter((F.col("dimension") == "overall") & (F.col("k") == 1))
    return score.select("model", "pass_at_k", (F.col("pass_at_k") > threshold).alias("proceed"))
