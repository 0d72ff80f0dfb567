"""Training records: assembly, leakage-free splits and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendset.operators.inject import trusted_errors

SPLITS = ["train", "val", "test"]


def gold_hash(text: Column) -> Column:
    return F.md5(text)


def to_record(injected: DataFrame, faults: DataFrame, source: str = "programmatic") -> DataFrame:
    """Records from injected rows; the taxonomy (fixed size) is broadcast.

    `seq` keeps the order of generation: config order, then fault order.
    """
    dim = F.broadcast(faults.select("fault_id", "ord", "severity", "example_error"))
    attempt = F.col("attempts") if "attempts" in injected.columns else F.lit(1)
    key = F.concat_ws("|", F.col("doc_id"), gold_hash(F.col("text")), F.col("fault_id"), attempt)
    return injected.join(dim, "fault_id").select(
        F.sha2(key, 256).alias("id"),
        "format",
        F.col("text").alias("gold_config"),
        F.col("broken").alias("broken_config"),
        trusted_errors(F.col("fault_id"), F.col("example_error")).alias("errors"),
        F.array().cast("array<string>").alias("warnings"),
        F.array("fault_id").alias("fault_types"),
        F.col("description").alias("fault_description"),
        F.col("severity").alias("difficulty"),
        F.lit(source).alias("source"),
        F.lit("").alias("split"),
        gold_hash(F.col("text")).alias("gold_hash"),
        (F.col("seq") * 100 + F.col("ord")).alias("seq"),
    )


def split_cuts(records: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """One row: the last train hash, the last val hash and the number of distinct hashes.

    No global sort. Hashes are md5 text, so their first four hex digits spread them evenly over at
    most 65,536 buckets. Bucket counts and a running sum over them tell which bucket holds each
    boundary; only the hashes of those two buckets are ranked.
    """
    distinct = records.select("gold_hash").distinct()
    # the filter is the one the join below implies; said here, both uses share one exchange
    bucketed = distinct.withColumn("bucket", F.substring("gold_hash", 1, 4)).filter(F.col("bucket").isNotNull())
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    # both windows see one row per bucket, at most 65,536
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    places = counts.select(
        "bucket", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(everything).alias("total")
    )
    n_train = (F.col("total") * ratios[0]).cast("bigint")
    n_val = (F.col("total") * ratios[1]).cast("bigint")
    wanted = F.explode(
        F.array(
            F.struct(F.lit("train").alias("cut"), n_train.alias("rank")),
            F.struct(F.lit("val").alias("cut"), (n_train + n_val).alias("rank")),
        )
    )
    edges = (
        places.select("bucket", "n", "upto", "total", wanted.alias("w"))
        .select("bucket", "total", "w.cut", "w.rank", (F.col("upto") - F.col("n")).alias("before"), "upto")
        .filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto")))
    )
    ranked = bucketed.join(F.broadcast(edges), "bucket").withColumn(
        "place",
        F.col("before") + F.row_number().over(Window.partitionBy("cut", "bucket").orderBy("gold_hash")),
    )
    hits = ranked.filter(F.col("place") == F.col("rank"))
    cuts = hits.agg(
        F.max(F.when(F.col("cut") == "train", F.col("gold_hash"))).alias("train_cut"),
        F.max(F.when(F.col("cut") == "val", F.col("gold_hash"))).alias("val_cut"),
    )
    # a split of no hashes has no last hash; the empty string is below every hash
    return cuts.select(
        F.coalesce("train_cut", F.lit("")).alias("train_cut"),
        F.coalesce("val_cut", F.lit("")).alias("val_cut"),
    )


def group_split(records: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Fill `split`: all records of one gold text share it.

    The two boundaries come in as scalar subqueries, so the wide records are not shuffled.
    """
    cuts = split_cuts(records, ratios)
    split = (
        F.when(F.col("gold_hash") <= cuts.select("train_cut").scalar(), "train")
        .when(F.col("gold_hash") <= cuts.select("val_cut").scalar(), "val")
        .otherwise("test")
    )
    return records.withColumn("split", split)


def leakage_check(records: DataFrame) -> DataFrame:
    """Hashes that occur in more than one split; must be empty."""
    return (
        records.groupBy("gold_hash")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def fault_distribution(records: DataFrame) -> DataFrame:
    return (
        records.select(F.explode("fault_types").alias("fault_type"))
        .groupBy("fault_type").agg(F.count("*").alias("records")).orderBy("fault_type")
    )


def distribution(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("records"))


def split_counts(records: DataFrame) -> DataFrame:
    """Records per split, zero included."""
    counts = records.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("records")) for s in SPLITS]))
    return counts.select(pairs.alias("p")).select("p.*")


def na_counts(configs: DataFrame, selected: DataFrame, records: DataFrame) -> DataFrame:
    """Fault -> number of golds of its format on which the selected fault had no target.

    Every (gold, fault) pair yields at most one record, so two counts and a subtraction do what an
    anti join over all pairs would.
    """
    golds = configs.groupBy("format").agg(F.count("*").alias("golds"))
    hit = (
        records.select("format", F.explode("fault_types").alias("fault_id"))
        .groupBy("format", "fault_id").agg(F.count("*").alias("hits"))
    )
    pairs = selected.select("format", "fault_id").join(golds, "format")
    return (
        pairs.join(hit, ["format", "fault_id"], "left")
        .groupBy("fault_id")
        .agg(F.sum(F.col("golds") - F.coalesce("hits", F.lit(0))).alias("not_applicable"))
        .filter(F.col("not_applicable") > 0)
    )


def resistant_golds(configs: DataFrame, records: DataFrame) -> DataFrame:
    """Number of golds without any record; copies of one text share its fate.

    Copies are counted per hash before the join, so a much-copied text is one row in it.
    """
    per_hash = configs.groupBy(gold_hash(F.col("text")).alias("gold_hash")).agg(F.count("*").alias("golds"))
    lost = per_hash.join(records.select("gold_hash").distinct(), "gold_hash", "left_anti")
    return lost.agg(F.coalesce(F.sum("golds"), F.lit(0)).alias("resistant_configs"))


def run_stats(configs: DataFrame, selected: DataFrame, records: DataFrame) -> DataFrame:
    """One row: total_gold, total_broken, resistant_configs, faults_not_applicable, errors."""
    # one row per fault of the taxonomy at most
    missing = na_counts(configs, selected, records).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("fault_id", "not_applicable")))
        ).alias("faults_not_applicable")
    )
    return configs.agg(F.count("*").alias("total_gold")).select(
        "total_gold",
        records.agg(F.count("*")).scalar().alias("total_broken"),
        resistant_golds(configs, records).scalar().alias("resistant_configs"),
        missing.scalar().alias("faults_not_applicable"),
        F.lit(0).cast("bigint").alias("errors"),
    )


def metadata(records: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """One row with the metadata document as columns; `to_json(struct(*))` gives its text.

    One pass: each record yields its values of all dimensions, which are counted together before they are
    shuffled. Records without a format, source or difficulty are not in that distribution.
    """
    named = ["format", "source", "difficulty", "split"]
    value = lambda dimension, v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value"))
    values = F.concat(
        F.array(value("all", F.lit("")), value("gold", F.col("gold_hash")), *[value(c, F.col(c)) for c in named]),
        F.coalesce(F.transform("fault_types", lambda f: value("fault_type", f)), F.array().cast("array<struct<dimension:string,value:string>>")),
    )
    counts = records.select(F.explode(values).alias("v")).filter(F.col("v.value").isNotNull())
    counts = counts.groupBy("v.dimension", "v.value").agg(F.count("*").alias("records"))
    of = lambda dimension: F.col("dimension") == dimension

    def as_map(dimension: str) -> Column:
        # a distribution has one row per fault, format, source, difficulty or split
        entry = F.when(of(dimension), F.struct("value", "records"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    splits = F.map_from_entries(
        F.array(*[F.struct(F.lit(s).alias("split"), F.coalesce(F.sum(F.when(of("split") & (F.col("value") == s), F.col("records"))), F.lit(0).cast("bigint"))) for s in sorted(SPLITS)])
    )
    return counts.agg(
        F.coalesce(F.sum(F.when(of("all"), F.col("records"))), F.lit(0).cast("bigint")).alias("total_records"),
        F.count_if(of("gold")).alias("total_gold_configs"),
        splits.alias("splits"),
        F.array(*[F.lit(r) for r in ratios]).alias("ratios"),
        as_map("fault_type").alias("fault_type_distribution"),
        *[as_map(c).alias(f"{c}_distribution") for c in named[:3]],
    )


def metadata_sink(records: DataFrame, path: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> None:
    document = metadata(records, ratios).select(F.to_json(F.struct("*")).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(path)
