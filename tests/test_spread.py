from pyspark.sql import functions as F

from mendset.sources import rendered


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rendered, "TASK_ROWS", 1000)
    spark.range(20_000).select((F.col("id") % 19_000).alias("k"), F.md5(F.col("id").cast("string")).alias("v")).coalesce(
        1
    ).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scan = spark.read.parquet(f"{tmp_path}/t")
        sizes = lambda d: [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores and max(sizes(scan)) == 20_000
        dealt = rendered.spread(scan)
        assert max(sizes(dealt)) <= 1200
        assert dealt.rdd.getNumPartitions() % cores == 0
        assert dealt.exceptAll(scan).isEmpty() and dealt.count() == 20_000
        assert rendered.spread(scan.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
