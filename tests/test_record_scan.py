from mendset.plans import corpus as plans


def test_long_props_keep_their_values(spark, tmp_path):
    props = '{"pad":"' + "x" * (1 << 20) + '","k":7}'
    spark.createDataFrame([(1, props)], "event_id bigint, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in plans.record_scan(spark, str(tmp_path)).collect()] == [(1, 7, None)]
