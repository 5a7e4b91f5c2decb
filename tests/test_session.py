from kpispark import session
from kpispark.sources.testtables import read_table


def test_checkpoint_dir_is_read_from_session(spark):
    d = session.ensure_checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d
    assert session.ensure_checkpoint_dir(spark) == d          # stable, never replaced


def test_broadcast_only_below_the_size_check(spark):
    df = spark.range(10)
    assert session.estimated_bytes(df) < 10_000
    small = session.broadcast_if_small(df, limit_bytes=1 << 20)
    big = session.broadcast_if_small(df, limit_bytes=1)
    plan_small = small.join(spark.range(5), "id")._jdf.queryExecution().optimizedPlan().toString()
    plan_big = big.join(spark.range(5), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan_small.lower() and "broadcast" not in plan_big.lower()
    assert session.broadcast_if_small(df, limit_bytes=-1) is df


def test_declared_schema_matches_files(spark):
    li = read_table(spark, "/root/testdata/sf0.001", "lineitem")
    assert li.count() > 0 and dict(li.dtypes)["l_shipdate"] == "timestamp_ntz"


def test_fact_joins_fall_back_to_shuffle_when_over_the_size_check(spark):
    from kpispark.sources.testtables import sales_fact
    sf = "/root/testdata/sf0.001"
    small_plan = sales_fact(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in small_plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = sales_fact(spark, sf)
        plan = big._jdf.queryExecution().executedPlan().toString()
        # orders, customer and part are joined by shuffle; only the fixed-size
        # nation / region code tables stay broadcast
        assert plan.count("SortMergeJoin") == 3
        assert big.count() == sales_fact(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_materialised_fact_roundtrip(spark):
    import tempfile
    from kpispark.operators import kpi
    from kpispark.sources.testtables import read_sales_fact, sales_fact, write_sales_fact
    sf = "/root/testdata/sf0.001"
    with tempfile.TemporaryDirectory() as d:
        write_sales_fact(spark, sf, d + "/fact")
        back = read_sales_fact(spark, d + "/fact")
        live = sales_fact(spark, sf)
        assert back.columns == live.columns
        assert back.exceptAll(live).count() == 0 and live.exceptAll(back).count() == 0
        a = kpi.period_totals(kpi.daily_kpis(back)).exceptAll(kpi.period_totals(kpi.daily_kpis(live)))
        assert a.count() == 0
        raw = spark.read.parquet(d + "/fact")
        plan = raw.filter("year >= 2000")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan


def test_threshold_is_read_as_spark_writes_it(spark):
    from kpispark.sources.testtables import sales_fact
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, size in (("100MB", 100 << 20), ("-1", -1), ("10485760b", 10485760), ("1g", 1 << 30), ("64k", 64 << 10)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert session.broadcast_limit(spark) == size
            assert sales_fact(spark, "/root/testdata/sf0.001").columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_written_copies_can_be_released(spark):
    import os
    df = session.cut_lineage(spark.range(10).toDF("x"))
    path = session._WRITTEN[-1][1]
    assert df.count() == 10 and os.path.isdir(path)
    assert session.release() >= 1 and not os.path.exists(path)
