"""The row-level operators are stateless, so they run unchanged on a stream."""

import tempfile

from kpispark.operators import kpi
from kpispark.sources.testtables import read_sales_fact, write_sales_fact


def test_daily_kpis_on_a_stream_equal_batch(spark):
    with tempfile.TemporaryDirectory() as d:
        write_sales_fact(spark, "/root/testdata/sf0.001", d + "/fact")
        batch = read_sales_fact(spark, d + "/fact")
        stream = spark.readStream.schema(spark.read.parquet(d + "/fact").schema).parquet(d + "/fact")
        rows = kpi.daily_kpis(stream.drop("year"))
        q = (rows.writeStream.format("memory").queryName("kps_stream_kpis").outputMode("append")
                 .option("checkpointLocation", d + "/ckpt").start())
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = spark.table("kps_stream_kpis")
        want = kpi.daily_kpis(batch)
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0
