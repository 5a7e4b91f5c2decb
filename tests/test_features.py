import datetime as dt

from pyspark.sql import functions as F

from kpispark import schema as S
from kpispark.operators import features
from tests.fixtures import sales_fixture


def test_window_and_positions_lags_agree(spark):
    f = sales_fixture(spark, days=35).select(*S.SEGMENT_KEYS, S.DATE, S.REVENUE, S.VOLUME)
    a = features.lag_features(f, [S.REVENUE, S.VOLUME], S.SEGMENT_KEYS, S.DATE, [1, 7, 30], "window")
    b = features.lag_features(f, [S.REVENUE, S.VOLUME], S.SEGMENT_KEYS, S.DATE, [1, 7, 30], "positions")
    assert a.count() == b.count() == 48 * 35
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_row_counts_after_lag_dropna(spark):
    # the original's row-count facts on a dense fixture: -1 and -30 rows per segment
    f = sales_fixture(spark, days=40)
    lag1 = features.drop_incomplete(features.domain_lags(f))
    assert lag1.count() == 48 * 40 - 48
    lag30 = features.drop_incomplete(features.lag_features(f, [S.REVENUE], S.SEGMENT_KEYS, S.DATE, [30], "window"))
    assert lag30.count() == 48 * 40 - 48 * 30


def test_ungrouped_lag_matches_pandas_shift(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i * i)) for i in range(50)]
    df = spark.createDataFrame(rows, "d date, x double")
    out = features.lag_features(df, ["x"], [], "d", [1, 7], "positions").orderBy("d").collect()
    assert [r.x_lag1 for r in out][:3] == [None, 0.0, 1.0]
    assert out[10].x_lag7 == 9.0


def test_global_positions_hot_key_is_split_and_dense(spark):
    # one key holds most rows: positions stay unique and contiguous
    hot = [("hot", i % 17, float(i)) for i in range(3000)]
    cold = [(f"k{i}", i, float(i)) for i in range(200)]
    df = spark.createDataFrame(hot + cold, "g string, t int, v double")
    pos = features.global_positions(df, ["t"], ["g"], num_partitions=8)
    stats = pos.agg(F.min("_pos"), F.max("_pos"), F.countDistinct("_pos"), F.count("*")).collect()[0]
    assert tuple(stats) == (0, 3199, 3200, 3200)
    # order respects (group, order) - positions of the hot key are contiguous
    hot_pos = pos.filter("g = 'hot'").agg(F.min("_pos"), F.max("_pos")).collect()[0]
    assert hot_pos[1] - hot_pos[0] == 2999


def test_positional_split_counts(spark):
    f = sales_fixture(spark, days=10).select(*S.SEGMENT_KEYS, S.DATE)
    out = features.positional_split(f, [S.DATE], 0.2, S.SEGMENT_KEYS)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": int(480 * 0.8), "test": 480 - int(480 * 0.8)}
    # grouped order: the test rows are the last segments, not the last dates (Q5)
    last = out.filter("split = 'test'").select(S.COUNTRY).distinct().collect()
    assert {r[0] for r in last} == {"United Kingdom"}


def test_date_split_and_report(spark):
    f = sales_fixture(spark, days=40)
    tr, te = features.date_split(f, "2024-01-01")
    assert tr.count() + te.count() == f.count()
    rep = {r.split: r for r in features.split_report(features.label_date_split(f, "2024-01-01")).collect()}
    assert rep["train"].max_date < dt.date(2024, 1, 1) <= rep["test"].min_date


def test_positions_lag_across_small_blocks(spark):
    # 31-row blocks with lags up to 30: most lags cross a block boundary via carry-in rows
    f = sales_fixture(spark, days=35).select(*S.SEGMENT_KEYS, S.DATE, S.REVENUE)
    a = features.lag_features(f, [S.REVENUE], S.SEGMENT_KEYS, S.DATE, [1, 7, 30], "window")
    b = features.lag_features(f, [S.REVENUE], S.SEGMENT_KEYS, S.DATE, [1, 7, 30], "positions", block_rows=31)
    assert b.count() == a.count()
    assert a.exceptAll(b).count() == 0
    u = features.lag_features(f.groupBy(S.DATE).agg(F.sum(S.REVENUE).alias("r")), ["r"], [], S.DATE, [1, 7],
                              "positions", block_rows=8).orderBy(S.DATE).collect()
    assert u[0].r_lag1 is None and u[8].r_lag1 == u[7].r and u[9].r_lag7 == u[2].r


def test_positions_lag_hot_key_spans_many_blocks(spark):
    base = dt.date(2000, 1, 1)
    hot = [("hot", base + dt.timedelta(days=i), float(i)) for i in range(3000)]
    cold = [(f"k{j}", base + dt.timedelta(days=i), float(100 * j + i)) for j in range(40) for i in range(5)]
    df = spark.createDataFrame(hot + cold, "g string, d date, v double")
    a = features.lag_features(df, ["v"], ["g"], "d", [1, 7, 30], "window")
    b = features.lag_features(df, ["v"], ["g"], "d", [1, 7, 30], "positions", block_rows=100)
    assert b.count() == 3200 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
