"""The original's deterministic row-count facts, on a Spark-built
fixture of the same shape: 1,827 days x 48 segments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpispark import schema as S
from kpispark.operators import features, metrics, models
from tests.fixtures import CHANNELS, COUNTRIES, PRODUCTS


@pytest.fixture(scope="module")
def sales(spark):
    segs = spark.createDataFrame([(c, ch, p) for c in COUNTRIES for ch in CHANNELS for p in PRODUCTS],
                                 [S.COUNTRY, S.CHANNEL, S.PRODUCT])
    days = spark.range(1).select(F.explode(F.sequence(F.lit(dt.date(2020, 1, 1)),
                                                      F.lit(dt.date(2024, 12, 31)))).alias(S.DATE))
    h = F.abs(F.xxhash64(S.COUNTRY, S.CHANNEL, S.PRODUCT)) % 1000
    d = F.dayofyear(S.DATE)
    df = days.crossJoin(segs).select(
        S.DATE, S.COUNTRY, S.CHANNEL, S.PRODUCT,
        (F.lit(1000.0) + h + d).alias(S.VOLUME), (F.lit(5000.0) + h * 3 + d * 2).alias(S.REVENUE),
        (F.lit(2000.0) + h + d).alias(S.COGS), (F.lit(100.0) + d % 7).alias(S.MARKETING),
        F.when((F.dayofmonth(S.DATE) % 7 == 0) | (F.dayofmonth(S.DATE) % 15 == 0), 1).otherwise(0).alias(S.PROMO),
        F.lit(100.0).alias(S.CONFIDENCE), F.lit(2.0).alias(S.INFLATION), (d % 30).cast("double").alias(S.TEMPERATURE),
        F.lit(0).alias(S.HOLIDAY), F.lit(0.8).alias(S.COMPETITOR))
    return df.cache()


def test_sales_rows(sales):
    assert sales.count() == 87_696


def test_after_lag1_dropna_and_split(sales):
    frame = models.domain_feature_frame(sales)
    assert frame.count() == 87_648
    train, test = features.date_split(frame, "2024-01-01")
    assert (train.count(), test.count()) == (70_080, 17_568)


def test_rows_per_rolling_window(sales):
    sc = metrics.naive_scored(sales)
    w = metrics.rolling_metrics(sc, 30, 5).filter("target = 'sales'").collect()
    assert sorted(r.n for r in w) == [1_440] * 5


def test_segment_span_is_181_days(sales):
    s = metrics.segment_metrics(metrics.naive_scored(sales)).filter(
        "target = 'sales' AND segment_type = 'Country'").collect()
    assert len(s) == 4 and all(r.n == 181 * 12 for r in s)


def test_lag30_rows_of_generic_prepare(sales):
    prep = models.prepare_data(sales.select(S.DATE, S.COUNTRY, S.CHANNEL, S.PRODUCT, S.REVENUE, S.MARKETING))
    assert prep.data.count() == 87_696 - 48 * 30


def test_min_rows_boundaries(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=i), "A", "x", "y", "t", 10.0 + i, 9.0 + i) for i in range(20)]
    rows += [(base + dt.timedelta(days=i), "B", "x", "y", "t", 10.0 + i, 9.0 + i) for i in range(19)]
    sc = spark.createDataFrame(rows, S.SCORED_SCHEMA)
    seg = {r.segment_value for r in metrics.segment_metrics(sc, ["Country"]).collect()}
    assert seg == {"A"}                                  # 20 rows kept, 19 skipped
    # windows of 5 days over 2 series: 10 rows kept; with one series the 9/5-row windows go
    one = sc.filter("Country = 'A'").filter(F.col("date") != base + dt.timedelta(days=19))
    w = metrics.rolling_metrics(one, window_days=10, n_windows=1, min_rows=10).collect()
    assert [r.n for r in w] == [10]
    w9 = metrics.rolling_metrics(one.filter(F.col("date") != base + dt.timedelta(days=12)),
                                 window_days=10, n_windows=1, min_rows=10).collect()
    assert w9 == []
