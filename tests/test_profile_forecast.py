import datetime as dt

from kpispark import schema as S
from kpispark.operators import forecast, profile
from tests.fixtures import demo_ecommerce, sales_fixture


def test_profile_ecommerce_demo(spark):
    p = profile.profile(demo_ecommerce(spark, days=5))
    assert p.date == "date"
    assert p.categorical == ["product_category", "region"]
    assert p.default_targets() == ["daily_sales", "avg_order_value"]


def test_profile_restaurant_and_stock_targets(spark):
    rest = spark.createDataFrame([(dt.date(2024, 1, 1), "cafe", "city", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
                                 "date date, restaurant_type string, location string, daily_revenue double, "
                                 "customer_count double, avg_check_size double, staff_cost double, "
                                 "food_cost double, weather_score double")
    assert profile.profile(rest).default_targets() == ["daily_revenue", "staff_cost", "food_cost"]
    stock = spark.createDataFrame([(dt.date(2024, 1, 1), "X", 1.0, 1.0, 1.0, 1.0, 9.0, 1.0, 1.0, 1.0)],
                                  "date date, symbol string, opening_price double, closing_price double, "
                                  "high_price double, low_price double, volume double, market_cap double, "
                                  "pe_ratio double, volatility double")
    assert profile.profile(stock).default_targets() == ["volume"]


def test_profile_name_with_date_is_date_even_if_numeric(spark):
    df = spark.createDataFrame([("2024-01-01", 3, 1.0)], "day string, update_count int, sales_amount double")
    p = profile.profile(df)
    # 'day' parses as dates, 'update_count' contains "date": both are hits and
    # the last one wins (Q12); neither stays a feature
    assert p.date_hits == ["day", "update_count"] and p.date == "update_count"
    assert profile.profile(df, date_override="day").date == "day"
    assert p.numerical == ["sales_amount"]


def test_describe_and_fill_missing(spark):
    f = sales_fixture(spark, days=3)
    d = {r.column_name: r for r in profile.describe(f, [S.REVENUE, S.VOLUME]).collect()}
    assert d[S.VOLUME]["count"] == 144 and d[S.VOLUME]["min"] <= d[S.VOLUME]["p50"] <= d[S.VOLUME]["max"]
    filled = profile.fill_missing_features(f.select(S.DATE), ["x_lag1", "Avg_Temp", "Inflation_Rate", "other"],
                                           ["region"]).collect()[0]
    assert (filled.x_lag1, filled.Avg_Temp, filled.Inflation_Rate, filled.other, filled.region) == (
        1000.0, 20.0, 1.0, 0.0, "default")


def test_scaffold_grid_and_defaults(spark):
    hist = sales_fixture(spark, days=3)
    targets = ["Net_Sales_Revenue_EUR"]
    num = ["Marketing_Spend_EUR", "Avg_Temp_C", "Inflation_Rate_EUR", "net_sales_revenue_eur_lag7", "other_lag1",
           "month", "Holiday_Indicator"]
    out = forecast.future_scaffold(hist, S.DATE, S.SEGMENT_KEYS, num, targets, horizon=7)
    assert out.count() == 7 * 48
    r = out.orderBy(S.DATE).first()
    assert r.Date == dt.date(2023, 12, 4)
    assert (r.Marketing_Spend_EUR, r.Avg_Temp_C, r.Inflation_Rate_EUR) == (1000.0, 20.0, 1.0)
    assert r.net_sales_revenue_eur_lag7 == 1000.0 and r.other_lag1 == 100.0 and r.Holiday_Indicator == 0.0
    single = forecast.future_scaffold(hist, S.DATE, S.SEGMENT_KEYS, num, targets, horizon=5, per_segment=False)
    assert single.count() == 5 and single.first().Country == "default"


def test_dataset_info_distinct_and_coercion(spark):
    df = demo_ecommerce(spark, days=3)
    info = profile.dataset_info(df)
    assert info["rows"] == 36 and info["date"] == "date" and len(info["sample"]) == 3
    assert profile.distinct_below(df, "region")
    assert not profile.distinct_below(df, "customer_visits", limit=2)
    raw = spark.createDataFrame([("1.5",), ("abc",), (None,)], "x string")
    assert [r.x for r in profile.coerce_numeric(raw, ["x", "missing"]).collect()] == [1.5, None, None]


def test_scenario_grid_rows_per_scenario_day(spark):
    sc = spark.createDataFrame([("Germany", "Off-Trade", "Beer", dt.date(2025, 1, 1), dt.date(2025, 1, 30)),
                                ("Spain", "On-Trade", "Wine", dt.date(2025, 2, 1), dt.date(2025, 2, 7))],
                               "Country string, Channel string, Product_Category string, start_date date, "
                               "end_date date")
    g = forecast.scenario_grid(sc)
    counts = {r.Country: r["count"] for r in g.groupBy("Country").count().collect()}
    assert counts == {"Germany": 30, "Spain": 7}


def test_date_probe_reads_every_value(spark):
    days = [f"2024-01-{i % 28 + 1:02d}" for i in range(150)]
    late = spark.createDataFrame([(d,) for d in days + ["free text"] * 850], "c string")
    assert profile.profile(late).categorical == ["c"]
    nulls = spark.createDataFrame([(None,)] * 150 + [(d,) for d in days], "c string")
    assert profile.profile(nulls).date == "c"
    assert profile.profile(spark.createDataFrame([(None,)], "c string")).categorical == ["c"]


def test_quartiles_interpolate_like_a_sorted_array(spark):
    import numpy as np
    x = np.random.default_rng(3).normal(size=101)
    df = spark.createDataFrame([(float(v), None if i % 10 == 0 else float(i)) for i, v in enumerate(x)], "a double, b double")
    got = {r.column_name: r for r in profile.describe(df, ["a", "b"]).collect()}
    b = [i for i in range(101) if i % 10]
    for name, values in (("a", x), ("b", b)):
        assert np.allclose([got[name][c] for c in ("p25", "p50", "p75")], np.percentile(values, [25, 50, 75]))


def test_scaffold_keeps_rows_of_unseen_base_values(spark):
    hist = sales_fixture(spark, days=3)
    out = forecast.future_scaffold(hist, S.DATE, S.SEGMENT_KEYS, [], [], horizon=4, base_values={S.COUNTRY: "Italy"})
    assert out.count() == 4 * 12 and {r[0] for r in out.select(S.COUNTRY).distinct().collect()} == {"Italy"}
    import pytest
    with pytest.raises(ValueError):
        forecast.future_scaffold(hist, S.DATE, S.SEGMENT_KEYS, [], [], horizon=366)


def test_future_rows_lag_sources(spark):
    hist = sales_fixture(spark, days=5)
    rows = forecast.future_rows(hist, 3, "constant").collect()
    assert len(rows) == 3 * 48 and {r[f"{S.REVENUE}_lag1"] for r in rows} == {300000}
    last = {tuple(r[k] for k in S.SEGMENT_KEYS): r[S.REVENUE] for r in hist.filter(hist[S.DATE] == "2023-12-05").collect()}
    for r in forecast.future_rows(hist, 3).collect():
        assert abs(float(r[f"{S.REVENUE}_lag1"]) - last[tuple(r[k] for k in S.SEGMENT_KEYS)]) < 1e-5
