import datetime as dt
import math

from pyspark.sql import functions as F

from kpispark.functions import calendar as C
from kpispark.functions import exprs as E


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_clamp0_nan_null_negative(spark):
    out = one(spark, E.clamp0("x"), [(5.0,), (-3.0,), (None,), (float("nan"),), (0.0,)], "x double")
    assert out == [5.0, 0.0, 0.0, 0.0, 0.0]


def test_safe_div_negative_denominator_falls_back(spark):
    out = one(spark, E.safe_div("n", "d", 7.0), [(10.0, 4.0), (10.0, 0.0), (10.0, -2.0)], "n double, d double")
    assert out == [2.5, 7.0, 7.0]


def test_cap(spark):
    assert one(spark, E.cap("x"), [(150.0,), (-250.0,), (12.5,)], "x double") == [100.0, -100.0, 12.5]


def test_round_half_up_ties(spark):
    vals = [2.675, 0.125, -2.675, -2.4e-16, 1.005, 44.445, 123456.785, 7.0, -0.006]
    out = one(spark, E.round_half_up("x", 2), [(v,) for v in vals], "x double")
    # floor(x * 100 + 0.5) / 100 in IEEE doubles, the same in every engine
    assert out == [math.floor(v * 100.0 + 0.5) / 100.0 for v in vals]
    assert out[:4] == [2.68, 0.13, -2.67, 0.0] and out[4] == 1.0 and out[-1] == -0.01
    assert math.copysign(1.0, out[3]) == 1.0


def test_business_kpis_hand_computed(spark):
    df = spark.createDataFrame([(1000.0, 400.0, 50.0, 100.0), (0.0, 10.0, 0.0, 0.0),
                                (100.0, 300.0, 10.0, 0.0)], "s double, c double, v double, m double")
    k = E.business_kpis("s", "c", "v", "m")
    rows = df.select(*[c.alias(n) for n, c in k.items()]).collect()
    r = rows[0]
    assert r.gross_profit_eur == 600.0
    assert r.gross_profit_margin_pct == 60.0
    assert r.asp_per_litre_eur == 20.0
    assert r.predicted_operating_cash_flow_eur == 500.0
    assert r.cogs_per_litre == 8.0
    assert r.marketing_spend_ratio == 10.0
    assert r.revenue_per_euro_marketing == 10.0
    assert r.litres_per_euro_marketing == 0.5
    # zero revenue: every ratio falls back to 0
    assert rows[1].gross_profit_margin_pct == 0.0 and rows[1].asp_per_litre_eur == 0.0
    # margin capped at -100
    assert rows[2].gross_profit_margin_pct == -100.0


def test_cogs_ratio(spark):
    assert one(spark, E.cogs_ratio_pct("s", "c"), [(200.0, 50.0)], "s double, c double") == [25.0]


def test_promo_and_holiday_rules(spark):
    days = [(d,) for d in (7, 14, 15, 30, 1, 8)]
    assert one(spark, E.promo_day_rule("d"), days, "d int") == [1, 1, 1, 1, 0, 0]
    dates = [(dt.date(2024, 1, 1),), (dt.date(2024, 4, 2),), (dt.date(2024, 12, 25),), (dt.date(2024, 12, 24),)]
    assert one(spark, E.holiday_rule("d"), dates, "d date") == [1, 1, 1, 0]
    assert one(spark, E.holiday_rule("d", E.HOLIDAYS_RESTAURANT), dates, "d date") == [0, 0, 1, 1]
    assert one(spark, E.holiday_rule("d", E.HOLIDAYS_FORECAST), dates, "d date") == [0, 0, 1, 0]


def test_calendar_monday_zero_and_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),), (dt.date(2021, 1, 1),)], "d date")
    rows = df.select(C.day_of_week("d").alias("dow"), C.iso_week("d").alias("wk")).collect()
    assert [r.dow for r in rows] == [0, 6, 4]
    assert rows[2].wk == 53
    feats = df.select(*[c.alias(n) for n, c in C.full_calendar(F.col("d")).items()]).columns
    assert feats == ["year", "month", "day", "day_of_week", "day_of_year", "week_of_year", "quarter",
                     "month_sin", "month_cos", "day_sin", "day_cos"]


def test_lookup_default_and_seasonal(spark):
    out = one(spark, E.lookup("k", {"Beer": 1.2, "Wine": 1.0}), [("Beer",), ("Cider",)], "k string")
    assert out == [1.2, 1.0]
    s = one(spark, E.seasonal_factor("d"), [(0,)], "d int")
    assert s == [1.0]


def test_within_zero_actual_is_miss(spark):
    out = one(spark, E.within("a", "p", 0.1), [(100.0, 95.0), (100.0, 80.0), (0.0, 0.0)], "a double, p double")
    assert out == [1.0, 0.0, 0.0]


def test_flag_date_and_numeric_helpers(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 3, 5), "2.5"), (0, dt.date(2024, 12, 31), "x")],
                               "f int, d date, s string")
    rows = df.select(E.flag_to_bool("f").alias("b"), E.date_to_iso("d").alias("iso"),
                     E.try_numeric("s").alias("n")).collect()
    assert [(r.b, r.iso, r.n) for r in rows] == [(True, "2024-03-05", 2.5), (False, "2024-12-31", None)]
