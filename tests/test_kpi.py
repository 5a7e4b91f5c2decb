import pytest
import datetime as dt

from pyspark.sql import functions as F

from kpispark import schema as S
from kpispark.sources.testtables import sales_fact
from kpispark.operators import kpi
from tests.fixtures import sales_fixture


def _daily(spark, rows):
    df = spark.createDataFrame(rows, "seg string, d date, s double, c double, v double, m double, p int, h int")
    return kpi.daily_kpis(df, keys=["seg"], date="d", sales="s", cogs="c", volume="v", marketing="m",
                          promo="p", holiday="h")


ROWS = [
    ("A", dt.date(2024, 1, 1), 100.0, 40.0, 10.0, 5.0, 1, 1),
    ("A", dt.date(2024, 1, 2), 200.0, 50.0, 20.0, 5.0, 0, 0),
    ("A", dt.date(2024, 1, 3), 300.0, 60.0, 30.0, 0.0, 1, 0),
    ("A", dt.date(2024, 1, 4), -50.0, 10.0, 0.0, 5.0, 0, 2),
]


def test_totals_and_promo_impact(spark):
    d = _daily(spark, ROWS)
    t = kpi.period_totals(d, ["seg"]).collect()[0]
    assert t.total_days == 4 and t.total_sales == 600.0  # negative revenue clamped to 0
    assert t.total_revenue_promotional_events + t.total_revenue_non_promotional == t.total_sales
    assert (t.promo_days_count, t.non_promo_days_count) == (2, 2)
    p = kpi.promo_impact(d, ["seg"]).collect()[0]
    assert p.avg_promo_sales == 200.0 and p.avg_non_promo_sales == 100.0
    assert p.promotional_sales_impact_pct == 100.0


def test_holiday_lift_only_flags_0_1(spark):
    h = kpi.holiday_lift(_daily(spark, ROWS), ["seg"]).collect()[0]
    assert (h.holiday_days_count, h.non_holiday_days_count) == (1, 2)  # flag 2 is in neither group
    assert h.avg_holiday_sales == 100.0 and h.avg_non_holiday_sales == 250.0
    assert h.holiday_sales_lift_pct == -60.0


def test_no_holiday_days_gives_minus_100(spark):
    rows = [r[:-1] + (0,) for r in ROWS]
    h = kpi.holiday_lift(_daily(spark, rows), ["seg"]).collect()[0]
    assert h.avg_holiday_sales == 0.0 and h.holiday_sales_lift_pct == -100.0


def test_attach_holiday_last_wins_and_missing_zero(spark):
    d = _daily(spark, ROWS).drop("holiday_indicator")
    cal = spark.createDataFrame([(dt.date(2024, 1, 2), 0, 1), (dt.date(2024, 1, 2), 1, 2),
                                 (dt.date(2024, 1, 3), 1, 1)], "Date date, Holiday_Indicator int, ord int")
    out = kpi.attach_holiday(d, cal, cal_order="ord")
    flags = {r.date.day: r.holiday_indicator for r in out.collect()}
    assert flags == {1: 0, 2: 1, 3: 1, 4: 0}


def test_summary_averages_ratio_of_sums_vs_unweighted(spark):
    d = _daily(spark, ROWS)
    a = kpi.summary_averages(d, ["seg"]).collect()[0]
    assert a.avg_gross_profit_margin_pct == round((600 - 160) * 100 / 600, 2)
    cards = kpi.basic_cards(d, ["seg"]).collect()[0]
    # unweighted mean of row margins: 60, 75, 80, 0 (zero revenue -> fallback 0)
    assert cards.avg_gross_margin_pct == (60 + 75 + 80 + 0) / 4


def test_performance_days_ties_go_earliest(spark):
    rows = [("A", dt.date(2024, 1, d), s, 10.0, 1.0, 1.0, 0, 0) for d, s in [(1, 50.0), (2, 90.0), (3, 90.0),
                                                                            (4, 20.0), (5, 20.0)]]
    p = kpi.performance_days(_daily(spark, rows), ["seg"]).collect()[0]
    assert p.best_day_sales.date == dt.date(2024, 1, 2)
    assert p.worst_day_sales.date == dt.date(2024, 1, 4)
    assert p.highest_margin_day.date == dt.date(2024, 1, 2)


def test_segment_totals_sum_to_total(spark):
    daily = kpi.daily_kpis(sales_fixture(spark, days=5))
    st = kpi.segment_totals(daily)
    total = daily.agg(F.sum("sales_revenue_eur")).collect()[0][0]
    per_dim = st.groupBy("dimension").agg(F.sum("total_sales").alias("t")).collect()
    assert len(per_dim) == 3
    for r in per_dim:
        assert abs(r.t - total) < 1e-6
    assert st.count() == 4 + 3 + 4


def test_forecast_summary_nested_has_maps_and_days(spark):
    daily = kpi.daily_kpis(sales_fixture(spark, days=10))
    s = kpi.forecast_summary(daily).filter(F.col(S.COUNTRY) == "Spain").limit(1).collect()[0]
    assert s.total_days == 10
    assert list(s.sales_by_country.keys()) == ["Spain"]
    assert abs(s.sales_by_country["Spain"] - s.total_sales_revenue_eur) < 0.011
    assert s.best_day_sales.sales_revenue_eur >= s.worst_day_sales.sales_revenue_eur


def test_kpi_standalone_rejects_negative(spark):
    df = spark.createDataFrame([(100.0, 40.0, 10.0, 5.0), (-1.0, 40.0, 10.0, 5.0)], "s double, c double, v double, m double")
    out = kpi.kpi_standalone(df, "s", "c", "v", "m").collect()
    assert out[0].validation_status == "ok" and out[0].cogs_ratio_pct == 40.0
    assert out[1].validation_status.startswith("rejected") and out[1].gross_profit_eur is None
    assert kpi.kpi_rejects(df, ["s", "c", "v", "m"]).count() == 1


def test_sensitivity_constant_column_is_null(spark):
    f = sales_fixture(spark, days=12).withColumn(S.COMPETITOR, F.lit(1.0))
    r = kpi.sensitivity(f).collect()[0]
    assert r.competitor_sensitivity is None
    assert r.temperature_volume_corr is not None


def test_romi(spark):
    rows = [("A", 100.0, 10.0), ("A", 120.0, 10.0), ("A", 80.0, 0.0), ("A", 60.0, 0.0)]
    df = spark.createDataFrame(rows, "seg string, s double, m double")
    r = kpi.romi(df, ["seg"], "s", "m").collect()[0]
    assert r.incremental_sales == (110.0 - 70.0) * 2
    assert r.romi == 80.0 / 20.0


def test_segment_maps_general_form(spark):
    daily = kpi.daily_kpis(sales_fixture(spark, days=4))
    m = {r.Country: r.sales_by_channel for r in kpi.segment_maps(daily, [S.COUNTRY], [S.CHANNEL]).collect()}
    totals = {r[0]: r[1] for r in daily.groupBy(S.COUNTRY).agg(F.sum("sales_revenue_eur")).collect()}
    assert set(m) == set(totals)
    for country, per_channel in m.items():
        assert len(per_channel) == 3
        assert abs(sum(per_channel.values()) - float(totals[country])) < 0.05


@pytest.mark.parametrize("keys", [[], [S.COUNTRY], [S.COUNTRY, S.CHANNEL], list(S.SEGMENT_KEYS)])
def test_full_summary_in_one_pass(spark, keys):
    """The nested summary equals its parts computed apart, reads the rows once and needs no sorting aggregate."""
    daily = kpi.daily_kpis(sales_fact(spark, "/root/testdata/sf0.001")).persist()
    full = kpi.forecast_summary(daily, keys)
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("InMemoryTableScan") == 1
    rows = [r.asDict() for r in daily.collect()]
    plain = {tuple(r[k] for k in keys): r for r in kpi.forecast_summary(daily, keys, nested=False).collect()}
    for r in full.collect():
        key = tuple(r[k] for k in keys)
        mine = [x for x in rows if tuple(x[k] for k in keys) == key]
        assert all(r[c] == plain[key][c] for c in plain[key].asDict())
        for d in S.SEGMENT_KEYS:
            totals = {}
            for x in mine:
                totals[x[d]] = totals.get(x[d], 0) + x["sales_revenue_eur"]
            assert r[f"sales_by_{d.lower()}"] == pytest.approx({k: float(v) for k, v in totals.items()}, abs=0.006)
        best = min(mine, key=lambda x: (-x["sales_revenue_eur"], x["date"]))
        worst = min(mine, key=lambda x: (x["sales_revenue_eur"], x["date"]))
        margin = min(mine, key=lambda x: (-x["gross_profit_margin_pct"], x["date"]))
        assert (r.best_day_sales.date, r.worst_day_sales.date) == (best["date"], worst["date"])
        assert r.highest_margin_day.date == margin["date"]
        if len([x for x in mine if x["date"] == best["date"] and x["sales_revenue_eur"] == best["sales_revenue_eur"]]) == 1:
            assert r.best_day_sales.gross_profit_eur == float(best["gross_profit_eur"])
    daily.unpersist()
