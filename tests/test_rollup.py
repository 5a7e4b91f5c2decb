import datetime as dt

from kpispark.operators import kpi, rollup


def _daily(spark, dates):
    rows = [("A", d, 10.0, 4.0, 2.0, 1.0, 0, 0) for d in dates]
    df = spark.createDataFrame(rows, "seg string, d date, s double, c double, v double, m double, p int, h int")
    return kpi.daily_kpis(df, keys=["seg"], date="d", sales="s", cogs="c", volume="v", marketing="m",
                          promo="p", holiday="h")


def test_weekly_labels_are_sundays_and_monthly_month_end(spark):
    d = _daily(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 7), dt.date(2024, 1, 8), dt.date(2024, 2, 29)])
    w = {r.period_end: r.sales_revenue_eur for r in rollup.rollup(d, "W", ["seg"]).collect()}
    assert w == {dt.date(2024, 1, 7): 20.0, dt.date(2024, 1, 14): 10.0, dt.date(2024, 3, 3): 10.0}
    m = {r.period_end for r in rollup.rollup(d, "M", ["seg"]).collect()}
    assert m == {dt.date(2024, 1, 31), dt.date(2024, 2, 29)}


def test_dense_rollup_fills_empty_periods(spark):
    d = _daily(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 22)])
    out = {r.period_end: r for r in rollup.dense_rollup(d, "W", ["seg"]).collect()}
    assert len(out) == 4
    empty = out[dt.date(2024, 1, 14)]
    assert empty.sales_revenue_eur == 0 and empty.gross_profit_margin_pct is None and empty.days == 0
    months = rollup.dense_rollup(_daily(spark, [dt.date(2024, 1, 5), dt.date(2024, 4, 5)]), "M", ["seg"])
    assert months.count() == 4


def test_sum_all_includes_flags_and_ratios(spark):
    d = _daily(spark, [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    r = rollup.rollup_sum_all(d, "W", ["seg"]).collect()[0]
    assert r.promotional_event == 0 and r.gross_profit_margin_pct == 120.0
