import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from kpispark import schema as S
from kpispark.operators import forecast, metrics, models, report
from kpispark.sources import io
from tests.fixtures import demo_ecommerce, sales_fixture, scored_fixture


def test_console_recommendations(spark):
    h = spark.createDataFrame([("sales", 20.0, 0.5, 0.0), ("cogs", 1.0, 0.9, 0.0), ("volume", 1.0, 0.9, 0.0)],
                              "target string, mape double, r2 double, bias_pct double")
    recs = [r.recommendation for r in metrics.recommendations(h, "console").orderBy("rec_no").collect()]
    assert recs == [S.CONSOLE_SALES_MAPE, S.CONSOLE_ANY_R2] + S.CONSOLE_GENERAL


def test_last_rows_is_top_k(spark):
    f = sales_fixture(spark, days=5)
    out = metrics.last_rows(f, 7, [S.DATE, *S.SEGMENT_KEYS]).collect()
    assert len(out) == 7 and all(r.Date == dt.date(2023, 12, 5) for r in out)


def test_candidate_scored_counts(spark):
    c = metrics.candidate_scored(sales_fixture(spark, days=35))
    # lag 30 drops 30 rows per segment; 3 targets x 3 candidates per kept row
    assert c.count() == 48 * 5 * 9
    assert {r.model for r in c.select("model").distinct().collect()} == set(metrics.CANDIDATES)


def test_report_tables(spark):
    sc = metrics.naive_scored(sales_fixture(spark, days=40))
    rep = report.accuracy_report(sc, "2023-12-25", window_days=5, n_windows=3)
    assert set(rep) == {"executive_summary", "holdout", "rolling_windows", "segments",
                        "detailed_predictions", "model_info"}
    assert rep["holdout"].count() == len(metrics.METRICS)
    assert rep["model_info"].count() == 18 + 16
    sections = {r.section for r in rep["executive_summary"].collect()}
    assert {"holdout", "rating", "rolling_average", "recommendation"} <= sections
    with tempfile.TemporaryDirectory() as d:
        io.write_report({"holdout": rep["holdout"]}, d)
        assert spark.read.parquet(os.path.join(d, "holdout")).count() == len(metrics.METRICS)


def test_csv_roundtrip_and_records(spark):
    f = sales_fixture(spark, days=2)
    with tempfile.TemporaryDirectory() as d:
        io.write_csv(f, os.path.join(d, "sales"))
        back = io.read_sales_csv(spark, os.path.join(d, "sales"))
        assert back.count() == f.count() and back.schema == S.SALES_FACT_SCHEMA
        generic = io.read_csv(spark, os.path.join(d, "sales"))
        assert dict(generic.dtypes)["Net_Sales_Revenue_EUR"] == "double"
    rec = io.from_records(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    assert rec.count() == 2
    parsed = io.parse_dates(spark.createDataFrame([("2024-01-05",), ("bad",)], "Date string"))
    assert [r.Date for r in parsed.collect()] == [dt.date(2024, 1, 5), None]


def test_generate_forecast_and_comprehensive(spark):
    df = demo_ecommerce(spark, days=40)
    prep = models.prepare_data(df)
    res = models.train_models(prep, candidates={"gbt": models.candidate_regressors(2)["gbt_d5"]})
    rows, summary = forecast.generate_forecast(df, res.models, prep, horizon=10)
    assert rows.count() == 10 * 12
    s = {r.target: r for r in summary.collect()}
    assert set(s) == set(prep.targets) and s["daily_sales"].start_date == dt.date(2020, 2, 10)
    frame = models.domain_feature_frame(sales_fixture(spark, days=20))
    fitted = models.train_domain_models(frame, "2023-12-15", max_iter=2)
    daily, summ = forecast.comprehensive_forecast(frame.filter(F.col(S.DATE) >= "2023-12-15"), fitted)
    assert summ.count() == 48 and daily.count() == 48 * 6
    assert "best_day_sales" in summ.columns and "sales_by_country" in summ.columns


def test_stacking_and_cv(spark):
    df = demo_ecommerce(spark, days=40)
    prep = models.prepare_data(df, targets=["daily_sales"])
    cands = {"a": models.candidate_regressors(2)["gbt_d5"], "b": models.candidate_regressors(2, 3)["rf"]}
    bases, meta = models.stacking_fit(prep.data, prep, "daily_sales", cands, folds=3)
    out = models.stacking_predict(prep.data.limit(10), bases, meta, "daily_sales")
    assert out.filter(F.col("predicted_daily_sales").isNull()).count() == 0
    cv = models.time_series_cv(prep, "daily_sales", ["2020-02-03", "2020-02-06"], cands["a"]).collect()
    assert [r.fold for r in sorted(cv, key=lambda r: r.fold)] == [1, 2]


def test_scored_fixture_side_by_side(spark):
    m = metrics.accuracy(scored_fixture(spark), ["target", S.COUNTRY])
    wide = report.side_by_side(m, [S.COUNTRY])
    assert "sales_mape" in wide.columns and "cogs_r2" in wide.columns
