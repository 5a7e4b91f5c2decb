import numpy as np

from pyspark.sql import functions as F

from kpispark import schema as S
from kpispark.operators import metrics as M
from tests.fixtures import sales_fixture, scored_fixture


def _np_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    e = y - p
    nz = y != 0
    sst = ((y - y.mean()) ** 2).sum()
    r2 = (1 if (e ** 2).sum() == 0 else 0) if sst == 0 else 1 - (e ** 2).sum() / sst
    return {
        "mae": np.abs(e).mean(), "rmse": np.sqrt((e ** 2).mean()), "r2": r2,
        "mape": np.abs(e[nz] / y[nz]).mean() * 100, "mean_actual": y.mean(), "mean_predicted": p.mean(),
        "std_actual": y.std(), "std_predicted": p.std(), "bias": (p - y).mean(),
        "bias_pct": (p - y).mean() / y.mean() * 100 if y.mean() != 0 else None,
        "within_10_pct": np.mean(np.where(nz, np.abs(e / np.where(nz, y, 1)) <= 0.1, False)) * 100,
        "within_20_pct": np.mean(np.where(nz, np.abs(e / np.where(nz, y, 1)) <= 0.2, False)) * 100,
    }


def test_metrics_match_numpy_brute_force(spark):
    sc = scored_fixture(spark)
    rows = M.accuracy(sc, ["target", S.COUNTRY]).collect()
    pdf = sc.toPandas()
    for r in rows:
        sub = pdf[(pdf.target == r.target) & (pdf.Country == r.Country)]
        exp = _np_metrics(sub.actual, sub.predicted)
        for k, v in exp.items():
            if v is None:
                assert r[k] is None
            else:
                assert abs(r[k] - v) < 1e-9 * max(1, abs(v)), (r.target, k, r[k], v)


def test_zero_actual_and_constant_target(spark):
    rows = {(r.target, r.Country): r for r in M.accuracy(scored_fixture(spark), ["target", S.COUNTRY]).collect()}
    assert rows[("sales", "France")].zero_actual_rows == 1
    const = rows[("cogs", "Germany")]
    assert const.r2 == 1.0 and const.mape == 0.0 and const.std_actual == 0.0


def test_rolling_windows_skip_small_and_exclude_last_day(spark):
    sc = scored_fixture(spark)
    w = M.rolling_metrics(sc, window_days=10, n_windows=3, min_rows=12).collect()
    # windows start at max - 30 = Dec 31, so window 1 holds 9 data days; cogs (one
    # series, <= 10 rows per window) is dropped by min_rows=12
    assert {r.target for r in w} == {"sales"}
    assert sorted((r.window_id, r.n) for r in w) == [(1, 18), (2, 20), (3, 20)]
    assert max(r.window_end for r in w) == sc.agg(F.max("date")).collect()[0][0]
    avg = M.rolling_average(sc, 10, 3, 12).collect()[0]
    assert avg.n_windows == 3


def test_segment_metrics_min_rows(spark):
    s = M.segment_metrics(scored_fixture(spark), span_days=180, min_rows=20).collect()
    assert {(r.segment_type, r.segment_value, r.target) for r in s} == {
        ("Country", "Germany", "sales"), ("Country", "Germany", "cogs"), ("Country", "France", "sales"),
        ("Channel", "Off-Trade", "sales"), ("Channel", "Off-Trade", "cogs"), ("Channel", "On-Trade", "sales"),
        ("Product_Category", "Beer", "sales"), ("Product_Category", "Beer", "cogs"),
        ("Product_Category", "Wine", "sales")}
    assert all(r.n == 30 for r in s)
    # a 15-day span keeps 16 days (inclusive) per segment: below 20, all skipped
    assert M.segment_metrics(scored_fixture(spark), span_days=15, min_rows=20).count() == 0


def test_rating_bands(spark):
    df = spark.createDataFrame([(4.0, 0.95), (9.0, 0.85), (15.0, 0.7), (4.0, 0.5), (25.0, 0.99)],
                               "mape double, r2 double")
    out = [r[0] for r in df.select(M.rating(F.col("mape"), F.col("r2"))).collect()]
    assert out == ["EXCELLENT", "GOOD", "FAIR", "NEEDS IMPROVEMENT", "NEEDS IMPROVEMENT"]


def test_recommendations_order_and_limit(spark):
    h = spark.createDataFrame([("sales", 20.0, 0.5, 10.0), ("cogs", 20.0, 0.5, 10.0), ("volume", 20.0, 0.5, 10.0)],
                              "target string, mape double, r2 double, bias_pct double")
    recs = M.recommendations(h).orderBy("rec_no").collect()
    assert len(recs) == 10 and recs[0].recommendation == S.REC_SALES_MAPE
    assert recs[-1].recommendation == S.REC_GENERAL[1]
    ok = spark.createDataFrame([("sales", 1.0, 0.99, 0.0), ("cogs", 1.0, 0.99, 0.0), ("volume", 1.0, 0.99, 0.0)],
                               "target string, mape double, r2 double, bias_pct double")
    assert [r.recommendation for r in M.recommendations(ok).orderBy("rec_no").collect()] == S.REC_GENERAL


def test_best_model_first_wins_ties(spark):
    m = spark.createDataFrame([("t", "a", 0, 0.9), ("t", "b", 1, 0.9), ("t", "c", 2, 0.8)],
                              "target string, model string, model_order int, r2 double")
    best = M.select_best(m).filter("is_best").collect()
    assert [r.model for r in best] == ["a"]


def test_naive_scored_rows_and_identity(spark):
    sc = M.naive_scored(sales_fixture(spark, days=12))
    assert sc.count() == 3 * 48 * 11
    d = M.detailed_predictions(sc).limit(5).collect()
    for r in d:
        assert abs(r.error - (r.actual - r.predicted)) < 0.011


def test_rmse_ge_mae_property(spark):
    rows = M.accuracy(M.naive_scored(sales_fixture(spark, days=20))).collect()
    assert all(r.rmse >= r.mae - 1e-9 for r in rows)


def test_rows_without_a_value_are_left_out_and_told(spark):
    rows = [("t", float(i), float(i) + 1) for i in range(10)]
    holes = rows + [("t", None, 5.0)] * 10 + [("t", 5.0, None)]
    schema = "target string, actual double, predicted double"
    a, b = (M.accuracy(spark.createDataFrame(x, schema)).first() for x in (rows, holes))
    assert (b.n, b.excluded_rows, a.excluded_rows) == (10, 11, 0)
    assert all(abs(a[m] - b[m]) < 1e-9 for m in M.METRICS)


def test_mape_can_keep_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "actual double, predicted double")
    skip, keep = (df.agg(*M.metric_exprs(zero_mape=z)).first().mape for z in ("skip", "keep"))
    assert skip == 50.0 and keep == float("inf")
