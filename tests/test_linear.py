"""Least squares from co-moments against plain fits, fold by fold and group by group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpispark.operators import linear

X = ["a", "b", "c"]


def ridge(x, y, alpha=0.0):
    """(weights, intercept) of centred least squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.lstsq(np.vstack((xc, np.sqrt(alpha) * np.eye(x.shape[1]))), np.append(yc, np.zeros(x.shape[1])), rcond=None)[0]
    return w, y.mean() - w @ x.mean(0)


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 100, -3]
    y = x @ [2.0, -0.3, 7.0] + 4 + rng.normal(size=n)
    z = x @ [0.0, 1.0, -2.0] - 9 + rng.normal(size=n)
    g = rng.choice(["u", "v", "w"], n, p=[0.8, 0.15, 0.05])
    rows = [(f"2020-{1 + i * 12 // n:02d}-{1 + i % 28:02d}", str(g[i]), *map(float, x[i]), float(y[i]), float(z[i])) for i in range(n)]
    return spark.createDataFrame(rows, "d string, g string, a double, b double, c double, y double, z double").withColumn(
        "d", F.to_date("d")).repartition(3), rows


def near(weights, want):
    assert [weights[f] for f in X] == pytest.approx(list(want), rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("alpha", [0.0, 2.5])
def test_groups_and_targets_at_once(spark, alpha):
    df, rows = table(spark)
    got = {(r.g, r.target): r for r in linear.fit_groups(df, ["g"], X, ["y", "z"], alpha, pooled=True).collect()}
    assert len(got) == 8
    for (g, target), r in got.items():
        mine = [x for x in rows if g is None or x[1] == g]
        x, y = [m[2:5] for m in mine], np.array([m[5 if target == "y" else 6] for m in mine])
        w, b = ridge(x, y, alpha)
        near(r.weights, w)
        assert r.intercept == pytest.approx(b, rel=1e-8) and r.n == len(mine) and r.rank == 3
        left = y - np.asarray(x) @ w - b
        assert r.r2 == pytest.approx(1 - (left @ left) / ((y - y.mean()) @ (y - y.mean())), rel=1e-8)


def test_singular_groups_have_a_defined_answer(spark):
    rows = [("flat", 3.0, i * 1.0, 2.0 * i, 5.0 + i) for i in range(9)]          # a constant, c twice b
    rows += [("one", 1.0, 2.0, 3.0, 4.0), ("still", 1.0, 0.0, 2.0, 7.0), ("still", 2.0, 1.0, 5.0, 7.0)]
    rows += [("gap", None, 1.0, 1.0, 1.0), ("gap", float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    got = {r.g: r for r in linear.fit_groups(df, ["g"], X, ["y"]).collect()}
    assert set(got) == {"flat", "one", "still"}  # no complete row: no group
    assert got["flat"].rank == 1 and got["flat"].weights == {"a": 0.0, "b": 1.0, "c": 0.0} and got["flat"].intercept == 5.0
    assert got["one"].rank == 0 and got["one"].intercept == 4.0 and got["one"].r2 == 1.0
    assert got["still"].intercept == pytest.approx(7.0) and set(got["still"].weights.values()) == {0.0} and got["still"].r2 == 1.0
    assert linear.fit_groups(df.limit(0), ["g"], X, ["y"]).count() == 0


def test_expanding_folds_equal_a_fit_per_fold(spark):
    df, rows = table(spark)
    cuts = linear.cut_points(df, "d", 4)
    marks = [(r.fold, str(r.cut)) for r in cuts.orderBy("fold").collect()]
    models, metrics = linear.expanding_cv(df, X, ["y", "z"], "d", cuts, 1.0)
    models = {(r.fold, r.target): r for r in models.collect()}
    metrics = {(r.fold, r.target): r for r in metrics.collect()}
    assert len(models) == len(metrics) == 8
    for i, (fold, cut) in enumerate(marks):
        until = marks[i + 1][1] if i + 1 < len(marks) else "9999"
        for at, target in ((5, "y"), (6, "z")):
            before = [r for r in rows if r[0] < cut]
            test = [r for r in rows if cut <= r[0] < until]
            w, b = ridge([r[2:5] for r in before], [r[at] for r in before], 1.0)
            near(models[fold, target].weights, w)
            err = np.array([r[at] for r in test]) - np.array([r[2:5] for r in test]) @ w - b
            got = metrics[fold, target]
            assert (got.n, models[fold, target].n) == (len(test), len(before))
            assert got.mae == pytest.approx(np.abs(err).mean(), rel=1e-8) and got.rmse == pytest.approx(np.sqrt((err ** 2).mean()), rel=1e-8)


def test_folds_without_rows_before_or_in_them(spark):
    df, _ = table(spark, 40)
    cuts = spark.createDataFrame([(1, "2019-01-01"), (2, "2020-06-01"), (3, "2031-01-01")], "fold int, cut string")
    models, metrics = linear.expanding_cv(df, X, ["y"], "d", cuts)
    assert {r.fold: r.n for r in models.collect()} == {1: None, 2: 17, 3: 40}
    got = {r.fold: (r.n, r.excluded_rows) for r in metrics.collect()}
    assert got == {1: (0, 17), 2: (23, 0)}  # nothing learnt: rows without a prediction; no rows: no metrics
    assert linear.cut_points(df.limit(0), "d", 3).count() == 0


def test_jobs_do_not_grow_with_folds(spark):
    df, _ = table(spark, 60)
    sc = spark.sparkContext

    def jobs(folds):
        sc.setJobGroup(f"cv{folds}", "")
        models, metrics = linear.expanding_cv(df, X, ["y"], "d", linear.cut_points(df, "d", folds))
        metrics.collect()
        return len(sc.statusTracker().getJobIdsForGroup(f"cv{folds}"))
    assert jobs(9) <= jobs(2) + 1
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_stacking_equals_a_fit_per_fold(spark):
    df, rows = table(spark, 203)
    bases = {"first": ["a"], "both": ["b", "c"]}
    stack = linear.stack_fit(df, bases, "y", ["d", "a"], 5, 1.0)
    order = sorted(rows, key=lambda r: (r[0], r[2]))
    at = {"a": 2, "b": 3, "c": 4}

    def cols(rs, names):
        return [[r[at[n]] for n in names] for r in rs]
    folds = np.array_split(np.arange(len(order)), 5)
    oof = np.zeros((len(order), 2))
    for fold in folds:
        rest = [order[i] for i in range(len(order)) if i not in set(fold.tolist())]
        for j, own in enumerate(bases.values()):
            w, b = ridge(cols(rest, own), [r[5] for r in rest])
            oof[fold, j] = np.array(cols([order[i] for i in fold], own)) @ w + b
    mw, mb = ridge(oof, [r[5] for r in order], 1.0)
    row = stack.first()
    assert [row.meta.weights[b] for b in bases] == pytest.approx(mw.tolist(), rel=1e-7)
    assert row.meta.intercept == pytest.approx(mb, rel=1e-7) and row.meta.n == 203
    final = {n: ridge(cols(order, own), [r[5] for r in order]) for n, own in bases.items()}
    got = linear.stack_predict(df, stack, bases, "y").orderBy("d", "a").collect()
    for r, x in zip(got, order):
        base = [np.dot([x[at[f]] for f in own], final[n][0]) + final[n][1] for n, own in bases.items()]
        assert r.predicted_y == pytest.approx(float(np.dot(base, mw) + mb), rel=1e-7)


def test_coefficient_table_round_trip_and_fallbacks(spark):
    df, _ = table(spark)
    models = linear.fit_groups(df, ["g"], X, ["y", "z"], pooled=True)
    coefficients = linear.coefficient_table(models, ["g"])
    assert coefficients.count() == 4 * 2 * 4
    by = {(r.g, r.target, r.feature): r.weight for r in coefficients.collect()}
    new = spark.createDataFrame([("u", 1.0, 2.0, 3.0, "kept"), ("x", 1.0, 2.0, 3.0, "kept"), (None, 1.0, None, 3.0, "kept")],
                                "g string, a double, b double, c double, weight string")
    for limit in (None, -1):  # by broadcast and by shuffle
        got = {r.g: r for r in linear.predict_table(new, coefficients, ["g"], X, ["y", "z"], limit).collect()}
        for g, key, b in (("u", "u", 2.0), ("x", None, 2.0), (None, None, 0.0)):
            for t in ("y", "z"):
                want = by[key, t, linear.INTERCEPT] + by[key, t, "a"] + b * by[key, t, "b"] + 3 * by[key, t, "c"]
                assert got[g][f"predicted_{t}"] == pytest.approx(want)
        assert got["u"].weight == "kept"
    plain = linear.coefficient_table(linear.fit_groups(df.withColumnsRenamed({"a": "a_lag1", "b": "b_index"}), [], ["a_lag1", "b_index"], ["y"]))
    w = {r.feature: r.weight for r in plain.collect()}
    got = linear.predict_table(new.select("g"), plain, [], ["a_lag1", "b_index"], ["y"]).first()  # both absent: 1000 and 1
    assert got.predicted_y == pytest.approx(w[linear.INTERCEPT] + 1000 * w["a_lag1"] + w["b_index"])
    none = linear.predict_table(new, coefficients.limit(0), ["g"], X, ["y"])
    assert [r.predicted_y for r in none.collect()] == [None] * 3


def test_forecast_covers_every_group(spark):
    df, _ = table(spark)
    coefficients = linear.coefficient_table(linear.fit_groups(df, ["g"], X, ["y"], pooled=True), ["g"])
    rows, totals = linear.forecast_table(df, coefficients, "d", ["g"], X, ["y"], 7, base_values={"a": 5.0})
    assert rows.count() == 3 * 7 and rows.where("predicted_y IS NULL").count() == 0
    total = totals.first()
    assert total.target == "y" and total.total == pytest.approx(sum(r.predicted_y for r in rows.collect()))
