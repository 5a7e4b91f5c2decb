import os
import tempfile

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from kpispark import schema as S
from kpispark.operators import models
from kpispark.sources import io
from tests.fixtures import demo_ecommerce, sales_fixture


def test_generic_prepare_train_predict_roundtrip(spark):
    df = demo_ecommerce(spark, days=45)
    prep = models.prepare_data(df)
    assert prep.targets == ["daily_sales", "avg_order_value"]
    assert prep.data.count() == 12 * 45 - 12 * 30        # lag-30 rows dropped per group
    cands = models.candidate_regressors(max_iter=3, num_trees=3)
    res = models.train_models(prep, test_size=0.2, candidates=cands)
    table = res.metrics.collect()
    assert len(table) == 2 * 3 and sum(r.is_best for r in table) == 2
    new = df.limit(20).withColumn("region", F.when(F.col("region") == "North", "Unseen").otherwise(F.col("region")))
    out = models.predict(new, res.models, prep)
    assert out.columns == df.columns + ["predicted_daily_sales", "predicted_avg_order_value"]
    assert out.filter(F.col("predicted_daily_sales").isNull()).count() == 0
    imp = models.feature_importance(res.models["daily_sales"], prep.data).collect()
    assert len(imp) > 10 and imp[0].importance >= imp[-1].importance
    with tempfile.TemporaryDirectory() as d:
        io.save_models(res.models, d, res.metrics, prep.schema_dict())
        loaded, metrics, schema = io.load_models(spark, d)
        assert set(loaded) == {"daily_sales", "avg_order_value"} and schema["date_column"] == "date"
        assert metrics.count() == 6
        assert io.load_model(os.path.join(d, "missing")) == (None, False)


def test_domain_models_and_voting(spark):
    frame = models.domain_feature_frame(sales_fixture(spark, days=30))
    fitted = models.train_domain_models(frame, "2023-12-20", max_iter=3)
    pred = models.domain_predict(frame.filter(F.col(S.DATE) >= "2023-12-20"), fitted)
    assert {f"predicted_{t}" for t in S.DOMAIN_TARGETS.values()} <= set(pred.columns)
    with_check = models.check_features(frame, S.SALES_FEATURES)
    assert len(with_check.columns) == 18
    other = models.target_pipeline([S.VOLUME], [], S.REVENUE, models.domain_regressor(2)).fit(frame)
    few = frame.orderBy(S.DATE, *S.SEGMENT_KEYS).limit(10).persist()
    name = f"predicted_{S.REVENUE}"
    each = [{(r[S.DATE], *[r[k] for k in S.SEGMENT_KEYS]): r[name] for r in models.score(few, m).collect()}
            for m in (fitted["sales"], other)]
    v = {(r[S.DATE], *[r[k] for k in S.SEGMENT_KEYS]): r[name]
         for r in models.voting_predict(few, [fitted["sales"], other], S.REVENUE).collect()}
    assert any(abs(each[0][k] - each[1][k]) > 1e-6 for k in v)
    assert all(abs(v[k] - (each[0][k] + each[1][k]) / 2) < 1e-6 for k in v)


def test_one_hot_gives_seen_values_a_slot_and_unseen_ones_none(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, y double")
    stages, out = models.preprocessing_stages(["y"], ["c"], "_m")
    fitted = Pipeline(stages=stages).fit(train)
    rows = fitted.transform(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("new", 1.0), (None, 1.0)], "c string, y double"))
    assert [r[out].toArray().tolist() for r in rows.collect()] == [[1, 1, 0], [1, 0, 1], [1, 0, 0], [1, 0, 0]]
    assert models.slot_names(fitted.stages) == ["y", "c_a", "c_b"]


def test_importance_names_follow_the_input_order(spark):
    rows = [(float(i % 7), float(i), float(i % 3), 10.0 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "price_1 double, price_0 double, price_2 double, t double")
    model = models.target_pipeline(["price_1", "price_0", "price_2"], [], "t", models.domain_regressor(3), scale=True).fit(df)
    assert models.feature_importance(model, df).first().feature == "price_0"


def test_positional_split_uses_the_lags_groups(spark):
    df = demo_ecommerce(spark, days=40)
    prep = models.prepare_data(df, targets=["daily_sales"], group_cols=["region"])
    _, test = models.split(prep, method="positional")
    assert {r[0] for r in test.select("region").distinct().collect()} == {"West"}


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + 2
    y = x @ [2.0, -1.0, 0.5] + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    fitted = models.ridge(df, ["a", "b", "c"], "y", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(fitted.coefficients, want, atol=1e-9)
    assert abs(fitted.intercept - (y.mean() - x.mean(0) @ want)) < 1e-6


def test_folds_are_contiguous(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(23)], "d int, v double").repartition(4)
    got = models.contiguous_folds(df, 5, ["d"]).orderBy("d").collect()
    assert [r["_fold"] for r in got] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_training_frame_bounds_the_partitions_of_a_large_frame(spark):
    df = spark.range(400, numPartitions=40).withColumn("v", F.col("id") * 2.0)
    # one row is worth a partition here, so the frame is large: every tree level would report to the driver 40 times
    large = models.training_frame(df, rows_per_partition=1)
    assert large.rdd.getNumPartitions() == models.MOST_PARTITIONS
    assert large.agg(F.count("*"), F.sum("v")).first() == (400, 399 * 400.0)
    assert models.training_frame(df, rows_per_partition=1, most_rows=20).rdd.getNumPartitions() == 20
    assert models.training_frame(df, rows_per_partition=100).rdd.getNumPartitions() == 4
    assert models.training_frame(df.limit(0)).count() == 0
