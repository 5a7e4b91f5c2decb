"""Versioned runs: finished ones are read, aborted ones are not."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kpispark.operators.features import random_split
from kpispark.sources import registry


def model(spark, slope):
    df = spark.createDataFrame([(float(i), slope * i) for i in range(5)], "x double, y double")
    return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"),
                            LinearRegression(featuresCol="f", labelCol="y", solver="normal")]).fit(df)


def metrics(spark, **r2):
    return spark.createDataFrame([(t, v) for t, v in r2.items()], "target string, r2 double")


class Stops:
    """A model whose writing fails."""
    def write(self):
        raise OSError("disk is full")


def test_finished_and_aborted_runs(spark, tmp_path):
    home = str(tmp_path / "registry")
    assert registry.finished_runs(spark, home).count() == 0 and registry.run_metrics(spark, home) is None
    assert registry.load_best(spark, home) == {}
    with pytest.raises(ValueError, match="no finished run"):
        registry.load_run(spark, home)
    one, two = model(spark, 1.0), model(spark, 2.0)
    first = registry.save_run(spark, home, {"sales": one, "cogs": one}, metrics(spark, sales=0.9, cogs=0.4), {"date_column": "d"})
    with pytest.raises(OSError):
        registry.save_run(spark, home, {"sales": two, "cogs": Stops()}, metrics(spark, sales=0.99), run="halfway")
    metrics(spark, sales=0.999).write.parquet(f"{home}/metrics/run=lost")     # stopped before its manifest row
    second = registry.save_run(spark, home, {"sales": two, "cogs": two},
                               metrics(spark, sales=0.5, cogs=0.6).withColumn("mae", F.lit(1.0)))
    assert {r.run for r in registry.finished_runs(spark, home).collect()} == {first, second}
    rows = registry.run_metrics(spark, home).collect()
    assert {(r.run, r.target, r.r2, r.mae) for r in rows} == {(first, "sales", 0.9, None), (first, "cogs", 0.4, None),
                                                              (second, "sales", 0.5, 1.0), (second, "cogs", 0.6, 1.0)}
    assert {r.target: r.run for r in registry.best_runs(spark, home).collect()} == {"sales": first, "cogs": second}
    assert {r.target: r.run for r in registry.best_runs(spark, home, largest=False).collect()} == {"sales": second, "cogs": first}
    run, models, schema = registry.load_run(spark, home)
    assert run == second and set(models) == {"sales", "cogs"} and schema == {}
    assert registry.load_run(spark, home, first, ["sales"])[2] == {"date_column": "d"}
    best = registry.load_best(spark, home)
    assert {t: r for t, (r, _) in best.items()} == {"sales": first, "cogs": second}
    assert best["cogs"][1].stages[-1].coefficients[0] == pytest.approx(2.0)
    for run in ("halfway", "lost", "never"):
        with pytest.raises(ValueError, match="no finished run"):
            registry.load_run(spark, home, run)
    for taken in (first, "halfway", "lost", "a/b"):
        with pytest.raises(ValueError):
            registry.save_run(spark, home, {"sales": one}, run=taken)
    with pytest.raises(ValueError, match="no model"):
        registry.load_run(spark, home, first, ["volume"])


def test_ties_and_missing_metrics(spark, tmp_path):
    home = str(tmp_path / "registry")
    registry.save_run(spark, home, {}, metrics(spark, a=0.5, b=float("nan")), run="r1")
    registry.save_run(spark, home, {}, metrics(spark, a=0.5, b=None), run="r2")
    assert {r.target: r.run for r in registry.best_runs(spark, home).collect()} == {"a": "r2"}


def test_random_split_is_exact_and_the_same_for_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 900).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"))
    train, test = random_split(df, 0.2)
    assert (train.count(), test.count()) == (800, 200) and train.columns == df.columns
    again = random_split(df.orderBy(F.desc("a")).repartition(7), 0.2)
    assert sorted(map(tuple, test.collect()), key=str) == sorted(map(tuple, again[1].collect()), key=str)
    other = random_split(df, 0.2, seed=7)[1]
    assert sorted(map(tuple, test.collect()), key=str) != sorted(map(tuple, other.collect()), key=str)
    tails = [r.a for r in test.collect()]
    assert 350 < sum(tails) / len(tails) < 550   # no part of the order is preferred
    assert [x.count() for x in random_split(df.limit(0))] == [0, 0]
    copies = spark.range(10).select(F.lit(1).alias("x"))
    assert [x.count() for x in random_split(copies, 0.3)] == [7, 3]


def test_null_and_empty_differ_in_the_digest(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("x", None), ("x", "")], "a string, b string")
    train, test = random_split(df, 0.5)
    assert train.count() == test.count() == 2 and train.unionByName(test).distinct().count() == 4
