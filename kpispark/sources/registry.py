"""A registry of training runs (K5, K6, S5): runs are told apart, and only finished ones are read.

    <dir>/runs/run=<id>/models/<target>   Spark ML pipelines
    <dir>/metrics/run=<id>/               the run's metric rows
    <dir>/manifest/                       one row per finished run, written last

Nothing is overwritten: a run adds folders of its own, and its manifest row is
appended once all else is there.  A run that stops halfway leaves no row, so
readers, which start from the manifest, never see it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .io import load_model, path_exists

MANIFEST = "run string, finished_at timestamp, targets array<string>, schema_json string"


def _folder(model_dir: str, kind: str, run: str | None = None) -> str:
    return os.path.join(model_dir, kind, f"run={run}") if run else os.path.join(model_dir, kind)


def save_run(spark: SparkSession, model_dir: str, models: Mapping[str, PipelineModel], metrics: DataFrame | None = None,
             schema: Mapping | None = None, run: str | None = None) -> str:
    """Write a run and, last, its manifest row; returns the run's id.

    An id that is taken, also by an unfinished run, raises.  ``metrics`` has a
    row per target (and candidate), with any columns but ``run``.
    """
    run = run or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    if "/" in run or path_exists(spark, _folder(model_dir, "runs", run)) or path_exists(spark, _folder(model_dir, "metrics", run)):
        raise ValueError(f"run {run!r} is taken or no folder name")
    for target, model in models.items():
        model.write().save(os.path.join(_folder(model_dir, "runs", run), "models", target))
    if metrics is not None:
        metrics.write.mode("error").parquet(_folder(model_dir, "metrics", run))
    row = (run, datetime.now(timezone.utc), list(models), json.dumps(dict(schema or {})))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(_folder(model_dir, "manifest"))
    return run


def finished_runs(spark: SparkSession, model_dir: str) -> DataFrame:
    """run, finished_at, targets, schema_json of every finished run."""
    folder = _folder(model_dir, "manifest")
    return spark.read.schema(MANIFEST).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], MANIFEST)


def run_metrics(spark: SparkSession, model_dir: str) -> DataFrame | None:
    """Metric rows of the finished runs with ``run`` and ``finished_at``; None if no run has any.

    Runs may bring different columns; those that one lacks are null.
    """
    folder = _folder(model_dir, "metrics")
    if not path_exists(spark, folder):
        return None
    rows = spark.read.option("mergeSchema", True).parquet(folder).withColumn("run", F.col("run").cast("string"))
    return rows.join(broadcast_if_small(finished_runs(spark, model_dir).select("run", "finished_at")), "run")


def best_runs(spark: SparkSession, model_dir: str, metric: str = "r2", largest: bool = True) -> DataFrame:
    """The finished run with the best metric per target; ties go to the later run. Nulls and NaN never win."""
    rows = run_metrics(spark, model_dir)
    if rows is None:
        return spark.createDataFrame([], f"target string, run string, finished_at timestamp, {metric} double")
    value = F.col(metric).cast("double")
    order = Window.partitionBy("target").orderBy(F.desc("_v") if largest else F.asc("_v"), F.desc("finished_at"), F.desc("run"))
    return (rows.withColumn("_v", value).where("_v IS NOT NULL AND NOT isnan(_v)").withColumn("_r", F.row_number().over(order))
            .where("_r = 1").select("target", "run", "finished_at", F.col("_v").alias(metric)))


def load_run(spark: SparkSession, model_dir: str, run: str | None = None, targets: Sequence[str] | None = None
             ) -> tuple[str, dict[str, PipelineModel], dict]:
    """(run, models, schema) of a finished run, the latest by default; an unknown or unfinished one raises."""
    runs = finished_runs(spark, model_dir)
    runs = runs.where(F.col("run") == run) if run else runs.orderBy(F.desc("finished_at"), F.desc("run"))
    row = runs.first()
    if row is None:
        raise ValueError(f"no finished run {run!r}" if run else "no finished run")
    models = {}
    for target in targets or row["targets"]:
        model, there = load_model(os.path.join(_folder(model_dir, "runs", row["run"]), "models", target))
        if not there:
            raise ValueError(f"run {row['run']!r} has no model of {target!r}")
        models[target] = model
    return row["run"], models, json.loads(row["schema_json"])


def load_best(spark: SparkSession, model_dir: str, metric: str = "r2", largest: bool = True) -> dict[str, tuple[str, PipelineModel]]:
    """target -> (run, model) of its best finished run."""
    best = best_runs(spark, model_dir, metric, largest).collect()   # a row per target
    return {r["target"]: (r["run"], load_run(spark, model_dir, r["run"], [r["target"]])[1][r["target"]]) for r in best}
