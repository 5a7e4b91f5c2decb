"""Accuracy report tables.

The report is a set of small tables computed from one written scored frame;
each is a Spark aggregation, the executive summary is a ``unionByName`` of
key/value frames.  Only the final write touches storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut_lineage
from . import metrics as M


def side_by_side(metrics: DataFrame, scope: list[str], values: list[str] | None = None) -> DataFrame:
    """One row per scope with each target's metrics in its own columns.

    A pivot over a fixed, known list of targets: no extra pass to discover them.
    """
    values = values or ["mape", "r2", "mae"]
    return (metrics.groupBy(*scope).pivot("target", M.TARGET_ORDER)
                   .agg(*[F.first(v).alias(v) for v in values]))


def holdout_long(holdout: DataFrame) -> DataFrame:
    """Metric x target table of the holdout sheet."""
    long = holdout.select("target", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in M.METRICS])))
    return long.groupBy("metric").pivot("target", M.TARGET_ORDER).agg(F.first("value"))


def executive_summary(holdout: DataFrame, rolling_avg: DataFrame | None, recs: DataFrame,
                      run_info: dict[str, str] | None = None) -> DataFrame:
    """Key/value rows: run info, holdout metrics, ratings, rolling averages,
    numbered recommendations (K3)."""
    spark = holdout.sparkSession
    parts = []
    info = run_info or {}
    if info:
        parts.append(spark.createDataFrame([(i, "run", k, v) for i, (k, v) in enumerate(info.items())],
                                           "ord int, section string, key string, value string"))
    rated = M.accuracy_rating(holdout)
    for sec, col, off in [("holdout", None, 100), ("rating", "rating", 200)]:
        if col is None:
            rows = rated.select(F.inline(F.array(*[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("v")) for m in M.METRICS])),
                "target")
            parts.append(rows.select(F.lit(off).alias("ord"), F.lit(sec).alias("section"),
                                     F.concat_ws(".", "target", "metric").alias("key"),
                                     F.col("v").alias("value")))
        else:
            parts.append(rated.select(F.lit(off).alias("ord"), F.lit(sec).alias("section"),
                                      F.col("target").alias("key"), F.col(col).alias("value")))
    if rolling_avg is not None:
        parts.append(rolling_avg.select(F.lit(300).alias("ord"), F.lit("rolling_average").alias("section"),
                                        F.concat_ws(".", "target", F.lit("mape")).alias("key"),
                                        F.col("mape").cast("string").alias("value")))
        parts.append(rolling_avg.select(F.lit(301).alias("ord"), F.lit("rolling_average").alias("section"),
                                        F.concat_ws(".", "target", F.lit("r2")).alias("key"),
                                        F.col("r2").cast("string").alias("value")))
    parts.append(recs.select((F.col("rec_no") + 400).alias("ord"), F.lit("recommendation").alias("section"),
                             F.col("rec_no").cast("string").alias("key"), F.col("recommendation").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accuracy_report(scored: DataFrame, cut: str, window_days: int = 30, n_windows: int = 5) -> dict[str, DataFrame]:
    """All report tables from one scored frame (K2): summary, holdout,
    rolling windows, segments, detailed predictions, model info.

    The frame is written once (``session.cut_lineage``); every table starts
    from that copy, so however many are asked for, the input is read once.
    """
    scored = cut_lineage(scored)
    holdout = M.holdout_metrics(scored, cut)
    rolling = M.rolling_metrics(scored, window_days, n_windows)
    rolling_avg = M.rolling_average(scored, window_days, n_windows)
    recs = M.recommendations(M.holdout_metrics(scored, cut, digits=None))
    spark = scored.sparkSession
    info = spark.createDataFrame(
        [(i + 1, "sales_cogs", f) for i, f in enumerate(S.SALES_FEATURES)]
        + [(i + 1, "volume", f) for i, f in enumerate(S.VOLUME_FEATURES)],
        "position int, model string, feature string")
    return {
        "executive_summary": executive_summary(holdout, rolling_avg, recs),
        "holdout": holdout_long(holdout),
        "rolling_windows": side_by_side(rolling, ["window_id", "window_start", "window_end"]),
        "segments": side_by_side(M.segment_metrics(scored), ["segment_type", "segment_value"]),
        "detailed_predictions": M.detailed_predictions(scored, cut),
        "model_info": info,
    }
