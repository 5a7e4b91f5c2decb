"""Accuracy evaluation.

Everything starts from a *scored frame* in long form
``(date, <segment keys>, target, actual, predicted)`` - built once, then
evaluated under different groupings.  The 12 metrics are one aggregation
(``metric_exprs``), so holdout, rolling windows and segments are each a single
``groupBy ... agg`` with map-side partial aggregation: a group is never
collected, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import error, error_pct, round_half_up, round_stat, within
from ..schema import DATE, SEGMENT_KEYS
from .features import domain_lags, drop_incomplete

METRICS = ["mae", "rmse", "r2", "mape", "mean_actual", "mean_predicted", "std_actual",
           "std_predicted", "bias", "bias_pct", "within_10_pct", "within_20_pct"]
TARGET_ORDER = ["sales", "cogs", "volume"]


# ------------------------------------------------------------------ scored frame
def stack_targets(df: DataFrame, pairs: dict[str, tuple[str, str]], keys: Sequence[str] = SEGMENT_KEYS,
                  date_col: str = DATE) -> DataFrame:
    """Wide (actual_i, predicted_i) columns -> long (target, actual, predicted)."""
    entries = F.array(*[F.struct(F.lit(name).alias("target"), F.col(a).alias("actual"),
                                 F.col(p).alias("predicted"))
                        for name, (a, p) in pairs.items()])
    return (df.select(F.col(date_col).cast("date").alias("date"), *keys, F.inline(entries)))


def naive_scored(fact: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, date_col: str = DATE) -> DataFrame:
    """Scored frame whose prediction is yesterday's value (lag 1 per segment).

    A deterministic predictor, so every accuracy operator has an exact SQL
    oracle.  Rows without a lag are dropped, as the original drops NaNs.
    """
    lagged = drop_incomplete(domain_lags(fact, keys, date_col),
                             [f"{c}_lag1" for c in S.DOMAIN_TARGETS.values()])
    pairs = {t: (c, f"{c}_lag1") for t, c in S.DOMAIN_TARGETS.items()}
    return stack_targets(lagged, pairs, keys, date_col)


CANDIDATES = {"naive_lag1": 1, "naive_lag7": 7, "naive_lag30": 30}


def candidate_scored(fact: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, date_col: str = DATE) -> DataFrame:
    """Scored frame for several deterministic candidate predictors (seasonal naive).

    One pass: each lagged row is expanded into (target x candidate) rows by a
    single ``inline``, instead of a union that would re-read the input per
    candidate.
    """
    lags = sorted(set(CANDIDATES.values()))
    lagged = drop_incomplete(domain_lags(fact, keys, date_col, lags=lags),
                             [f"{c}_lag{k}" for c in S.DOMAIN_TARGETS.values() for k in lags])
    entries = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(c).alias("actual"), F.col(f"{c}_lag{k}").alias("predicted"),
                 F.lit(model).alias("model"), F.lit(order).alias("model_order"))
        for order, (model, k) in enumerate(CANDIDATES.items()) for t, c in S.DOMAIN_TARGETS.items()])
    return lagged.select(F.col(date_col).cast("date").alias("date"), *keys, F.inline(entries))


# ---------------------------------------------------------------------- A15/A16
def metric_exprs(actual: str = "actual", predicted: str = "predicted", zero_mape: str = "skip") -> list[Column]:
    """The 12 accuracy metrics as one aggregation (A15), guarded (Q7-Q10).

    R^2 uses SST = n * var_pop(y) (never sum(y^2) - n*mean^2); constant actuals
    give 1 for a perfect fit, else 0.  Only rows with both values count;
    ``excluded_rows`` tells the others.  Within-x% counts a zero actual as a
    miss but keeps it in the denominator.  ``zero_mape``: 'skip' averages the
    rows with a non-zero actual (``zero_actual_rows`` reports the others);
    'keep' is the plain form, infinite as soon as a zero actual is missed
    (and NaN where it is hit exactly).
    """
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    y, p = F.when(both, F.col(actual).cast("double")), F.when(both, F.col(predicted).cast("double"))
    e = y - p
    sse = F.sum(e * e)
    n = F.count_if(both)
    sst = n * F.var_pop(y)
    r2 = F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - sse / sst)
    ape = F.when(y != 0, F.abs(e / y))
    if zero_mape == "keep":
        ape = F.when(y == 0, F.when(e == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(ape)
    mean_y = F.avg(y)
    bias = F.avg(p - y)
    return [
        n.alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2.alias("r2"),
        (F.avg(ape) * 100).alias("mape"),
        mean_y.alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.stddev_pop(y).alias("std_actual"),
        F.stddev_pop(p).alias("std_predicted"),
        bias.alias("bias"),
        F.when(mean_y != 0, bias / mean_y * 100).alias("bias_pct"),
        (F.avg(F.when(both, within(y, p, 0.1))) * 100).alias("within_10_pct"),
        (F.avg(F.when(both, within(y, p, 0.2))) * 100).alias("within_20_pct"),
        F.count_if(y == 0).alias("zero_actual_rows"),
        F.count_if(~both).alias("excluded_rows"),
    ]


def rounded(df: DataFrame, digits: int = 4, cols: Sequence[str] = METRICS) -> DataFrame:
    """Round metric columns through an exact decimal (engine-independent)."""
    return df.withColumns({c: round_stat(c, digits) for c in cols if c in df.columns})


def accuracy(scored: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """12 metrics per group."""
    return scored.groupBy(*by).agg(*metric_exprs())


def accuracy4(scored: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """The 4-metric variant: MAE, RMSE, R^2, MAPE."""
    return accuracy(scored, by).select(*by, "n", "mae", "rmse", "r2", "mape")


# ------------------------------------------------------------------------ A18
def holdout_metrics(scored: DataFrame, cut: str, digits: int | None = 4) -> DataFrame:
    """Metrics per target on rows dated on/after ``cut``."""
    out = accuracy(scored.filter(F.col("date") >= F.to_date(F.lit(cut))))
    return out if digits is None else rounded(out, digits)


# ------------------------------------------------------------------- A14, A17
def _with_max_date(scored: DataFrame) -> DataFrame:
    """Attach the frame's max date: a 1-row aggregate joined by broadcast."""
    mx = scored.agg(F.max("date").alias("_max_date"))
    return scored.crossJoin(F.broadcast(mx))


def rolling_metrics(scored: DataFrame, window_days: int = 30, n_windows: int = 5,
                    min_rows: int = S.ROLLING_MIN_ROWS, digits: int | None = 4) -> DataFrame:
    """Metrics per target for consecutive windows ending at the last date.

    Windows start at ``max - n*w``; window i covers [start + i*w, start + (i+1)*w),
    so the last date itself is never scored (Q11).  Windows with fewer than
    ``min_rows`` rows are skipped (P15).  ``window_id`` is 1-based.
    """
    s = _with_max_date(scored)
    start = F.date_sub(F.col("_max_date"), window_days * n_windows)
    offset = F.datediff(F.col("date"), start)
    s = (s.withColumn("_start", start)
          .filter((offset >= 0) & (offset < window_days * n_windows))
          .withColumn("window_id", F.floor(offset / window_days).cast("int") + 1))
    out = (s.groupBy("target", "window_id", "_start").agg(*metric_exprs())
            .filter(F.col("n") >= min_rows)
            .withColumn("window_start", F.date_add(F.col("_start"), (F.col("window_id") - 1) * window_days))
            .withColumn("window_end", F.date_add(F.col("window_start"), window_days))
            .drop("_start"))
    cols = ["target", "window_id", "window_start", "window_end", "n", *METRICS, "zero_actual_rows", "excluded_rows"]
    out = out.select(*cols)
    return out if digits is None else rounded(out, digits)


def rolling_average(scored: DataFrame, window_days: int = 30, n_windows: int = 5,
                    min_rows: int = S.ROLLING_MIN_ROWS, digits: int | None = 4) -> DataFrame:
    """Unweighted mean of each metric over the kept windows."""
    w = rolling_metrics(scored, window_days, n_windows, min_rows, digits=None)
    out = w.groupBy("target").agg(F.count(F.lit(1)).alias("n_windows"),
                                  *[F.avg(m).alias(m) for m in METRICS])
    return out if digits is None else rounded(out, digits)


# ------------------------------------------------------------------------ A13
def segment_metrics(scored: DataFrame, dims: Sequence[str] = SEGMENT_KEYS,
                    span_days: int = S.SEGMENT_SPAN_DAYS, min_rows: int = S.SEGMENT_MIN_ROWS,
                    digits: int | None = 4) -> DataFrame:
    """Metrics per (dimension, value, target) over the last ``span_days``.

    The span is inclusive: date >= max - span.  Segments with fewer than
    ``min_rows`` rows are skipped.  Dimensions are unpivoted so all of them are
    evaluated in one aggregation instead of one pass per value.
    """
    s = _with_max_date(scored)
    s = s.filter(F.col("date") >= F.date_sub(F.col("_max_date"), span_days))
    long = s.select("target", "actual", "predicted", F.inline(F.array(*[
        F.struct(F.lit(d).alias("segment_type"), F.col(d).cast("string").alias("segment_value"))
        for d in dims])))
    out = (long.groupBy("segment_type", "segment_value", "target").agg(*metric_exprs())
               .filter(F.col("n") >= min_rows))
    return out if digits is None else rounded(out, digits)


# ------------------------------------------------------------------- P17, P18
def rating(mape: Column, r2: Column) -> Column:
    """EXCELLENT / GOOD / FAIR / NEEDS IMPROVEMENT from MAPE and R^2."""
    out = F.lit(S.RATING_FALLBACK)
    for max_mape, min_r2, label in reversed(S.RATING_BANDS):
        out = F.when((mape <= max_mape) & (r2 >= min_r2), F.lit(label)).otherwise(out)
    return out


def accuracy_rating(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("rating", rating(F.col("mape"), F.col("r2")))


def _by_target(metrics: DataFrame, metric: str, target: str) -> Column:
    return F.max(F.when(F.col("target") == target, F.col(metric)))


def recommendations(holdout: DataFrame, variant: str = "report") -> DataFrame:
    """Recommendation list from holdout metrics (P18), one row each.

    ``report``: 8 conditional rules then 5 general ones, first 10 kept.
    ``console``: 4 conditional rules (MAPE x3, any R^2 < 0.7) then 3 general.
    """
    g = holdout.agg(*[_by_target(holdout, m, t).alias(f"{t}_{m}")
                      for t in TARGET_ORDER for m in ("mape", "r2", "bias_pct")])
    rules = [
        (F.col("sales_mape") > S.REC_MAPE_LIMIT, S.REC_SALES_MAPE),
        (F.col("cogs_mape") > S.REC_MAPE_LIMIT, S.REC_COGS_MAPE),
        (F.col("volume_mape") > S.REC_MAPE_LIMIT, S.REC_VOLUME_MAPE),
        ((F.col("sales_r2") < S.REC_R2_LIMIT) | (F.col("cogs_r2") < S.REC_R2_LIMIT), S.REC_SALES_COGS_R2),
        (F.col("volume_r2") < S.REC_R2_LIMIT, S.REC_VOLUME_R2),
        (F.abs(F.col("sales_bias_pct")) > S.REC_BIAS_LIMIT, S.REC_SALES_BIAS),
        (F.abs(F.col("cogs_bias_pct")) > S.REC_BIAS_LIMIT, S.REC_COGS_BIAS),
        (F.abs(F.col("volume_bias_pct")) > S.REC_BIAS_LIMIT, S.REC_VOLUME_BIAS),
    ]
    general = S.REC_GENERAL
    if variant == "console":
        rules = [
            (F.col("sales_mape") > S.REC_MAPE_LIMIT, S.CONSOLE_SALES_MAPE),
            (F.col("cogs_mape") > S.REC_MAPE_LIMIT, S.CONSOLE_COGS_MAPE),
            (F.col("volume_mape") > S.REC_MAPE_LIMIT, S.CONSOLE_VOLUME_MAPE),
            ((F.col("sales_r2") < S.REC_R2_LIMIT) | (F.col("cogs_r2") < S.REC_R2_LIMIT)
             | (F.col("volume_r2") < S.REC_R2_LIMIT), S.CONSOLE_ANY_R2),
        ]
        general = S.CONSOLE_GENERAL
    items = [F.when(F.coalesce(cond, F.lit(False)), F.lit(text)) for cond, text in rules]
    items += [F.lit(text) for text in general]
    arr = F.slice(F.filter(F.array(*items), lambda x: x.isNotNull()), 1, S.REC_LIMIT)
    return g.select(F.posexplode(arr).alias("pos", "recommendation")).select(
        (F.col("pos") + 1).alias("rec_no"), "recommendation")


# ------------------------------------------------------------------------- M6
def select_best(metrics: DataFrame, by: str = "target", score: str = "r2",
                order_col: str = "model_order") -> DataFrame:
    """Flag the best model per target: max R^2, first candidate wins ties (M6)."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), F.col(order_col))
    return (metrics.withColumn("rank", F.row_number().over(w))
                   .withColumn("is_best", F.col("rank") == 1))


def candidate_metrics(cands: DataFrame, cut: str) -> DataFrame:
    """Holdout 4-metric table per (target, model), best flagged (M4 evaluation + M6)."""
    test = cands.filter(F.col("date") >= F.to_date(F.lit(cut)))
    m = test.groupBy("target", "model", "model_order").agg(*metric_exprs()).select(
        "target", "model", "model_order", "n", "mae", "rmse", "r2", "mape")
    return select_best(m)


# ------------------------------------------------------------------------ M14
def detailed_predictions(scored: DataFrame, cut: str | None = None, keys: Sequence[str] = SEGMENT_KEYS,
                         digits: int = 2) -> DataFrame:
    """Row-level actual, predicted, error and error %."""
    s = scored if cut is None else scored.filter(F.col("date") >= F.to_date(F.lit(cut)))
    return s.select("date", *keys, "target",
                    round_half_up("actual", digits).alias("actual"),
                    round_half_up("predicted", digits).alias("predicted"),
                    round_half_up(error("actual", "predicted"), digits).alias("error"),
                    round_half_up(error_pct("actual", "predicted"), digits).alias("error_pct"))


# ------------------------------------------------------------------- A21-A23
def prediction_summary(df: DataFrame, by: Sequence[str] = ("target",), col: str = "predicted") -> DataFrame:
    """Mean, min, max and *sample* std of predictions per group."""
    c = F.col(col).cast("double")
    return df.groupBy(*by).agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
                               F.stddev_samp(c).alias("std"))


def prediction_summary_wide(df: DataFrame, prefix: str = "predicted_") -> DataFrame:
    """A21 over every ``predicted_*`` column of a wide prediction frame (long output)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  F.col(c).cast("double").alias("value")) for c in cols])))
    return prediction_summary(long, by=("column",), col="value")


def forecast_totals(df: DataFrame, date_col: str, prefix: str = "predicted_") -> DataFrame:
    """Per target: total, daily mean and peak of the forecast, plus its date span."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    # values keep their type while summed (exact for DECIMAL predictions)
    long = df.select(F.col(date_col).cast("date").alias("_d"), F.inline(F.array(*[
        F.struct(F.lit(c[len(prefix):]).alias("target"), F.col(c).alias("value")) for c in cols])))
    total = F.sum("value")
    return long.groupBy("target").agg(
        F.min("_d").alias("start_date"), F.max("_d").alias("end_date"),
        total.cast("double").alias("total"),
        (total.cast("double") / F.count("value")).alias("avg_daily"),
        F.max("value").cast("double").alias("peak"))


# ------------------------------------------------------------------------- O5
def last_rows(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """The last ``n`` rows in (order_cols) order, e.g. the latest days of a
    prepared frame for a sample forecast (O5).  A top-k: each task keeps n rows,
    the driver merges at most n x tasks rows."""
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)
