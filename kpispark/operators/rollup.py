"""Weekly / monthly rollups of a daily frame.

Periods follow the calendar-resample convention: a week is labelled by its
Sunday (weeks run Monday-Sunday), a month by its last day.  Rollups are one
``groupBy(keys, period)``; the dense variant fills each key's gaps from the
rollup itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEGMENT_KEYS
from .kpi import D_COGS, D_DATE, D_MARKETING, D_SALES, D_VOLUME

SUM_COLS = [D_SALES, D_COGS, "gross_profit_eur", "predicted_operating_cash_flow_eur", D_MARKETING,
            D_VOLUME]
MEAN_COLS = ["gross_profit_margin_pct", "asp_per_litre_eur"]


def period_end(date: Column, freq: str) -> Column:
    """Label of the period containing ``date``: 'W' -> Sunday, 'M' -> month end."""
    if freq == "W":
        return F.date_add(F.to_date(F.date_trunc("week", date)), 6)
    if freq == "M":
        return F.last_day(date)
    raise ValueError("freq must be 'W' or 'M'")


def _aggs(sum_cols: Sequence[str], mean_cols: Sequence[str]) -> list[Column]:
    return ([F.sum(c).alias(c) for c in sum_cols] + [F.avg(c).alias(c) for c in mean_cols]
            + [F.count(F.lit(1)).alias("days")])


def rollup(daily: DataFrame, freq: str = "W", keys: Sequence[str] = SEGMENT_KEYS,
           sum_cols: Sequence[str] = SUM_COLS, mean_cols: Sequence[str] = MEAN_COLS,
           date_col: str = D_DATE) -> DataFrame:
    """Six sums and two unweighted means per (keys, period)."""
    p = period_end(F.col(date_col), freq).alias("period_end")
    return daily.groupBy(*keys, p).agg(*_aggs(sum_cols, mean_cols))


def rollup_sum_all(daily: DataFrame, freq: str = "W", keys: Sequence[str] = SEGMENT_KEYS,
                   date_col: str = D_DATE) -> DataFrame:
    """Sum of *every* numeric column per period, ratios and flags included (A10)."""
    numeric = [f.name for f in daily.schema.fields
               if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in keys]
    p = period_end(F.col(date_col), freq).alias("period_end")
    return daily.groupBy(*keys, p).agg(*[F.sum(F.col(c).cast("int") if
                                               isinstance(daily.schema[c].dataType, T.BooleanType)
                                               else F.col(c)).alias(c) for c in numeric])


def dense_rollup(daily: DataFrame, freq: str = "W", keys: Sequence[str] = SEGMENT_KEYS,
                 sum_cols: Sequence[str] = SUM_COLS, mean_cols: Sequence[str] = MEAN_COLS,
                 date_col: str = D_DATE) -> DataFrame:
    """A9 including empty periods inside the range: sums 0, means NULL.

    Each period of the rollup is expanded by the empty ones up to the key's
    next period (a window over the rollup, whose groups are bounded by the
    calendar span).  No spine and no join, so the input is read once.
    """
    agg = rollup(daily, freq, keys, sum_cols, mean_cols, date_col)
    w = Window.partitionBy(*keys).orderBy("period_end")
    step = F.expr("INTERVAL 7 DAYS" if freq == "W" else "INTERVAL 1 MONTH")
    # months advance from their first days, so that every month has a label
    first = F.col("period_end") if freq == "W" else F.trunc("period_end", "month")
    out = agg.withColumn("_first", first).withColumn("_next", F.lead("_first").over(w))
    last = F.coalesce(F.date_sub("_next", 1), F.col("_first"))
    out = out.withColumn("_p", F.explode(F.sequence(F.col("_first"), last, step)))
    own = F.col("_p") == F.col("_first")
    label = F.col("_p") if freq == "W" else F.last_day("_p")
    zero = {c: F.when(own, F.col(c)).otherwise(F.lit(0).cast(agg.schema[c].dataType)) for c in [*sum_cols, "days"]}
    return out.select(*keys, label.alias("period_end"), *[zero[c].alias(c) for c in sum_cols],
                      *[F.when(own, F.col(c)).alias(c) for c in mean_cols], zero["days"].alias("days"))
