"""Future scaffolds and forecasts.

A scaffold is a *grid*: forecast days x segments x scenarios, built with
``sequence`` + ``explode`` and a cross join whose size is known up front
(days x distinct segments x scenarios) - never a driver loop.  Segments come
from the history, so the grid grows with the data only through the number
of distinct segments, which is what a forecast must cover anyway.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.calendar import add_basic_calendar, full_calendar
from ..functions.exprs import holiday_rule, promo_day_rule, round_half_up, round_stat
from ..session import cut_lineage

CALENDAR_NAMES = set(S.TIME_FEATURES)


def scaffold_default(name: str, targets: Sequence[str], base_values: Mapping[str, float] | None = None
                     ) -> float | None:
    """Default value of a numeric feature in a future row, by name rule (M9).

    Lag features: 1000 when they lag a target (compared case-insensitively,
    Q15), else 100.  Then explicit base values; calendar features are
    computed (None); temperature 20; spend/cost 1000; rate/index 1; else 0.
    """
    base_values = base_values or {}
    low = name.lower()
    if "lag" in low:
        if any(t.lower() in low for t in targets):
            return S.SCAFFOLD_TARGET_LAG
        return S.SCAFFOLD_OTHER_LAG
    if name in base_values:
        return float(base_values[name])
    if name in CALENDAR_NAMES:
        return None
    if "temp" in low:
        return S.SCAFFOLD_TEMP
    if "spend" in low or "cost" in low:
        return S.SCAFFOLD_SPEND
    if "rate" in low or "index" in low:
        return S.SCAFFOLD_RATE
    return 0.0


def future_scaffold(history: DataFrame, date_col: str, categorical: Sequence[str],
                    numerical: Sequence[str], targets: Sequence[str], horizon: int = 30,
                    base_values: Mapping[str, object] | None = None, per_segment: bool = True,
                    start: str | None = None) -> DataFrame:
    """Future rows for ``horizon`` days after the history's last date (M9).

    ``per_segment=True`` emits every distinct segment of the history for each
    day; categorical columns given in ``base_values`` take that value in every
    row, also one that the history never had.  ``False`` reproduces the original's single row per day with
    categorical values from ``base_values`` or 'default' (Q17).  Calendar
    features are added at the end (F13).
    """
    if not 1 <= horizon <= S.MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {S.MAX_HORIZON} days")
    base_values = dict(base_values or {})
    free = [c for c in categorical if c not in base_values] if per_segment else []
    # the segments, and their last date of all as one more row of the same pass (a grouping set)
    last = F.max(F.col(date_col).cast("date")).alias("_last")
    if free and start is None:
        both = cut_lineage(history.groupingSets([[F.col(c) for c in free], []], *free).agg(
            last, F.grouping_id().alias("_set")))
        whole = both.where("_set <> 0").agg(F.max("_last").alias("_start"))
        segs = both.where("_set = 0").select(*free).crossJoin(F.broadcast(whole))  # one row
    else:
        segs = history.groupBy(*free).agg(last.alias("_start"))
    if start is None:  # a history without dates has no day to start from
        segs = segs.where("_start IS NOT NULL")
    first = F.date_add("_start", 1) if start is None else F.to_date(F.lit(start))
    fixed = [F.lit(str(base_values.get(c, S.CATEGORICAL_DEFAULT))).alias(c) if c not in free else F.col(c)
             for c in categorical]
    grid = segs.withColumn("_start", first).select(
        F.explode(F.sequence(F.col("_start"), F.date_add(F.col("_start"), horizon - 1))).alias(date_col), *fixed)
    fills: dict[str, Column] = {}
    for c in numerical:
        v = scaffold_default(c, targets, base_values)
        if v is not None:
            fills[c] = F.lit(float(v))
    out = grid.select(date_col, *categorical, *[col.alias(n) for n, col in fills.items()])
    return out.withColumns(full_calendar(F.col(date_col)))


def scenario_grid(scenarios: DataFrame, date_start: str = "start_date", date_end: str = "end_date") -> DataFrame:
    """Expand a scenario table (one row per request: segment + date range) into
    one row per scenario day (M11 input).  Row count = sum of range lengths."""
    return scenarios.withColumn("Date", F.explode(F.sequence(F.col(date_start).cast("date"),
                                                             F.col(date_end).cast("date"))))


def future_rows(fact: DataFrame, horizon: int = 30, lag_source: str = "last_observed",
                keys: Sequence[str] = S.SEGMENT_KEYS) -> DataFrame:
    """Scenario rows of the domain forecast: ``horizon`` days after each segment's last date.

    Exogenous columns: volume, marketing and the three indexes are the
    segment's averages; promotion and holiday follow the day rules,
    temperature its yearly course; F12 calendar columns are added.  The lag
    columns are constants (``lag_source='constant'``: 300,000, 120,000 and
    0.95 x volume) or the segment's last values (``'last_observed'``).  One
    aggregate over the fact, then days x segments rows.
    """
    if lag_source not in ("constant", "last_observed"):
        raise ValueError(f"unknown lag_source {lag_source!r}")
    if not 1 <= horizon <= S.MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {S.MAX_HORIZON} days")

    def mean(c: str) -> Column:
        return round_half_up(F.sum(c).cast("double") / F.count(c)).cast(S.MONEY)
    lagged = {S.REVENUE: S.FUTURE_REVENUE_LAG, S.COGS: S.FUTURE_COGS_LAG, S.VOLUME: None}
    seg = fact.groupBy(*keys).agg(
        F.max(S.DATE).alias("_last"), mean(S.VOLUME).alias(S.VOLUME), mean(S.MARKETING).alias(S.MARKETING),
        *[round_stat(F.avg(c), 4).alias(c) for c in (S.CONFIDENCE, S.INFLATION, S.COMPETITOR)],
        *[F.max_by(F.col(c).cast(S.MONEY), S.DATE).alias(f"{c}_lag1") for c in lagged])
    if lag_source == "constant":
        share = F.col(S.VOLUME) * F.lit(S.FUTURE_VOLUME_LAG_SHARE)
        seg = seg.withColumns({f"{c}_lag1": (F.lit(v) if v is not None else share).cast(S.MONEY) for c, v in lagged.items()})
    rows = seg.withColumn(S.DATE, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon)))).drop("_last")
    temp = F.lit(15.0) + F.lit(10.0) * F.sin(F.lit(2.0) * F.pi() * F.dayofyear(S.DATE) / F.lit(365))
    return add_basic_calendar(rows.withColumns({
        S.PROMO: promo_day_rule(F.dayofmonth(S.DATE)), S.HOLIDAY: holiday_rule(S.DATE, S.HOLIDAYS_FORECAST),
        S.TEMPERATURE: F.round(temp.cast("decimal(38,10)"), 6).cast("double")}), S.DATE)


def naive_predictor(rows: DataFrame) -> DataFrame:
    """Predict every target by its lag column."""
    return rows.withColumns({f"predicted_{c}": F.col(f"{c}_lag1") for c in S.DOMAIN_TARGETS.values()})


def generate_forecast(history: DataFrame, models, prep, horizon: int = 30,
                      base_values: Mapping[str, object] | None = None, per_segment: bool = True):
    """Scaffold -> predict -> per-target totals (M10 = M9 -> M8 -> A22).

    Returns (forecast rows, summary).  ``models`` maps target -> PipelineModel,
    ``prep`` is the ``PreparedData`` the models were trained on.
    """
    from .metrics import forecast_totals
    from .models import predict
    grid = future_scaffold(history, prep.date_column, prep.categorical, prep.numerical, prep.targets,
                           horizon, base_values, per_segment)
    rows = predict(grid, models, prep)
    return rows, forecast_totals(rows, prep.date_column)


def comprehensive_forecast(scenario_rows: DataFrame, models, keys: Sequence[str] = S.SEGMENT_KEYS):
    """Domain forecast: score scenario rows, derive the row KPIs and summarise per scenario (M11 -> M12).

    ``scenario_rows`` carries the columns of the 18/16 features for every
    (segment, day), see ``future_rows``.  ``models`` are the three domain
    models or a function that adds the ``predicted_`` columns.  Returns (daily
    KPI rows, one summary row per segment).
    """
    from .kpi import daily_kpis, forecast_summary
    from .models import domain_predict
    scored = models(scenario_rows) if callable(models) else domain_predict(scenario_rows, models)
    daily = daily_kpis(scored, keys=keys, sales=f"predicted_{S.REVENUE}", cogs=f"predicted_{S.COGS}",
                       volume=f"predicted_{S.VOLUME}")
    return daily, forecast_summary(daily, keys)
