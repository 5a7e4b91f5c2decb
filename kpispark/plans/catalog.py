"""Registered queries: name -> Spark plan over the driver tables, plus the
matching DuckDB oracle SQL (``ORACLE``) where one exists.

Every query reads the whole given tables (through ``sales_fact``,
``events_daily`` or a table itself); none runs on fixed input, none samples or
caps rows, other than the top-k reports whose feature that is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.calendar import full_calendar
from ..functions.exprs import clamp0_money, cogs_ratio_pct, round_stat
from ..operators import features, kpi, metrics, rollup
from ..operators.profile import QUARTILES, coerce_numeric, describe, fill_missing_features, profile_frame
from ..sources.testtables import read_table, sales_fact
from . import sql as Q

HOLDOUT_CUT = "2000-01-01"
KEYS = S.SEGMENT_KEYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.daily_kpis(sales_fact(spark, sf_dir))


# ----------------------------------------------------------------- row KPIs
@register("daily_kpi", f"WITH {Q.DAILY_CTE[1:]}\nSELECT {Q.DAILY_OUT} FROM daily")
def daily_kpi(spark, sf_dir):
    return kpi.as_doubles(_daily(spark, sf_dir))


@register("cogs_ratio", f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, "Date",
  {Q.R(Q.safe_div(f"CAST({Q._clamp('COGS_EUR')} AS DOUBLE) * 100", Q._clamp('Net_Sales_Revenue_EUR')))} AS cogs_ratio_pct
FROM fact""")
def cogs_ratio(spark, sf_dir):
    f = sales_fact(spark, sf_dir)
    return f.select(*KEYS, S.DATE, cogs_ratio_pct(clamp0_money(S.REVENUE), clamp0_money(S.COGS)).alias(
        "cogs_ratio_pct"))


def _standalone_sql() -> str:
    s, c, v, m = (Q._clamp(x) for x in ("Net_Sales_Revenue_EUR", "COGS_EUR", "Net_Sales_Volume_Litres",
                                        "Marketing_Spend_EUR"))
    neg = ("(Net_Sales_Revenue_EUR < 0 OR COGS_EUR < 0 OR Net_Sales_Volume_Litres < 0 "
           "OR Marketing_Spend_EUR < 0)")
    k = {
        "gross_profit_eur": Q.R(f"{s} - {c}"),
        "gross_profit_margin_pct": Q.R(f"LEAST(GREATEST({Q.safe_div(f'CAST({s} - {c} AS DOUBLE) * 100', s)}, -100.0), 100.0)"),
        "asp_per_litre_eur": Q.R(Q.safe_div(s, v)),
        "predicted_operating_cash_flow_eur": Q.R(f"{s} - {c} - {m}"),
        "cogs_per_litre": Q.R(Q.safe_div(c, v)),
        "marketing_spend_ratio": Q.R(Q.safe_div(f"CAST({m} AS DOUBLE) * 100", s)),
        "revenue_per_euro_marketing": Q.R(Q.safe_div(s, m)),
        "litres_per_euro_marketing": Q.R(Q.safe_div(v, m)),
        "cogs_ratio_pct": Q.R(Q.safe_div(f"CAST({c} AS DOUBLE) * 100", s)),
    }
    cols = ",\n  ".join(f"CASE WHEN NOT {neg} THEN {e} END AS {n}" for n, e in k.items())
    return f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, "Date", CAST(Net_Sales_Revenue_EUR AS DOUBLE) AS Net_Sales_Revenue_EUR,
  CAST(COGS_EUR AS DOUBLE) AS COGS_EUR, CAST(Net_Sales_Volume_Litres AS DOUBLE) AS Net_Sales_Volume_Litres,
  CAST(Marketing_Spend_EUR AS DOUBLE) AS Marketing_Spend_EUR,
  {cols},
  CASE WHEN {neg} THEN 'rejected: all input values must be non-negative' ELSE 'ok' END AS validation_status
FROM fact"""


@register("kpi_standalone", _standalone_sql())
def kpi_standalone(spark, sf_dir):
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE, S.REVENUE, S.COGS, S.VOLUME, S.MARKETING)
    return kpi.as_doubles(kpi.kpi_standalone(f, S.REVENUE, S.COGS, S.VOLUME, S.MARKETING))


# ---------------------------------------------------------------- summaries
@register("period_totals", f"""WITH {Q.DAILY_CTE[1:]},
t AS (SELECT {Q.KEYS}, {Q.TOTALS} FROM daily GROUP BY {Q.KEYS})
SELECT {Q.KEYS}, total_days, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in [
    'total_sales', 'total_cogs', 'total_volume', 'total_marketing', 'total_gross_profit',
    'total_operating_cash_flow', 'total_revenue_promotional_events', 'total_volume_promotional_events',
    'total_revenue_non_promotional', 'total_volume_non_promotional'])}, promo_days_count, non_promo_days_count
FROM t""")
def period_totals(spark, sf_dir):
    return kpi.as_doubles(kpi.period_totals(_daily(spark, sf_dir)))


@register("promo_impact", f"""WITH {Q.DAILY_CTE[1:]},
t AS (SELECT {Q.KEYS}, {Q.TOTALS} FROM daily GROUP BY {Q.KEYS})
SELECT {Q.KEYS}, {Q.PROMO_COLS}, promo_days_count, non_promo_days_count FROM t""")
def promo_impact(spark, sf_dir):
    return kpi.promo_impact(_daily(spark, sf_dir))


# The calendar comes from the orders: one row per finished order, flagged
# when urgent; days repeat (the last order number wins) and some days are missing.
@register("holiday_lift", f"""WITH {Q.DAILY_CTE[1:]},
cal AS (SELECT CAST(o_orderdate AS DATE) AS _hd, ARG_MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, o_orderkey) AS _hf
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
j AS (SELECT d.* EXCLUDE (holiday_indicator), COALESCE(CAST(cal._hf AS INTEGER), 0) AS holiday_indicator
      FROM daily d LEFT JOIN cal ON d.date = cal._hd),
t AS (SELECT {Q.KEYS}, {Q.HOLIDAY_AGG} FROM j GROUP BY {Q.KEYS})
SELECT {Q.KEYS}, {Q.HOLIDAY_COLS}, holiday_days_count, non_holiday_days_count FROM t""")
def holiday_lift(spark, sf_dir):
    daily = kpi.daily_kpis(sales_fact(spark, sf_dir), holiday=None)
    orders = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    cal = orders.select(F.col("o_orderdate").cast("date").alias(S.DATE), "o_orderkey",
                        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias(S.HOLIDAY))
    return kpi.holiday_lift(kpi.attach_holiday(daily, cal, cal_order="o_orderkey"))


@register("summary_averages", f"""WITH {Q.DAILY_CTE[1:]},
t AS (SELECT {Q.KEYS}, {Q.TOTALS} FROM daily GROUP BY {Q.KEYS})
SELECT {Q.KEYS}, total_days, {Q.AVERAGE_COLS} FROM t""")
def summary_averages(spark, sf_dir):
    return kpi.summary_averages(_daily(spark, sf_dir))


@register("segment_totals", f"""WITH {Q.DAILY_CTE[1:]}
SELECT CASE WHEN GROUPING(Country) = 0 THEN 'Country' WHEN GROUPING(Channel) = 0 THEN 'Channel'
            WHEN GROUPING(Product_Category) = 0 THEN 'Product_Category' END AS dimension,
       CASE WHEN GROUPING(Country) = 0 THEN Country WHEN GROUPING(Channel) = 0 THEN Channel
            WHEN GROUPING(Product_Category) = 0 THEN Product_Category END AS segment_value,
       CAST(SUM(sales_revenue_eur) AS DOUBLE) AS total_sales,
       CAST(SUM(sales_volume_litres) AS DOUBLE) AS total_volume
FROM daily GROUP BY GROUPING SETS ((Country), (Channel), (Product_Category))""")
def segment_totals(spark, sf_dir):
    return kpi.as_doubles(kpi.segment_totals(_daily(spark, sf_dir)))


def _best_sql() -> str:
    cols = []
    rank = {
        "best": "sales_revenue_eur DESC, date ASC",
        "worst": "sales_revenue_eur ASC, date ASC",
        "highest_margin": "gross_profit_margin_pct DESC, date ASC",
    }
    ctes = []
    for name, order in rank.items():
        fields = ", ".join(f"{c if c in (kpi.D_DATE, kpi.D_PROMO) else f'CAST({c} AS DOUBLE)'} AS {name}_{c}"
                           for c in kpi.DAY_FIELDS)
        ctes.append(f"""{name} AS (SELECT {Q.KEYS}, {fields}
 FROM daily QUALIFY ROW_NUMBER() OVER (PARTITION BY {Q.KEYS} ORDER BY {order}) = 1)""")
        cols.append(f"{name}.* EXCLUDE ({Q.KEYS})")
    return (f"WITH {Q.DAILY_CTE[1:]},\n" + ",\n".join(ctes) +
            f"\nSELECT best.{Q.KEYS.replace(', ', ', best.')}, " + ", ".join(cols) +
            " FROM best JOIN worst USING (Country, Channel, Product_Category)"
            " JOIN highest_margin USING (Country, Channel, Product_Category)")


@register("best_worst_day", _best_sql())
def best_worst_day(spark, sf_dir):
    return kpi.best_worst_flat(_daily(spark, sf_dir))


def _summary_sql() -> str:
    totals = ", ".join(f"CAST(ROUND(total_{b}, 2) AS DOUBLE) AS total_{a}" for a, b in [
        ("sales_revenue_eur", "sales"), ("cogs_eur", "cogs"), ("volume_litres", "volume"),
        ("marketing_spend_eur", "marketing"), ("gross_profit_eur", "gross_profit"),
        ("operating_cash_flow_eur", "operating_cash_flow")])
    return f"""WITH {Q.DAILY_CTE[1:]},
t AS (SELECT {Q.KEYS}, MIN(date) AS period_start, MAX(date) AS period_end, {Q.TOTALS}, {Q.HOLIDAY_AGG}
      FROM daily GROUP BY {Q.KEYS})
SELECT {Q.KEYS}, period_start, period_end, total_days, {totals},
  {Q.AVERAGE_COLS},
  {Q.PROMO_COLS}, promo_days_count, non_promo_days_count,
  {Q.HOLIDAY_COLS}, holiday_days_count, non_holiday_days_count
FROM t"""


@register("forecast_summary", _summary_sql())
def forecast_summary(spark, sf_dir):
    return kpi.forecast_summary(_daily(spark, sf_dir), nested=False)


def _summary_full_sql(ctes: str | None = None) -> str:
    """A8 with the three days of A7 (all fields) and the totals of A6 by each of the segment's own values."""
    base = _summary_sql() if ctes is None else _summary_sql().replace(f"WITH {Q.DAILY_CTE[1:]}", f"WITH {ctes}")
    head, body = base.split("\nSELECT ", 1)
    best = _best_sql()
    days = best[best.index(Q.DAILY_CTE[1:]) + len(Q.DAILY_CTE) - 1:].split("\nSELECT ")[0]
    maps = ", ".join(f"{Q.R(f'CAST(total_{m} AS DOUBLE)')} AS {m}_by_{d.lower()}" for d in KEYS for m in ("sales", "volume"))
    using = f"USING ({Q.KEYS})"
    return (f"{head}{days},\nsummary AS (SELECT {body}),\nmaps AS (SELECT {Q.KEYS}, {maps} FROM t)\n"
            f"SELECT * FROM summary JOIN maps {using} JOIN best {using} JOIN worst {using} JOIN highest_margin {using}")


def _flat_summary(s: DataFrame) -> DataFrame:
    """The nested summary with each map's entry of the segment itself and each day's fields as columns."""
    maps = [f"{m}_by_{d.lower()}" for d in KEYS for m in ("sales", "volume")]
    days = {"best_day_sales": "best", "worst_day_sales": "worst", "highest_margin_day": "highest_margin"}
    plain = [c for c in s.columns if c not in maps and c not in days]
    return s.select(*plain, *[F.col(f"{m}_by_{d.lower()}")[F.col(d)].alias(f"{m}_by_{d.lower()}")
                              for d in KEYS for m in ("sales", "volume")],
                    *[F.col(f"{name}.{c}").alias(f"{short}_{c}") for name, short in days.items() for c in kpi.DAY_FIELDS])


@register("forecast_summary_full", _summary_full_sql())
def forecast_summary_full(spark, sf_dir):
    return _flat_summary(kpi.forecast_summary(_daily(spark, sf_dir)))


@register("segment_maps", f"""WITH {Q.DAILY_CTE[1:]},
long AS ({' UNION ALL '.join(f"SELECT Country, '{d}' AS dimension, {d} AS segment_value, sales_revenue_eur AS s, sales_volume_litres AS v FROM daily"
                             for d in KEYS)})
SELECT Country, dimension, segment_value, {Q.R('CAST(SUM(s) AS DOUBLE)')} AS sales, {Q.R('CAST(SUM(v) AS DOUBLE)')} AS volume
FROM long GROUP BY ALL""")
def segment_maps(spark, sf_dir):
    return kpi.segment_map_rows(kpi.segment_maps(_daily(spark, sf_dir), [S.COUNTRY]), [S.COUNTRY])


# ------------------------------------------------------------------ rollups
def _rollup_sql(freq: str, dense: bool = False) -> str:
    pe = ("CAST(DATE_TRUNC('week', date) AS DATE) + 6" if freq == "W" else "LAST_DAY(date)")
    sums = ", ".join(f"SUM({c}) AS {c}" for c in rollup.SUM_COLS)
    means = ", ".join(f"AVG({c}) AS {c}" for c in rollup.MEAN_COLS)
    out_sums = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in rollup.SUM_COLS)
    out_means = ", ".join(f"{Q.RS(c, 4)} AS {c}" for c in rollup.MEAN_COLS)
    base = f"""WITH {Q.DAILY_CTE[1:]},
agg AS (SELECT {Q.KEYS}, {pe} AS period_end, {sums}, {means}, COUNT(*) AS days
        FROM daily GROUP BY {Q.KEYS}, {pe})"""
    if not dense:
        return base + f"\nSELECT {Q.KEYS}, period_end, {out_sums}, {out_means}, days FROM agg"
    step = "INTERVAL 7 DAY" if freq == "W" else "INTERVAL 1 MONTH"
    lo = ("CAST(DATE_TRUNC('week', MIN(date)) AS DATE) + 6" if freq == "W"
          else "CAST(DATE_TRUNC('month', MIN(date)) AS DATE)")
    hi = ("CAST(DATE_TRUNC('week', MAX(date)) AS DATE) + 6" if freq == "W"
          else "CAST(DATE_TRUNC('month', MAX(date)) AS DATE)")
    label = "CAST(g AS DATE)" if freq == "W" else "LAST_DAY(CAST(g AS DATE))"
    fill = ", ".join(f"CAST(COALESCE(agg.{c}, 0) AS DOUBLE) AS {c}" for c in rollup.SUM_COLS)
    return base + f""",
b AS (SELECT {Q.KEYS}, {lo} AS lo, {hi} AS hi FROM daily GROUP BY {Q.KEYS}),
spine AS (SELECT {Q.KEYS}, {label} AS period_end FROM b, generate_series(lo, hi, {step}) AS s(g))
SELECT spine.Country, spine.Channel, spine.Product_Category, spine.period_end, {fill},
  {', '.join(f'{Q.RS("agg." + c, 4)} AS {c}' for c in rollup.MEAN_COLS)}, COALESCE(agg.days, 0) AS days
FROM spine LEFT JOIN agg USING (Country, Channel, Product_Category, period_end)"""


def _round_means(df: DataFrame) -> DataFrame:
    return kpi.as_doubles(df).withColumns({c: round_stat(c, 4) for c in rollup.MEAN_COLS})


@register("weekly_rollup", _rollup_sql("W"))
def weekly_rollup(spark, sf_dir):
    return _round_means(rollup.rollup(_daily(spark, sf_dir), "W"))


@register("monthly_rollup", _rollup_sql("M"))
def monthly_rollup(spark, sf_dir):
    return _round_means(rollup.rollup(_daily(spark, sf_dir), "M"))


@register("weekly_rollup_dense", _rollup_sql("W", dense=True))
def weekly_rollup_dense(spark, sf_dir):
    return _round_means(rollup.dense_rollup(_daily(spark, sf_dir), "W"))


@register("monthly_rollup_dense", _rollup_sql("M", dense=True))
def monthly_rollup_dense(spark, sf_dir):
    return _round_means(rollup.dense_rollup(_daily(spark, sf_dir), "M"))


# ----------------------------------------------------------------- features
def _cal_sql(d: str = '"Date"') -> dict[str, str]:
    """The 11 calendar features (F13) of a date column in SQL."""
    dow = f"(ISODOW({d}) - 1)"
    return {
        "year": f"CAST(YEAR({d}) AS INTEGER)", "month": f"CAST(MONTH({d}) AS INTEGER)",
        "day": f"CAST(DAYOFMONTH({d}) AS INTEGER)", "day_of_week": f"CAST({dow} AS INTEGER)",
        "day_of_year": f"CAST(DAYOFYEAR({d}) AS INTEGER)", "week_of_year": f"CAST(WEEKOFYEAR({d}) AS INTEGER)",
        "quarter": f"CAST(QUARTER({d}) AS INTEGER)",
        "month_sin": Q.RS(f"SIN(2.0 * PI() * MONTH({d}) / 12)", 6),
        "month_cos": Q.RS(f"COS(2.0 * PI() * MONTH({d}) / 12)", 6),
        "day_sin": Q.RS(f"SIN(2.0 * PI() * {dow} / 7)", 6),
        "day_cos": Q.RS(f"COS(2.0 * PI() * {dow} / 7)", 6),
    }


def _calendar_sql() -> str:
    return f"WITH {Q.FACT_CTE[1:]}\nSELECT {Q.KEYS}, \"Date\", " + ", ".join(
        f"{e} AS {n}" for n, e in _cal_sql().items()) + " FROM fact"


@register("calendar_features", _calendar_sql())
def calendar_features(spark, sf_dir):
    f = sales_fact(spark, sf_dir)
    feats = full_calendar(F.col(S.DATE))
    cyc = {"month_sin", "month_cos", "day_sin", "day_cos"}
    return f.select(*KEYS, S.DATE, *[(round_stat(c, 6) if n in cyc else c).alias(n)
                                     for n, c in feats.items()])


FACT_COLS = [S.DATE, *KEYS, S.VOLUME, S.REVENUE, S.COGS, S.MARKETING, S.PROMO, S.CONFIDENCE, S.INFLATION,
             S.TEMPERATURE, S.HOLIDAY, S.COMPETITOR]
MONEY_COLS = [S.VOLUME, S.REVENUE, S.COGS, S.MARKETING]
LAG_TARGETS = [S.REVENUE, S.COGS, S.VOLUME]


def _lag_sql() -> str:
    cols = ", ".join(f"CAST(LAG({t}, {k}) OVER w AS DOUBLE) AS {t}_lag{k}"
                     for t in LAG_TARGETS for k in S.DEFAULT_LAGS)
    return (f"WITH {Q.FACT_CTE[1:]}\nSELECT {Q.KEYS}, \"Date\", {cols} FROM fact "
            f"WINDOW w AS (PARTITION BY {Q.KEYS} ORDER BY \"Date\")")


@register("lag_features", _lag_sql())
def lag_features(spark, sf_dir):
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE, *LAG_TARGETS)
    out = features.lag_features(f, LAG_TARGETS, KEYS, S.DATE, S.DEFAULT_LAGS, strategy="positions")
    return kpi.as_doubles(out.drop(*LAG_TARGETS))


@register("lag_features_window", _lag_sql())
def lag_features_window(spark, sf_dir):
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE, *LAG_TARGETS)
    out = features.lag_features(f, LAG_TARGETS, KEYS, S.DATE, S.DEFAULT_LAGS, strategy="window")
    return kpi.as_doubles(out.drop(*LAG_TARGETS))


@register("lag_features_ungrouped", f"""WITH {Q.FACT_CTE[1:]},
tot AS (SELECT "Date", SUM(Net_Sales_Revenue_EUR) AS total_revenue FROM fact GROUP BY 1)
SELECT "Date", CAST(total_revenue AS DOUBLE) AS total_revenue,
  {', '.join(f'CAST(LAG(total_revenue, {k}) OVER (ORDER BY "Date") AS DOUBLE) AS total_revenue_lag{k}'
             for k in S.DEFAULT_LAGS)}
FROM tot""")
def lag_features_ungrouped(spark, sf_dir):
    tot = sales_fact(spark, sf_dir).groupBy(S.DATE).agg(F.sum(S.REVENUE).alias("total_revenue"))
    out = features.lag_features(tot, ["total_revenue"], [], S.DATE, S.DEFAULT_LAGS, strategy="positions")
    return kpi.as_doubles(out)


@register("date_split", f"""WITH {Q.FACT_CTE[1:]}
SELECT CASE WHEN "Date" < DATE '{HOLDOUT_CUT}' THEN 'train' ELSE 'test' END AS split,
  COUNT(*) AS n_rows, MIN("Date") AS min_date, MAX("Date") AS max_date
FROM fact GROUP BY 1""")
def date_split(spark, sf_dir):
    f = features.label_date_split(sales_fact(spark, sf_dir), HOLDOUT_CUT)
    return features.split_report(f)


@register("positional_split", f"""WITH {Q.FACT_CTE[1:]},
p AS (SELECT {Q.KEYS}, "Date", ROW_NUMBER() OVER (ORDER BY {Q.KEYS}, "Date") - 1 AS position,
             COUNT(*) OVER () AS n FROM fact)
SELECT {Q.KEYS}, "Date", CAST(position AS BIGINT) AS position,
  CASE WHEN position < FLOOR(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM p""")
def positional_split(spark, sf_dir):
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE)
    return features.positional_split(f, [S.DATE], 0.2, KEYS)


# ------------------------------------------------------------------ accuracy
def _scored(spark, sf_dir):
    return metrics.naive_scored(sales_fact(spark, sf_dir))


@register("holdout_metrics", f"""WITH {Q.SCORED_CTE[1:]}
SELECT target, {Q.metric_sql()} FROM scored WHERE date >= DATE '{HOLDOUT_CUT}' GROUP BY target""")
def holdout_metrics(spark, sf_dir):
    return metrics.holdout_metrics(_scored(spark, sf_dir), HOLDOUT_CUT)


def _rolling_cte(w: int = 30, n: int = 5) -> str:
    return f"""WITH {Q.SCORED_CTE[1:]},
mx AS (SELECT MAX(date) AS max_date FROM scored),
sw AS (SELECT s.*, mx.max_date - {w * n} AS start, (s.date - (mx.max_date - {w * n})) AS off
       FROM scored s, mx),
win AS (SELECT *, CAST(FLOOR(off / {float(w)}) AS INTEGER) + 1 AS window_id FROM sw
        WHERE off >= 0 AND off < {w * n}),
per AS (SELECT target, window_id, start + (window_id - 1) * {w} AS window_start,
               start + (window_id - 1) * {w} + {w} AS window_end, {{metrics}}
        FROM win GROUP BY target, window_id, start HAVING COUNT(*) >= {S.ROLLING_MIN_ROWS})"""


@register("rolling_metrics", _rolling_cte().replace("{metrics}", Q.metric_sql()) +
          "\nSELECT * FROM per")
def rolling_metrics(spark, sf_dir):
    return metrics.rolling_metrics(_scored(spark, sf_dir))


@register("rolling_average", _rolling_cte().replace("{metrics}", Q.metric_sql(digits=None)) +
          "\nSELECT target, COUNT(*) AS n_windows, " +
          ", ".join(f"{Q.RS(f'AVG({m})', 4)} AS {m}" for m in Q.METRIC_NAMES) +
          " FROM per GROUP BY target")
def rolling_average(spark, sf_dir):
    return metrics.rolling_average(_scored(spark, sf_dir))


@register("segment_metrics", f"""WITH {Q.SCORED_CTE[1:]},
mx AS (SELECT MAX(date) AS max_date FROM scored),
recent AS (SELECT s.* FROM scored s, mx WHERE s.date >= mx.max_date - {S.SEGMENT_SPAN_DAYS}),
long AS (
  SELECT 'Country' AS segment_type, Country AS segment_value, target, actual, predicted FROM recent
  UNION ALL SELECT 'Channel', Channel, target, actual, predicted FROM recent
  UNION ALL SELECT 'Product_Category', Product_Category, target, actual, predicted FROM recent)
SELECT segment_type, segment_value, target, {Q.metric_sql()}
FROM long GROUP BY segment_type, segment_value, target HAVING COUNT(*) >= {S.SEGMENT_MIN_ROWS}""")
def segment_metrics(spark, sf_dir):
    return metrics.segment_metrics(_scored(spark, sf_dir))


def _rating_sql(mape: str, r2: str) -> str:
    whens = " ".join(f"WHEN {mape} <= {m} AND {r2} >= {r} THEN '{label}'" for m, r, label in S.RATING_BANDS)
    return f"CASE {whens} ELSE '{S.RATING_FALLBACK}' END"


@register("accuracy_rating", f"""WITH {Q.SCORED_CTE[1:]},
h AS (SELECT target, {Q.metric_sql()} FROM scored WHERE date >= DATE '{HOLDOUT_CUT}' GROUP BY target)
SELECT *, {_rating_sql('mape', 'r2')} AS rating FROM h""")
def accuracy_rating(spark, sf_dir):
    return metrics.accuracy_rating(metrics.holdout_metrics(_scored(spark, sf_dir), HOLDOUT_CUT))


def _recs_sql() -> str:
    g = ", ".join(f"MAX(CASE WHEN target = '{t}' THEN {m} END) AS {t}_{m}"
                  for t in metrics.TARGET_ORDER for m in ("mape", "r2", "bias_pct"))
    rules = [
        (f"sales_mape > {S.REC_MAPE_LIMIT}", S.REC_SALES_MAPE),
        (f"cogs_mape > {S.REC_MAPE_LIMIT}", S.REC_COGS_MAPE),
        (f"volume_mape > {S.REC_MAPE_LIMIT}", S.REC_VOLUME_MAPE),
        (f"(sales_r2 < {S.REC_R2_LIMIT} OR cogs_r2 < {S.REC_R2_LIMIT})", S.REC_SALES_COGS_R2),
        (f"volume_r2 < {S.REC_R2_LIMIT}", S.REC_VOLUME_R2),
        (f"ABS(sales_bias_pct) > {S.REC_BIAS_LIMIT}", S.REC_SALES_BIAS),
        (f"ABS(cogs_bias_pct) > {S.REC_BIAS_LIMIT}", S.REC_COGS_BIAS),
        (f"ABS(volume_bias_pct) > {S.REC_BIAS_LIMIT}", S.REC_VOLUME_BIAS),
    ] + [("TRUE", t) for t in S.REC_GENERAL]
    items = "\n  UNION ALL ".join(f"SELECT {i} AS ord, '{t}' AS txt FROM g WHERE COALESCE({c}, FALSE)"
                                  for i, (c, t) in enumerate(rules))
    return f"""WITH {Q.SCORED_CTE[1:]},
h AS (SELECT target, {Q.metric_sql(digits=None)} FROM scored WHERE date >= DATE '{HOLDOUT_CUT}' GROUP BY target),
g AS (SELECT {g} FROM h),
items AS ({items})
SELECT CAST(ROW_NUMBER() OVER (ORDER BY ord) AS INTEGER) AS rec_no, txt AS recommendation
FROM items QUALIFY rec_no <= {S.REC_LIMIT}"""


@register("recommendations", _recs_sql())
def recommendations(spark, sf_dir):
    return metrics.recommendations(metrics.holdout_metrics(_scored(spark, sf_dir), HOLDOUT_CUT, digits=None))


@register("best_model", f"""WITH {Q.CANDIDATES_CTE[1:]},
m AS (SELECT target, model, model_order, {Q.metric_sql(digits=None)}
      FROM cands WHERE date >= DATE '{HOLDOUT_CUT}' GROUP BY target, model, model_order),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY r2 DESC NULLS LAST, model_order) AS rank FROM m)
SELECT target, model, model_order, n, {', '.join(f'{Q.RS(c, 4)} AS {c}' for c in ['mae', 'rmse', 'r2', 'mape'])},
  CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best FROM r""")
def best_model(spark, sf_dir):
    c = metrics.candidate_scored(sales_fact(spark, sf_dir))
    return metrics.rounded(metrics.candidate_metrics(c, HOLDOUT_CUT), 4, ["mae", "rmse", "r2", "mape"])


@register("detailed_predictions", f"""WITH {Q.SCORED_CTE[1:]}
SELECT date, {Q.KEYS}, target, {Q.R('actual')} AS actual, {Q.R('predicted')} AS predicted,
  {Q.R('actual - predicted')} AS error,
  {Q.R('CASE WHEN CAST(actual AS DOUBLE) <> 0 THEN CAST(actual - predicted AS DOUBLE) / CAST(actual AS DOUBLE) * 100 END')}
    AS error_pct
FROM scored WHERE date >= DATE '{HOLDOUT_CUT}'""")
def detailed_predictions(spark, sf_dir):
    return metrics.detailed_predictions(_scored(spark, sf_dir), HOLDOUT_CUT)


@register("prediction_summary", f"""WITH {Q.SCORED_CTE[1:]}
SELECT target, {Q.RS('AVG(CAST(predicted AS DOUBLE))', 4)} AS mean, MIN(CAST(predicted AS DOUBLE)) AS min,
  MAX(CAST(predicted AS DOUBLE)) AS max, {Q.RS('STDDEV_SAMP(CAST(predicted AS DOUBLE))', 4)} AS std
FROM scored GROUP BY target""")
def prediction_summary(spark, sf_dir):
    out = metrics.prediction_summary(_scored(spark, sf_dir))
    return out.withColumns({"mean": round_stat("mean", 4), "std": round_stat("std", 4)})


# ------------------------------------------------------------------ profile
DESCRIBE_COLS = [S.VOLUME, S.REVENUE, S.COGS, S.MARKETING, S.CONFIDENCE, S.INFLATION, S.TEMPERATURE,
                 S.COMPETITOR]


def _quartile_sql(q: float) -> str:
    at = f"CAST({q!r} AS DOUBLE) * (n - 1)"
    low, high = (f"MAX(CASE WHEN pos = {fn}({at}) THEN v END)" for fn in ("FLOOR", "CEIL"))
    return f"{low} + ({high} - {low}) * (MAX({at}) - FLOOR(MAX({at})))"


@register("describe", f"""WITH {Q.FACT_CTE[1:]},
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM fact"
                             for c in DESCRIBE_COLS)}),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY v) - 1 AS pos,
                  COUNT(*) OVER (PARTITION BY column_name) AS n FROM long WHERE v IS NOT NULL)
SELECT column_name, COUNT(v) AS count, {Q.RS('AVG(v)', 4)} AS mean, {Q.RS('STDDEV_SAMP(v)', 4)} AS std,
  MIN(v) AS min, MAX(v) AS max,
  {', '.join(f"{Q.RS(_quartile_sql(q), 4)} AS {name}" for q, name in QUARTILES)}
FROM placed GROUP BY column_name""")
def describe_fact(spark, sf_dir):
    out = describe(sales_fact(spark, sf_dir), DESCRIBE_COLS)
    return out.withColumns({c: round_stat(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


def _profile_sql(cols: dict[str, str], ctes: str, table: str) -> str:
    """Roles of a table's columns (name -> SQL column) by the profiling rules, over all rows."""
    formats = "['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%m/%d/%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']"
    parts = []
    for i, (name, c) in enumerate(cols.items()):
        parts.append(f"""SELECT {i} AS ord, '{name}' AS column_name, ANY_VALUE(TYPEOF({c})) AS t, COUNT(DISTINCT {c}) AS d,
  COUNT({c}) > 0 AND COUNT({c}) = COUNT(TRY_STRPTIME(CAST({c} AS VARCHAR), {formats})) AS parses FROM {table}""")
    keywords = " OR ".join(f"CONTAINS(LOWER(column_name), '{k}')" for k in S.TARGET_KEYWORDS)
    return f"""WITH {ctes}
raw AS ({' UNION ALL '.join(parts)}),
typed AS (SELECT *, CASE WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'INTEGER' THEN 'int' WHEN t = 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE LOWER(t) END AS data_type FROM raw),
roles AS (SELECT *, CASE WHEN data_type IN ('date', 'timestamp_ntz') OR CONTAINS(LOWER(column_name), 'date')
    OR (data_type = 'string' AND parses) THEN 'date'
  WHEN data_type IN ('int', 'bigint', 'double') OR data_type LIKE 'decimal%' THEN 'numerical'
  WHEN data_type = 'string' OR d < {S.CATEGORICAL_MAX_DISTINCT} THEN 'categorical' ELSE 'ignored' END AS role FROM typed)
SELECT column_name, data_type, role, role = 'numerical' AND ({keywords}) AS potential_target,
  role = 'date' AND ord = MAX(CASE WHEN role = 'date' THEN ord END) OVER () AS is_date_column FROM roles"""


@register("profile", _profile_sql({c: f'"{c}"' for c in FACT_COLS}, f"{Q.FACT_CTE[1:]},", "fact"))
def profile_fact(spark, sf_dir):
    return profile_frame(sales_fact(spark, sf_dir))


# ----------------------------------------------------------- drivers, ROMI
def _sens_sql() -> str:
    def corr(x, y):
        return (f"{Q.RS(f'CASE WHEN STDDEV_POP(CAST({x} AS DOUBLE)) > 0 AND STDDEV_POP(CAST({y} AS DOUBLE)) > 0 '
                       f'THEN CORR(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) END', 4)}")
    t, v = "CAST(Avg_Temp_C AS DOUBLE)", "CAST(Net_Sales_Volume_Litres AS DOUBLE)"
    return f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, COUNT(*) AS n_days,
  {corr('Competitor_Activity_Index', 'Net_Sales_Revenue_EUR')} AS competitor_sensitivity,
  {corr('Inflation_Rate_EUR', 'Net_Sales_Revenue_EUR')} AS inflation_sensitivity,
  {corr('Consumer_Confidence_Index', 'Net_Sales_Revenue_EUR')} AS confidence_sensitivity,
  {corr('Avg_Temp_C', 'Net_Sales_Volume_Litres')} AS temperature_volume_corr,
  {Q.RS(f'CASE WHEN STDDEV_POP({t}) > 0 THEN REGR_SLOPE({v}, {t}) END', 4)} AS temperature_volume_slope,
  {Q.RS(f'CASE WHEN STDDEV_POP({t}) > 0 THEN REGR_INTERCEPT({v}, {t}) END', 4)} AS temperature_volume_intercept,
  {Q.RS(f'CASE WHEN STDDEV_POP({t}) > 0 AND STDDEV_POP({v}) > 0 THEN REGR_R2({v}, {t}) END', 4)} AS temperature_volume_r2
FROM fact GROUP BY {Q.KEYS}"""


@register("sensitivity", _sens_sql())
def sensitivity(spark, sf_dir):
    return kpi.sensitivity(sales_fact(spark, sf_dir))


@register("romi", f"""WITH {Q.FACT_CTE[1:]},
a AS (SELECT {Q.KEYS}, CAST(COUNT_IF(Marketing_Spend_EUR > 0) AS BIGINT) AS days_with_marketing,
        CAST(COUNT_IF(NOT (Marketing_Spend_EUR > 0)) AS BIGINT) AS days_without_marketing,
        SUM(CASE WHEN Marketing_Spend_EUR > 0 THEN Net_Sales_Revenue_EUR END) AS _sw,
        SUM(CASE WHEN NOT (Marketing_Spend_EUR > 0) THEN Net_Sales_Revenue_EUR END) AS _so,
        SUM(Marketing_Spend_EUR) AS total_marketing
      FROM fact GROUP BY {Q.KEYS}),
b AS (SELECT *, (CAST(_sw AS DOUBLE) / days_with_marketing - CAST(_so AS DOUBLE) / days_without_marketing)
                * days_with_marketing AS incr,
             days_with_marketing > 0 AND days_without_marketing > 0 AND total_marketing > 0 AS valid FROM a)
SELECT {Q.KEYS}, days_with_marketing, days_without_marketing,
  CASE WHEN valid THEN incr END AS incremental_sales,
  CASE WHEN valid THEN incr / CAST(total_marketing AS DOUBLE) END AS romi
FROM b""")
def romi(spark, sf_dir):
    return kpi.romi(sales_fact(spark, sf_dir))


@register("basic_cards", f"""WITH {Q.DAILY_CTE[1:]}
SELECT {Q.KEYS}, CAST(SUM(sales_revenue_eur) AS DOUBLE) AS total_sales_revenue,
  CAST(SUM(gross_profit_eur) AS DOUBLE) AS total_gross_profit,
  {Q.RS('AVG(gross_profit_margin_pct)', 4)} AS avg_gross_margin_pct,
  CAST(SUM(predicted_operating_cash_flow_eur) AS DOUBLE) AS total_operating_cash_flow
FROM daily GROUP BY {Q.KEYS}""")
def basic_cards(spark, sf_dir):
    out = kpi.as_doubles(kpi.basic_cards(_daily(spark, sf_dir)))
    return out.withColumn("avg_gross_margin_pct", round_stat("avg_gross_margin_pct", 4))


def _sum_all_sql(freq: str) -> str:
    pe = ("CAST(DATE_TRUNC('week', date) AS DATE) + 6" if freq == "W" else "LAST_DAY(date)")
    money = ["sales_revenue_eur", "cogs_eur", "sales_volume_litres", "marketing_spend_eur",
             "gross_profit_eur", "predicted_operating_cash_flow_eur"]
    ratios = ["gross_profit_margin_pct", "asp_per_litre_eur", "cogs_per_litre", "marketing_spend_ratio",
              "revenue_per_euro_marketing", "litres_per_euro_marketing"]
    cols = [f"CAST(SUM({c}) AS DOUBLE) AS {c}" for c in money]
    cols += [f"{Q.RS(f'SUM({c})', 4)} AS {c}" for c in ratios]
    cols += ["CAST(SUM(CAST(promotional_event AS INTEGER)) AS BIGINT) AS promotional_event",
             "CAST(SUM(holiday_indicator) AS BIGINT) AS holiday_indicator"]
    return (f"WITH {Q.DAILY_CTE[1:]}\nSELECT {Q.KEYS}, {pe} AS period_end, " + ", ".join(cols) +
            f" FROM daily GROUP BY {Q.KEYS}, {pe}")


@register("monthly_sum_all", _sum_all_sql("M"))
def monthly_sum_all(spark, sf_dir):
    out = kpi.as_doubles(rollup.rollup_sum_all(_daily(spark, sf_dir), "M"))
    ratios = ["gross_profit_margin_pct", "asp_per_litre_eur", "cogs_per_litre", "marketing_spend_ratio",
              "revenue_per_euro_marketing", "litres_per_euro_marketing"]
    return out.withColumns({c: round_stat(c, 4) for c in ratios})


@register("weekly_sum_all", _sum_all_sql("W"))
def weekly_sum_all(spark, sf_dir):
    out = kpi.as_doubles(rollup.rollup_sum_all(_daily(spark, sf_dir), "W"))
    ratios = ["gross_profit_margin_pct", "asp_per_litre_eur", "cogs_per_litre", "marketing_spend_ratio",
              "revenue_per_euro_marketing", "litres_per_euro_marketing"]
    return out.withColumns({c: round_stat(c, 4) for c in ratios})


# ---------------------------------------------------------------- scaffold
SCAFFOLD_HORIZON = 30


def _fact_profile_lists():
    """Feature lists the generic engine derives for the fact (P4 -> M7)."""
    numeric = [S.VOLUME, S.REVENUE, S.COGS, S.MARKETING, S.PROMO, S.CONFIDENCE, S.INFLATION,
               S.TEMPERATURE, S.HOLIDAY, S.COMPETITOR]
    targets = [c for c in numeric if any(k in c.lower() for k in S.TARGET_KEYWORDS)][:3]
    feats = [c for c in numeric if c not in targets] + list(S.TIME_FEATURES) + [
        f"{t}_lag{k}" for t in targets for k in S.DEFAULT_LAGS]
    return targets, feats


def _scaffold_sql() -> str:
    from ..operators.forecast import scaffold_default
    targets, feats = _fact_profile_lists()
    consts = []
    for c in feats:
        v = scaffold_default(c, targets)
        if v is not None:
            consts.append(f"CAST({v!r} AS DOUBLE) AS {c}")
    cal = _cal_sql()
    return f"""WITH {Q.FACT_CTE[1:]},
st AS (SELECT MAX("Date") + 1 AS s FROM fact),
days AS (SELECT CAST(g AS DATE) AS "Date" FROM st, generate_series(s, s + {SCAFFOLD_HORIZON - 1}, INTERVAL 1 DAY) AS t(g)),
segs AS (SELECT DISTINCT {Q.KEYS} FROM fact)
SELECT days."Date", {Q.KEYS}, {', '.join(consts)}, {', '.join(f'{e} AS {n}' for n, e in cal.items())}
FROM days CROSS JOIN segs"""


@register("future_scaffold", _scaffold_sql())
def future_scaffold(spark, sf_dir):
    from ..operators.forecast import future_scaffold as scaffold
    targets, feats = _fact_profile_lists()
    out = scaffold(sales_fact(spark, sf_dir), S.DATE, KEYS, feats, targets, SCAFFOLD_HORIZON)
    cyc = ["month_sin", "month_cos", "day_sin", "day_cos"]
    return out.withColumns({c: round_stat(c, 6) for c in cyc})


# ------------------------------------------------------------------ models
# Predicted values depend on the tree learner, so the queries that return them
# have no SQL oracle; what is determined without it has one below.
_FITTED: dict[tuple[str, str], dict] = {}


def _domain_models(spark, sf_dir):
    """The three domain models (100 rounds), trained once per session and table folder."""
    from ..operators import models
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        frame = models.domain_feature_frame(sales_fact(spark, sf_dir))
        _FITTED[key] = models.train_domain_models(frame, HOLDOUT_CUT)
    return _FITTED[key]


@register("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    from ..operators import models
    frame = models.domain_feature_frame(sales_fact(spark, sf_dir))
    test = frame.filter(F.col(S.DATE) >= F.to_date(F.lit(HOLDOUT_CUT)))
    pred = models.domain_predict(test, _domain_models(spark, sf_dir))
    cols = [c for t in S.DOMAIN_TARGETS.values() for c in (t, f"predicted_{t}")]
    return kpi.as_doubles(pred.select(*KEYS, S.DATE, *cols))


@register("comprehensive_forecast")
def comprehensive_forecast(spark, sf_dir):
    from ..operators import forecast
    rows = kpi.as_doubles(forecast.future_rows(sales_fact(spark, sf_dir), SCAFFOLD_HORIZON))
    _, summary = forecast.comprehensive_forecast(rows, _domain_models(spark, sf_dir))
    return _flat_summary(summary)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    from ..operators import models
    return models.feature_importance(_domain_models(spark, sf_dir)["sales"], sales_fact(spark, sf_dir))


@register("model_selection")
def model_selection(spark, sf_dir):
    from ..operators import models
    prep = models.prepare_data(sales_fact(spark, sf_dir), group_cols=KEYS)
    return models.train_models(prep, test_size=0.2, method="positional").metrics


def _unseen(c: str) -> str:
    """A tenth of the days has a country that training never saw."""
    return f"CASE WHEN DAYOFMONTH(\"Date\") % 10 = 0 THEN 'elsewhere' ELSE {c} END"


@register("one_hot_features", f"""WITH {Q.FACT_CTE[1:]},
tr AS (SELECT * FROM fact WHERE "Date" < DATE '{HOLDOUT_CUT}'),
te AS (SELECT "Date", {_unseen('Country')} AS Country, Channel, Product_Category FROM fact WHERE "Date" >= DATE '{HOLDOUT_CUT}'),
{', '.join(f"""l{i} AS (SELECT {c}, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) - 1 AS slot FROM tr GROUP BY {c})"""
           for i, c in enumerate(KEYS))}
SELECT te."Date", te.Country, te.Channel, te.Product_Category,
  {', '.join(f"CAST(COALESCE(l{i}.slot, -1) AS INTEGER) AS {c.lower()}_slot" for i, c in enumerate(KEYS))},
  {', '.join(f"CAST((SELECT COUNT(*) FROM l{i}) AS INTEGER) AS {c.lower()}_slots" for i, c in enumerate(KEYS))}
FROM te {' '.join(f"LEFT JOIN l{i} ON l{i}.{c} = te.{c}" for i, c in enumerate(KEYS))}""")
def one_hot_features(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from ..operators import models
    f = sales_fact(spark, sf_dir).select(S.DATE, *KEYS)
    train, test = features.date_split(f, HOLDOUT_CUT)
    test = test.withColumn(S.COUNTRY, F.when(F.dayofmonth(S.DATE) % 10 == 0, "elsewhere").otherwise(F.col(S.COUNTRY)))
    stages, _ = models.preprocessing_stages([], KEYS, "_m")
    out = Pipeline(stages=stages).fit(train).transform(test)
    ones = {c: vector_to_array(f"_m__{c}_ohe") for c in KEYS}
    return out.select(S.DATE, *KEYS, *[(F.array_position(v, 1.0) - 1).cast("int").alias(f"{c.lower()}_slot") for c, v in ones.items()],
                      *[F.size(v).alias(f"{c.lower()}_slots") for c, v in ones.items()])


DOMAIN_NUMERIC = [c for c in S.SALES_FEATURES if c not in KEYS]


@register("feature_slots", f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte([1])},
tr AS (SELECT * FROM lagged WHERE "Date" < DATE '{HOLDOUT_CUT}' AND Net_Sales_Revenue_EUR_lag1 IS NOT NULL
         AND COGS_EUR_lag1 IS NOT NULL AND Net_Sales_Volume_Litres_lag1 IS NOT NULL),
named AS ({' UNION ALL '.join(f"SELECT 0 AS part, {i} AS ord, '{c}' AS feature" for i, c in enumerate(DOMAIN_NUMERIC))}
  {' '.join(f"UNION ALL SELECT {i + 1}, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}), '{c}_' || {c} FROM tr GROUP BY {c}"
            for i, c in enumerate(KEYS))})
SELECT CAST(ROW_NUMBER() OVER (ORDER BY part, ord) - 1 AS INTEGER) AS slot, feature FROM named""")
def feature_slots(spark, sf_dir):
    from pyspark.ml import Pipeline

    from ..operators import models
    frame = models.domain_feature_frame(sales_fact(spark, sf_dir))
    train = features.date_split(frame, HOLDOUT_CUT)[0]
    stages, _ = models.preprocessing_stages(DOMAIN_NUMERIC, KEYS, "_m")
    names = models.slot_names(Pipeline(stages=stages).fit(train).stages)
    return spark.createDataFrame(list(enumerate(names)), "slot int, feature string")


# ------------------------------------------------------- future rows
def _future_cte(lag_source: str) -> str:
    def mean(c):
        return f"CAST({Q.R(f'CAST(SUM({c}) AS DOUBLE) / COUNT({c})')} AS DECIMAL(24,6))"
    lags = {c: f"ARG_MAX({c}, \"Date\")" for c in LAG_TARGETS}
    if lag_source == "constant":
        lags = {S.REVENUE: f"CAST({S.FUTURE_REVENUE_LAG} AS DECIMAL(24,6))", S.COGS: f"CAST({S.FUTURE_COGS_LAG} AS DECIMAL(24,6))",
                S.VOLUME: f"CAST(CAST({mean(S.VOLUME)} AS DOUBLE) * CAST({S.FUTURE_VOLUME_LAG_SHARE} AS DOUBLE) AS DECIMAL(24,6))"}
    return f"""seg AS (SELECT {Q.KEYS}, MAX("Date") AS _last, {mean(S.VOLUME)} AS {S.VOLUME}, {mean(S.MARKETING)} AS {S.MARKETING},
  {', '.join(f"{Q.RS(f'AVG({c})', 4)} AS {c}" for c in (S.CONFIDENCE, S.INFLATION, S.COMPETITOR))},
  {', '.join(f"{e} AS {c}_lag1" for c, e in lags.items())} FROM fact GROUP BY {Q.KEYS}),
days AS (SELECT seg.*, _last + CAST(i AS INTEGER) AS "Date" FROM seg, generate_series(1, {SCAFFOLD_HORIZON}) AS g(i)),
future AS (SELECT * EXCLUDE (_last),
  CASE WHEN DAYOFMONTH("Date") % 7 = 0 OR DAYOFMONTH("Date") % 15 = 0 THEN 1 ELSE 0 END AS Promotional_Event,
  CASE WHEN MONTH("Date") = 12 AND DAYOFMONTH("Date") = 25 THEN 1 ELSE 0 END AS Holiday_Indicator,
  CAST(ROUND(CAST(15.0 + 10.0 * SIN(2.0 * PI() * DAYOFYEAR("Date") / 365) AS DECIMAL(38,10)), 6) AS DOUBLE) AS Avg_Temp_C,
  {', '.join(f"{_cal_sql()[c]} AS {c}" for c in ("day_of_week", "month", "year", "day_of_year", "week_of_year"))} FROM days)"""


FUTURE_MONEY = [S.VOLUME, S.MARKETING, *[f"{c}_lag1" for c in LAG_TARGETS]]


def _future_sql(lag_source: str) -> str:
    out = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FUTURE_MONEY)
    return (f"WITH {Q.FACT_CTE[1:]},\n{_future_cte(lag_source)}\nSELECT * EXCLUDE ({', '.join(FUTURE_MONEY)}), {out} FROM future")


@register("future_rows", _future_sql("last_observed"))
def future_rows(spark, sf_dir):
    from ..operators import forecast
    return kpi.as_doubles(forecast.future_rows(sales_fact(spark, sf_dir), SCAFFOLD_HORIZON))


@register("future_rows_constant", _future_sql("constant"))
def future_rows_constant(spark, sf_dir):
    from ..operators import forecast
    return kpi.as_doubles(forecast.future_rows(sales_fact(spark, sf_dir), SCAFFOLD_HORIZON, "constant"))


def _naive_forecast_sql() -> str:
    daily = Q.DAILY_CTE[len(Q.FACT_CTE):].replace("FROM fact", "FROM scored").strip().lstrip(",")
    scored = f"""scored AS (SELECT {Q.KEYS}, "Date", Promotional_Event, Holiday_Indicator, Marketing_Spend_EUR,
  Net_Sales_Revenue_EUR_lag1 AS Net_Sales_Revenue_EUR, COGS_EUR_lag1 AS COGS_EUR,
  Net_Sales_Volume_Litres_lag1 AS Net_Sales_Volume_Litres FROM future)"""
    return _summary_full_sql(f"{Q.FACT_CTE[1:]},\n{_future_cte('last_observed')},\n{scored},\n{daily}")


@register("naive_comprehensive_forecast", _naive_forecast_sql())
def naive_comprehensive_forecast(spark, sf_dir):
    from ..operators import forecast
    rows = forecast.future_rows(sales_fact(spark, sf_dir), SCAFFOLD_HORIZON)
    return _flat_summary(forecast.comprehensive_forecast(rows, forecast.naive_predictor)[1])


# ------------------------------------------------- generic preparation (M7)
def _prepared_sql() -> str:
    targets, _ = _fact_profile_lists()
    lags = [f"{t}_lag{k}" for t in targets for k in S.DEFAULT_LAGS]
    lag_exprs = ", ".join(f"LAG({t}, {k}) OVER w AS {t}_lag{k}" for t in targets for k in S.DEFAULT_LAGS)
    cols = [f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY_COLS else c for c in FACT_COLS]
    cols += [f"{e} AS {n}" for n, e in _cal_sql().items()]
    cols += [f"CAST({c} AS DOUBLE) AS {c}" for c in lags]
    return f"""WITH {Q.FACT_CTE[1:]},
p AS (SELECT *, {lag_exprs} FROM fact WINDOW w AS (PARTITION BY {Q.KEYS} ORDER BY "Date"))
SELECT {', '.join(cols)} FROM p WHERE {' AND '.join(f'{c} IS NOT NULL' for c in lags)}"""


@register("prepared_data", _prepared_sql())
def prepared_data(spark, sf_dir):
    from ..operators import models
    prep = models.prepare_data(sales_fact(spark, sf_dir))
    cyc = ["month_sin", "month_cos", "day_sin", "day_cos"]
    return kpi.as_doubles(prep.data).withColumns({c: round_stat(c, 6) for c in cyc})


@register("sample_tail", f"""WITH {Q.FACT_CTE[1:]}
SELECT "Date", {Q.KEYS}, CAST(Net_Sales_Revenue_EUR AS DOUBLE) AS Net_Sales_Revenue_EUR FROM fact
ORDER BY "Date" DESC, Country DESC, Channel DESC, Product_Category DESC LIMIT 30""")
def sample_tail(spark, sf_dir):
    f = sales_fact(spark, sf_dir).select(S.DATE, *KEYS, S.REVENUE)
    return kpi.as_doubles(metrics.last_rows(f, 30, [S.DATE, *KEYS]))


def _prepared_tail_sql() -> str:
    targets, _ = _fact_profile_lists()
    lags = [f"{t}_lag{k}" for t in targets for k in S.DEFAULT_LAGS]
    lag_exprs = ", ".join(f"LAG({t}, {k}) OVER w AS {t}_lag{k}" for t in targets for k in S.DEFAULT_LAGS)
    return f"""WITH {Q.FACT_CTE[1:]},
p AS (SELECT *, {lag_exprs} FROM fact WINDOW w AS (PARTITION BY {Q.KEYS} ORDER BY "Date"))
SELECT "Date", {Q.KEYS}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in [S.REVENUE, *lags])} FROM p
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in lags)}
ORDER BY Country DESC, Channel DESC, Product_Category DESC, "Date" DESC LIMIT 30"""


@register("prepared_tail", _prepared_tail_sql())
def prepared_tail(spark, sf_dir):
    """The last rows of the prepared frame, which is in segment-then-date order."""
    targets, _ = _fact_profile_lists()
    f = sales_fact(spark, sf_dir).select(S.DATE, *KEYS, *targets)
    data = features.drop_incomplete(features.lag_features(f, targets, KEYS, S.DATE, S.DEFAULT_LAGS, strategy="window"))
    lags = [f"{t}_lag{k}" for t in targets for k in S.DEFAULT_LAGS]
    return kpi.as_doubles(metrics.last_rows(data, 30, [*KEYS, S.DATE]).select(S.DATE, *KEYS, S.REVENUE, *lags))


# Signed and missing inputs (P16, F1, F7): account balances go below zero, and
# customers without orders have no volume.
_ACCOUNTS = """acc AS (SELECT c_custkey, CAST(ANY_VALUE(c_acctbal) AS DOUBLE) AS sales, CAST(ANY_VALUE(c_acctbal) * 0.5 AS DOUBLE) AS cogs,
  CAST(COUNT(o_orderkey) AS DOUBLE) * CASE WHEN COUNT(o_orderkey) = 0 THEN NULL ELSE 1 END AS volume,
  CAST(100 AS DOUBLE) AS marketing
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""


def _accounts(spark, sf_dir) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("volume"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("sales"),
                                                     (F.col("c_acctbal") * 0.5).alias("cogs"))
    return c.join(orders, c.c_custkey == orders.o_custkey, "left").select(
        "c_custkey", "sales", "cogs", "volume", F.lit(100.0).alias("marketing"))


@register("account_rejects", f"""WITH {_ACCOUNTS}
SELECT c_custkey, sales, cogs, volume, marketing FROM acc WHERE sales < 0 OR cogs < 0 OR volume < 0 OR marketing < 0""")
def account_rejects(spark, sf_dir):
    return kpi.kpi_rejects(_accounts(spark, sf_dir), ["sales", "cogs", "volume", "marketing"])


def _account_kpis_sql() -> str:
    s, c, v, m = (f"(CASE WHEN {x} > 0 THEN {x} ELSE CAST(0 AS DOUBLE) END)" for x in ("sales", "cogs", "volume", "marketing"))
    bad = "COALESCE(sales < 0, FALSE) OR COALESCE(cogs < 0, FALSE) OR COALESCE(volume < 0, FALSE) OR COALESCE(marketing < 0, FALSE)"
    k = {
        "gross_profit_eur": Q.R(f"{s} - {c}"),
        "gross_profit_margin_pct": Q.R(f"LEAST(GREATEST({Q.safe_div(f'({s} - {c}) * 100', s)}, -100.0), 100.0)"),
        "asp_per_litre_eur": Q.R(Q.safe_div(s, v)), "predicted_operating_cash_flow_eur": Q.R(f"{s} - {c} - {m}"),
        "cogs_per_litre": Q.R(Q.safe_div(c, v)), "marketing_spend_ratio": Q.R(Q.safe_div(f"{m} * 100", s)),
        "revenue_per_euro_marketing": Q.R(Q.safe_div(s, m)), "litres_per_euro_marketing": Q.R(Q.safe_div(v, m)),
        "cogs_ratio_pct": Q.R(Q.safe_div(f"{c} * 100", s)),
    }
    return f"""WITH {_ACCOUNTS}
SELECT c_custkey, sales, cogs, volume, marketing, {', '.join(f'CASE WHEN NOT ({bad}) THEN {e} END AS {n}' for n, e in k.items())},
  CASE WHEN {bad} THEN 'rejected: all input values must be non-negative' ELSE 'ok' END AS validation_status FROM acc"""


@register("account_kpis", _account_kpis_sql())
def account_kpis(spark, sf_dir):
    return kpi.kpi_standalone(_accounts(spark, sf_dir), "sales", "cogs", "volume", "marketing")


@register("kpi_rejects", f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, "Date", {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in MONEY_COLS)} FROM fact
WHERE {' OR '.join(f'{c} < 0' for c in MONEY_COLS)}""")
def kpi_rejects(spark, sf_dir):
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE, *MONEY_COLS)
    return kpi.as_doubles(kpi.kpi_rejects(f, MONEY_COLS))


def _console_recs_sql() -> str:
    g = ", ".join(f"MAX(CASE WHEN target = '{t}' THEN {m} END) AS {t}_{m}"
                  for t in metrics.TARGET_ORDER for m in ("mape", "r2"))
    lim, r2 = S.REC_MAPE_LIMIT, S.REC_R2_LIMIT
    rules = [(f"sales_mape > {lim}", S.CONSOLE_SALES_MAPE), (f"cogs_mape > {lim}", S.CONSOLE_COGS_MAPE),
             (f"volume_mape > {lim}", S.CONSOLE_VOLUME_MAPE),
             (f"(sales_r2 < {r2} OR cogs_r2 < {r2} OR volume_r2 < {r2})", S.CONSOLE_ANY_R2)]
    rules += [("TRUE", t) for t in S.CONSOLE_GENERAL]
    items = "\n  UNION ALL ".join(f"SELECT {i} AS ord, '{t}' AS txt FROM g WHERE COALESCE({c}, FALSE)"
                                  for i, (c, t) in enumerate(rules))
    return f"""WITH {Q.SCORED_CTE[1:]},
h AS (SELECT target, {Q.metric_sql(digits=None)} FROM scored WHERE date >= DATE '{HOLDOUT_CUT}' GROUP BY target),
g AS (SELECT {g} FROM h),
items AS ({items})
SELECT CAST(ROW_NUMBER() OVER (ORDER BY ord) AS INTEGER) AS rec_no, txt AS recommendation
FROM items QUALIFY rec_no <= {S.REC_LIMIT}"""


@register("recommendations_console", _console_recs_sql())
def recommendations_console(spark, sf_dir):
    h = metrics.holdout_metrics(_scored(spark, sf_dir), HOLDOUT_CUT, digits=None)
    return metrics.recommendations(h, variant="console")


# ------------------------------------------------------ the events series
@register("events_weekly", """WITH d AS (
  SELECT CAST(ts AS DATE) AS date, event_type, COUNT(*) AS event_count,
         CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DECIMAL(24,6)) AS value_amount
  FROM events GROUP BY 1, 2)
SELECT event_type, CAST(DATE_TRUNC('week', date) AS DATE) + 6 AS period_end,
  CAST(SUM(event_count) AS BIGINT) AS event_count, CAST(SUM(value_amount) AS DOUBLE) AS value_amount,
  """ + Q.RS("AVG(CAST(value_amount AS DOUBLE))", 4) + """ AS avg_daily_value, COUNT(*) AS days
FROM d GROUP BY 1, 2""")
def events_weekly(spark, sf_dir):
    from ..sources.testtables import events_daily
    d = events_daily(spark, sf_dir).withColumn("avg_daily_value", F.col("value_amount").cast("double"))
    out = rollup.rollup(d, "W", keys=["event_type"], sum_cols=["event_count", "value_amount"],
                        mean_cols=["avg_daily_value"], date_col="date")
    return kpi.as_doubles(out).withColumn("avg_daily_value", round_stat("avg_daily_value", 4))


@register("events_profile", _profile_sql({c: c for c in ("event_id", "ts", "user_id", "event_type", "value", "props")},
                                          "", "events"))
def events_profile(spark, sf_dir):
    return profile_frame(read_table(spark, sf_dir, "events"))


# ------------------------------------------------- calendar rules, F23, A22
@register("calendar_rules", f"""WITH {Q.FACT_CTE[1:]},
d AS (SELECT DISTINCT "Date" FROM fact)
SELECT "Date",
  CASE WHEN DAYOFMONTH("Date") % 7 = 0 OR DAYOFMONTH("Date") % 15 = 0 THEN 1 ELSE 0 END AS promo_rule,
  CASE WHEN MONTH("Date") = 12 AND DAYOFMONTH("Date") = 25 THEN 1 ELSE 0 END AS holiday_forecast,
  CASE WHEN (MONTH("Date") = 1 AND DAYOFMONTH("Date") = 1) OR (MONTH("Date") = 12 AND DAYOFMONTH("Date") = 25)
         OR (MONTH("Date") = 4 AND DAYOFMONTH("Date") IN (1, 2, 3)) THEN 1 ELSE 0 END AS holiday_sales_data,
  CASE WHEN MONTH("Date") = 12 AND DAYOFMONTH("Date") IN (24, 25, 31) THEN 1 ELSE 0 END AS holiday_restaurant,
  {Q.RS('1.0 + 0.2 * SIN(2.0 * PI() * DAYOFYEAR("Date") / 365)', 6)} AS seasonal_factor
FROM d""")
def calendar_rules(spark, sf_dir):
    from ..functions import exprs as E
    d = sales_fact(spark, sf_dir).select(S.DATE).distinct()
    return d.select(S.DATE,
                    E.promo_day_rule(F.dayofmonth(S.DATE)).alias("promo_rule"),
                    E.holiday_rule(S.DATE, S.HOLIDAYS_FORECAST).alias("holiday_forecast"),
                    E.holiday_rule(S.DATE, S.HOLIDAYS_SALES_DATA).alias("holiday_sales_data"),
                    E.holiday_rule(S.DATE, S.HOLIDAYS_RESTAURANT).alias("holiday_restaurant"),
                    round_stat(E.seasonal_factor(F.dayofyear(S.DATE)), 6).alias("seasonal_factor"))


def _summary_ratio_sql() -> str:
    return f"""WITH s AS ({_summary_sql()})
SELECT {Q.KEYS}, avg_revenue_per_euro_marketing AS marketing_roi,
  total_operating_cash_flow_eur / CAST(total_days AS DOUBLE) AS operating_cash_flow_per_day,
  CAST(promo_days_count AS DOUBLE) / CAST(total_days AS DOUBLE) * 100 AS promo_days_pct,
  CAST(holiday_days_count AS DOUBLE) / CAST(total_days AS DOUBLE) * 100 AS holiday_days_pct
FROM s"""


@register("summary_ratios", _summary_ratio_sql())
def summary_ratios(spark, sf_dir):
    s = kpi.summary_ratios(kpi.forecast_summary(_daily(spark, sf_dir), nested=False))
    return s.select(*KEYS, "marketing_roi", "operating_cash_flow_per_day", "promo_days_pct", "holiday_days_pct")


@register("forecast_totals", f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte([1])},
w AS (SELECT "Date", Net_Sales_Revenue_EUR_lag1 AS predicted_sales, COGS_EUR_lag1 AS predicted_cogs,
             Net_Sales_Volume_Litres_lag1 AS predicted_volume
      FROM lagged WHERE Net_Sales_Revenue_EUR_lag1 IS NOT NULL AND COGS_EUR_lag1 IS NOT NULL
        AND Net_Sales_Volume_Litres_lag1 IS NOT NULL AND "Date" >= DATE '{HOLDOUT_CUT}'),
l AS (SELECT "Date", 'sales' AS target, predicted_sales AS value FROM w
      UNION ALL SELECT "Date", 'cogs', predicted_cogs FROM w
      UNION ALL SELECT "Date", 'volume', predicted_volume FROM w)
SELECT target, MIN("Date") AS start_date, MAX("Date") AS end_date, CAST(SUM(value) AS DOUBLE) AS total,
  CAST(SUM(value) AS DOUBLE) / COUNT(value) AS avg_daily, CAST(MAX(value) AS DOUBLE) AS peak
FROM l GROUP BY target""")
def forecast_totals(spark, sf_dir):
    from ..operators.features import domain_lags, drop_incomplete
    lagged = drop_incomplete(domain_lags(sales_fact(spark, sf_dir)),
                             [f"{t}_lag1" for t in S.DOMAIN_TARGETS.values()])
    wide = lagged.filter(F.col(S.DATE) >= F.to_date(F.lit(HOLDOUT_CUT))).select(
        S.DATE, *[F.col(f"{c}_lag1").alias(f"predicted_{t}") for t, c in S.DOMAIN_TARGETS.items()])
    return metrics.forecast_totals(wide, S.DATE)


# ---------------------------------------------------------- reports
def _report(spark, sf_dir) -> dict[str, DataFrame]:
    from ..operators import report
    return report.accuracy_report(_scored(spark, sf_dir), HOLDOUT_CUT)


def _pivot_sql(source: str, scope: list[str]) -> str:
    cols = ", ".join(f"MAX(CASE WHEN target = '{t}' THEN {m} END) AS {t}_{m}" for t in metrics.TARGET_ORDER
                     for m in ("mape", "r2", "mae"))
    return f"SELECT {', '.join(scope)}, {cols} FROM ({source}) GROUP BY {', '.join(scope)}"


@register("report_holdout", f"""WITH {Q.SCORED_CTE[1:]},
h AS (SELECT target, {Q.metric_sql()} FROM scored WHERE date >= DATE '{HOLDOUT_CUT}' GROUP BY target),
l AS ({' UNION ALL '.join(f"SELECT target, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM h" for m in metrics.METRICS)})
SELECT metric, {', '.join(f"MAX(CASE WHEN target = '{t}' THEN value END) AS {t}" for t in metrics.TARGET_ORDER)} FROM l GROUP BY metric""")
def report_holdout(spark, sf_dir):
    return _report(spark, sf_dir)["holdout"]


@register("report_rolling", _pivot_sql(ORACLE["rolling_metrics"], ["window_id", "window_start", "window_end"]))
def report_rolling(spark, sf_dir):
    return _report(spark, sf_dir)["rolling_windows"]


@register("report_segments", _pivot_sql(ORACLE["segment_metrics"], ["segment_type", "segment_value"]))
def report_segments(spark, sf_dir):
    return _report(spark, sf_dir)["segments"]


def _executive_sql() -> str:
    h, r, recs = ORACLE["accuracy_rating"], ORACLE["rolling_average"], ORACLE["recommendations"]
    parts = [f"SELECT 100 AS ord, 'holdout' AS section, target || '.{m}' AS key, CAST({m} AS DOUBLE) AS number, NULL AS txt FROM ({h})"
             for m in metrics.METRICS]
    parts.append(f"SELECT 200, 'rating', target, NULL, rating FROM ({h})")
    parts += [f"SELECT {300 + i}, 'rolling_average', target || '.{m}', CAST({m} AS DOUBLE), NULL FROM ({r})"
              for i, m in enumerate(("mape", "r2"))]
    parts.append(f"SELECT 400 + rec_no, 'recommendation', CAST(rec_no AS VARCHAR), NULL, recommendation FROM ({recs})")
    return "SELECT CAST(ord AS INTEGER) AS ord, section, key, number, txt FROM (" + " UNION ALL ".join(parts) + ")"


@register("report_summary", _executive_sql())
def report_summary(spark, sf_dir):
    """K3; numbers are read back from their text, as engines write doubles differently."""
    out = _report(spark, sf_dir)["executive_summary"]
    told = F.col("section").isin("holdout", "rolling_average")
    return out.select("ord", "section", "key", F.when(told, F.col("value").cast("double")).alias("number"),
                      F.when(~told, F.col("value")).alias("txt"))


# ------------------------------------------------ coercion, defaults, lookups
@register("coerced_numbers", """SELECT p_partkey, TRY_CAST(SPLIT_PART(p_name, ' ', 2) AS DOUBLE) AS second_word,
  TRY_CAST(p_brand AS DOUBLE) AS p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part""")
def coerced_numbers(spark, sf_dir):
    """P20 on words that are numbers for some rows or none."""
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second_word"), "p_brand", "p_size")
    return coerce_numeric(part, ["second_word", "p_brand", "p_size"])


@register("filled_features", f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, "Date", CAST(Avg_Temp_C AS DOUBLE) AS Avg_Temp_C, CAST(1000 AS DOUBLE) AS sales_lag7,
  CAST(20 AS DOUBLE) AS other_temp, CAST(1 AS DOUBLE) AS base_rate, CAST(1 AS DOUBLE) AS price_index, CAST(0 AS DOUBLE) AS unknown,
  'default' AS region FROM fact""")
def filled_features(spark, sf_dir):
    """A column that is there stays, absent ones are filled by their names."""
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE, S.TEMPERATURE)
    return fill_missing_features(f, [S.TEMPERATURE, "sales_lag7", "other_temp", "base_rate", "price_index", "unknown"], ["region"])


SEGMENT_MULTIPLIERS = {"AUTOMOBILE": 1.2, "BUILDING": 0.8, "MACHINERY": 1.5}  # ours; the other segments get the default


@register("segment_multipliers", f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, "Date", CASE {' '.join(f"WHEN Channel = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in SEGMENT_MULTIPLIERS.items())}
  ELSE CAST(1 AS DOUBLE) END AS multiplier FROM fact""")
def segment_multipliers(spark, sf_dir):
    """F17."""
    from ..functions.exprs import lookup
    return sales_fact(spark, sf_dir).select(*KEYS, S.DATE, lookup(S.CHANNEL, SEGMENT_MULTIPLIERS).alias("multiplier"))


@register("basic_calendar", f"""WITH {Q.FACT_CTE[1:]}
SELECT {Q.KEYS}, "Date", STRFTIME("Date", '%Y-%m-%d') AS iso_date, Promotional_Event = 1 AS is_promo,
  {', '.join(f"{_cal_sql()[c]} AS {c}" for c in ("day_of_week", "month", "year", "day_of_year", "week_of_year"))} FROM fact""")
def basic_calendar(spark, sf_dir):
    """F12 and F21."""
    from ..functions.calendar import add_basic_calendar
    from ..functions.exprs import date_to_iso, flag_to_bool
    f = sales_fact(spark, sf_dir).select(*KEYS, S.DATE, date_to_iso(S.DATE).alias("iso_date"), flag_to_bool(S.PROMO).alias("is_promo"))
    return add_basic_calendar(f, S.DATE)


@register("parsed_dates", """SELECT o_orderkey, STRFTIME(TRY_CAST(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority
  ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS DATE), '%d.%m.%Y') AS o_orderdate FROM orders""")
def parsed_dates(spark, sf_dir):
    """S4 on text of which a part is no date."""
    from ..sources.io import parse_dates
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("o_orderdate"))
    return parse_dates(orders, "o_orderdate", "yyyy-MM-dd").withColumn("o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy"))


@register("model_inputs", f"""WITH {Q.FACT_CTE[1:]}{Q._lag_cte([1])}
SELECT {', '.join(f"CAST({c} AS DOUBLE) AS {c}" if c in MONEY_COLS or c.endswith('_lag1') else f"{_cal_sql()[c]} AS {c}"
                  if c in _cal_sql() else c for c in S.SALES_FEATURES)} FROM lagged
WHERE Net_Sales_Revenue_EUR_lag1 IS NOT NULL AND COGS_EUR_lag1 IS NOT NULL AND Net_Sales_Volume_Litres_lag1 IS NOT NULL""")
def model_inputs(spark, sf_dir):
    """The 18 features of the sales and COGS models, in order."""
    from ..operators import models
    return kpi.as_doubles(models.check_features(models.domain_feature_frame(sales_fact(spark, sf_dir)), S.SALES_FEATURES))
