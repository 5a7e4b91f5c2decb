"""DuckDB oracle SQL for the registered queries.

Each string is self-contained over the driver's views.  The conventions
mirror the Spark plans exactly: money summed as DECIMAL and cast to double
once, ratios in double, presentation rounding as floor(x * 10^d + 0.5) / 10^d
(plain IEEE arithmetic, the same result in both engines, see
``functions.exprs.round_half_up``), statistics in double rounded to 4 places.
"""

from __future__ import annotations

from .. import schema as S

KEYS = "Country, Channel, Product_Category"


def RS(x: str, d: int = 4) -> str:
    """Rounding for statistics (means, std, correlations, sin/cos): through
    DECIMAL(38,6) first, which absorbs the last-bit differences of
    engine-specific summation orders and math libraries."""
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,6)), {d}) AS DOUBLE)"


def R(x: str, d: int = 2) -> str:
    scale = f"CAST({float(10 ** d)!r} AS DOUBLE)"
    return f"(FLOOR(CAST(({x}) AS DOUBLE) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def safe_div(n: str, d: str) -> str:
    return f"(CASE WHEN CAST({d} AS DOUBLE) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0.0 END)"


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _c(c: str) -> str:
    return f"CAST(FLOOR({c} * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def _money(total: str, digits: int) -> str:
    step = "0." + "0" * (digits - 1) + "1"
    return f"CAST(CAST({total} AS DECIMAL(18,0)) * {step} AS DECIMAL(24,6))"


FACT_CTE = f"""
fact0 AS (
  SELECT CAST(l.l_shipdate AS DATE) AS "Date",
         r.r_name AS Country, c.c_mktsegment AS Channel, p.p_type AS Product_Category,
         {_money(f"SUM({_c('l.l_extendedprice')} * (100 - {_c('l.l_discount')}))", 4)} AS Net_Sales_Revenue_EUR,
         {_money(f"SUM({_c('l.l_quantity')} * {_c('p.p_retailprice')} * 60)", 6)} AS COGS_EUR,
         {_money(f"SUM({_c('l.l_quantity')})", 2)} AS Net_Sales_Volume_Litres,
         {_money(f"SUM({_c('l.l_extendedprice')} * {_c('l.l_tax')})", 4)} AS Marketing_Spend_EUR,
         MAX(CASE WHEN l.l_discount >= 0.08 THEN 1 ELSE 0 END) AS Promotional_Event,
         CAST(SUM({_c('l.l_quantity')}) AS DOUBLE) / 100.0 / COUNT(*) AS Consumer_Confidence_Index,
         CAST(SUM({_c('l.l_tax')}) AS DOUBLE) / 100.0 / COUNT(*) AS Inflation_Rate_EUR,
         CAST(SUM({_c('l.l_discount')}) AS DOUBLE) / 100.0 / COUNT(*) AS Competitor_Activity_Index
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3, 4
),
fact AS (
  SELECT "Date", Country, Channel, Product_Category, Net_Sales_Volume_Litres, Net_Sales_Revenue_EUR,
         COGS_EUR, Marketing_Spend_EUR, Promotional_Event, Consumer_Confidence_Index, Inflation_Rate_EUR,
         CAST(ROUND(CAST(15.0 + 10.0 * SIN(2.0 * PI() * DAYOFYEAR("Date") / 365) AS DECIMAL(38,10)), 6) AS DOUBLE)
           AS Avg_Temp_C,
         CASE WHEN (MONTH("Date") = 1 AND DAYOFMONTH("Date") = 1) OR (MONTH("Date") = 12 AND DAYOFMONTH("Date") = 25)
                OR (MONTH("Date") = 4 AND DAYOFMONTH("Date") IN (1, 2, 3)) THEN 1 ELSE 0 END AS Holiday_Indicator,
         Competitor_Activity_Index
  FROM fact0
)"""


def _clamp(c: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN {c} ELSE CAST(0 AS DECIMAL(24,6)) END)"


DAILY_CTE = FACT_CTE + f""",
clamped AS (
  SELECT {KEYS}, "Date", Promotional_Event, Holiday_Indicator,
         {_clamp('Net_Sales_Revenue_EUR')} AS s, {_clamp('COGS_EUR')} AS c,
         {_clamp('Net_Sales_Volume_Litres')} AS v, {_clamp('Marketing_Spend_EUR')} AS m
  FROM fact
),
daily AS (
  SELECT {KEYS}, "Date" AS date,
         ROUND(s, 2) AS sales_revenue_eur, ROUND(c, 2) AS cogs_eur, ROUND(v, 2) AS sales_volume_litres,
         ROUND(m, 2) AS marketing_spend_eur, CAST(Promotional_Event AS BOOLEAN) AS promotional_event,
         ROUND(s - c, 2) AS gross_profit_eur,
         {R(f"LEAST(GREATEST({safe_div('CAST(s - c AS DOUBLE) * 100', 's')}, -100.0), 100.0)")} AS gross_profit_margin_pct,
         {R(safe_div('s', 'v'))} AS asp_per_litre_eur,
         ROUND(s - c - m, 2) AS predicted_operating_cash_flow_eur,
         {R(safe_div('c', 'v'))} AS cogs_per_litre,
         {R(safe_div('CAST(m AS DOUBLE) * 100', 's'))} AS marketing_spend_ratio,
         {R(safe_div('s', 'm'))} AS revenue_per_euro_marketing,
         {R(safe_div('v', 'm'))} AS litres_per_euro_marketing,
         CAST(Holiday_Indicator AS INTEGER) AS holiday_indicator
  FROM clamped
)"""

DAILY_OUT = f"""{KEYS}, date, {D('sales_revenue_eur')} AS sales_revenue_eur, {D('cogs_eur')} AS cogs_eur,
  {D('sales_volume_litres')} AS sales_volume_litres, {D('marketing_spend_eur')} AS marketing_spend_eur,
  promotional_event, {D('gross_profit_eur')} AS gross_profit_eur, gross_profit_margin_pct, asp_per_litre_eur,
  {D('predicted_operating_cash_flow_eur')} AS predicted_operating_cash_flow_eur, cogs_per_litre,
  marketing_spend_ratio, revenue_per_euro_marketing, litres_per_euro_marketing, holiday_indicator"""

TOTALS = """COUNT(*) AS total_days,
  SUM(sales_revenue_eur) AS total_sales, SUM(cogs_eur) AS total_cogs, SUM(sales_volume_litres) AS total_volume,
  SUM(marketing_spend_eur) AS total_marketing, SUM(gross_profit_eur) AS total_gross_profit,
  SUM(predicted_operating_cash_flow_eur) AS total_operating_cash_flow,
  COALESCE(SUM(CASE WHEN promotional_event THEN sales_revenue_eur END), 0) AS total_revenue_promotional_events,
  COALESCE(SUM(CASE WHEN promotional_event THEN sales_volume_litres END), 0) AS total_volume_promotional_events,
  COALESCE(SUM(CASE WHEN NOT promotional_event THEN sales_revenue_eur END), 0) AS total_revenue_non_promotional,
  COALESCE(SUM(CASE WHEN NOT promotional_event THEN sales_volume_litres END), 0) AS total_volume_non_promotional,
  CAST(COUNT_IF(promotional_event) AS BIGINT) AS promo_days_count, CAST(COUNT_IF(NOT promotional_event) AS BIGINT) AS non_promo_days_count"""

HOLIDAY_AGG = """COALESCE(SUM(CASE WHEN holiday_indicator = 1 THEN sales_revenue_eur END), 0) AS _hol_sales,
  COALESCE(SUM(CASE WHEN holiday_indicator = 0 THEN sales_revenue_eur END), 0) AS _non_sales,
  COALESCE(SUM(CASE WHEN holiday_indicator = 1 THEN sales_volume_litres END), 0) AS _hol_volume,
  COALESCE(SUM(CASE WHEN holiday_indicator = 0 THEN sales_volume_litres END), 0) AS _non_volume,
  CAST(COUNT_IF(holiday_indicator = 1) AS BIGINT) AS holiday_days_count, CAST(COUNT_IF(holiday_indicator = 0) AS BIGINT) AS non_holiday_days_count"""


def _impact(a: str, b: str) -> str:
    return safe_div(f"({a} - {b}) * 100", b)


def _pair_cols(prefix_a, prefix_b, num_a, num_b, cnt_a, cnt_b, names) -> str:
    sa, sb = safe_div(num_a[0], cnt_a), safe_div(num_b[0], cnt_b)
    va, vb = safe_div(num_a[1], cnt_a), safe_div(num_b[1], cnt_b)
    n = names
    return ",\n  ".join([
        f"{R(sa)} AS {n[0]}", f"{R(sb)} AS {n[1]}", f"{R(va)} AS {n[2]}", f"{R(vb)} AS {n[3]}",
        f"{R(_impact(sa, sb))} AS {n[4]}", f"{R(_impact(va, vb))} AS {n[5]}"])


PROMO_COLS = _pair_cols(
    "promo", "non", ("total_revenue_promotional_events", "total_volume_promotional_events"),
    ("total_revenue_non_promotional", "total_volume_non_promotional"), "promo_days_count",
    "non_promo_days_count",
    ["avg_promo_sales", "avg_non_promo_sales", "avg_promo_volume", "avg_non_promo_volume",
     "promotional_sales_impact_pct", "promotional_volume_impact_pct"])

HOLIDAY_COLS = _pair_cols(
    "hol", "non", ("_hol_sales", "_hol_volume"), ("_non_sales", "_non_volume"), "holiday_days_count",
    "non_holiday_days_count",
    ["avg_holiday_sales", "avg_non_holiday_sales", "avg_holiday_volume", "avg_non_holiday_volume",
     "holiday_sales_lift_pct", "holiday_volume_lift_pct"])

AVERAGE_COLS = ",\n  ".join([
    f"{R('CAST(total_sales AS DOUBLE) / CAST(total_days AS DOUBLE)')} AS avg_daily_sales_revenue_eur",
    f"{R('CAST(total_gross_profit AS DOUBLE) / CAST(total_days AS DOUBLE)')} AS avg_daily_gross_profit_eur",
    f"{R(safe_div('CAST(total_gross_profit AS DOUBLE) * 100', 'total_sales'))} AS avg_gross_profit_margin_pct",
    f"{R(safe_div('total_sales', 'total_volume'))} AS avg_asp_per_litre_eur",
    f"{R(safe_div('total_cogs', 'total_volume'))} AS avg_cogs_per_litre",
    f"{R(safe_div('CAST(total_marketing AS DOUBLE) * 100', 'total_sales'))} AS avg_marketing_spend_ratio",
    f"{R(safe_div('total_sales', 'total_marketing'))} AS avg_revenue_per_euro_marketing",
    f"{R(safe_div('total_volume', 'total_marketing'))} AS avg_litres_per_euro_marketing",
])


def metric_sql(y: str = "actual", p: str = "predicted", digits: int | None = 4) -> str:
    Y, P = D(y), D(p)
    E = f"({Y} - {P})"
    sse = f"SUM({E} * {E})"
    sst = f"(COUNT(*) * VAR_POP({Y}))"
    r = (lambda x: x) if digits is None else (lambda x: RS(x, digits))
    within = lambda t: (f"AVG(CASE WHEN {Y} <> 0 AND ABS({E} / {Y}) <= {t} "  # noqa: E731
                        f"THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100")
    parts = [
        "COUNT(*) AS n",
        f"{r(f'AVG(ABS({E}))')} AS mae",
        f"{r(f'SQRT(AVG({E} * {E}))')} AS rmse",
        f"{r(f'CASE WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - {sse} / {sst} END')} AS r2",
        f"{r(f'AVG(CASE WHEN {Y} <> 0 THEN ABS({E} / {Y}) END) * 100')} AS mape",
        f"{r(f'AVG({Y})')} AS mean_actual",
        f"{r(f'AVG({P})')} AS mean_predicted",
        f"{r(f'STDDEV_POP({Y})')} AS std_actual",
        f"{r(f'STDDEV_POP({P})')} AS std_predicted",
        f"{r(f'AVG({P} - {Y})')} AS bias",
        f"{r(f'CASE WHEN AVG({Y}) <> 0 THEN AVG({P} - {Y}) / AVG({Y}) * 100 END')} AS bias_pct",
        f"{r(within('0.1'))} AS within_10_pct",
        f"{r(within('0.2'))} AS within_20_pct",
        f"CAST(COUNT_IF({Y} = 0) AS BIGINT) AS zero_actual_rows",
        f"CAST(COUNT_IF({Y} IS NULL OR {P} IS NULL) AS BIGINT) AS excluded_rows",
    ]
    return ",\n  ".join(parts)


def _lag_cte(lags) -> str:
    cols = []
    for k in lags:
        for t in ("Net_Sales_Revenue_EUR", "COGS_EUR", "Net_Sales_Volume_Litres"):
            cols.append(f"LAG({t}, {k}) OVER w AS {t}_lag{k}")
    return (f""",
lagged AS (
  SELECT *, {', '.join(cols)}
  FROM fact WINDOW w AS (PARTITION BY {KEYS} ORDER BY "Date")
)""")


def _stack(lag: int, all_lags) -> str:
    cond = " AND ".join(f"{t}_lag{k} IS NOT NULL" for k in all_lags
                        for t in ("Net_Sales_Revenue_EUR", "COGS_EUR", "Net_Sales_Volume_Litres"))
    parts = []
    for name, col in S.DOMAIN_TARGETS.items():
        parts.append(f"""SELECT "Date" AS date, {KEYS}, '{name}' AS target, {col} AS actual,
         {col}_lag{lag} AS predicted FROM lagged WHERE {cond}""")
    return "\n  UNION ALL ".join(parts)


SCORED_CTE = FACT_CTE + _lag_cte([1]) + f""",
scored AS (
  {_stack(1, [1])}
)"""

CAND_LAGS = [1, 7, 30]
CANDIDATES_CTE = FACT_CTE + _lag_cte(CAND_LAGS) + ",\ncands AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT *, '{m}' AS model, {i} AS model_order FROM ({_stack(k, CAND_LAGS)})"
    for i, (m, k) in enumerate([("naive_lag1", 1), ("naive_lag7", 7), ("naive_lag30", 30)])) + "\n)"

METRIC_NAMES = ["mae", "rmse", "r2", "mape", "mean_actual", "mean_predicted", "std_actual",
                "std_predicted", "bias", "bias_pct", "within_10_pct", "within_20_pct"]
