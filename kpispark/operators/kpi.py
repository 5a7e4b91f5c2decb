"""Row KPIs and period summaries.

A *daily frame* has one row per (scenario keys..., date) with the columns in
``DAILY``.  Money columns stay exact DECIMAL when the input was DECIMAL, so
period sums are exact; callers cast to double at output (``as_doubles``).
Every summary is one ``groupBy(keys).agg`` - a single shuffle with map-side
partial aggregation - however many KPIs it returns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (business_kpis, clamp0, clamp0_money, cogs_ratio_pct, round_half_up,
                               round_stat, safe_div)
from ..schema import (COGS, COMPETITOR, CONFIDENCE, DATE, HOLIDAY, INFLATION, MARKETING, PROMO,
                      REVENUE, SEGMENT_KEYS, TEMPERATURE, VOLUME)

# Column names of the daily frame.
D_DATE = "date"
D_SALES = "sales_revenue_eur"
D_COGS = "cogs_eur"
D_VOLUME = "sales_volume_litres"
D_MARKETING = "marketing_spend_eur"
D_PROMO = "promotional_event"
D_HOLIDAY = "holiday_indicator"
KPI_COLUMNS = ["gross_profit_eur", "gross_profit_margin_pct", "asp_per_litre_eur",
               "predicted_operating_cash_flow_eur", "cogs_per_litre", "marketing_spend_ratio",
               "revenue_per_euro_marketing", "litres_per_euro_marketing"]
DAILY = [D_DATE, D_SALES, D_COGS, D_VOLUME, D_MARKETING, D_PROMO] + KPI_COLUMNS


def _decimal_cols(df: DataFrame) -> set[str]:
    """Names of DECIMAL columns (one schema round trip)."""
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}


def _clamp(dec: set[str], col: str) -> Column:
    return clamp0_money(col) if col in dec else clamp0(col)


def _round_measure(col: Column, decimal: bool, digits: int) -> Column:
    return F.round(col, digits) if decimal else round_half_up(col, digits)


def as_doubles(df: DataFrame) -> DataFrame:
    """Cast every DECIMAL column to double (presentation boundary)."""
    return df.select([F.col(f.name).cast("double").alias(f.name)
                      if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                      for f in df.schema.fields])


# --------------------------------------------------------------------------- F5
def daily_kpis(df: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, date: str = DATE,
               sales: str = REVENUE, cogs: str = COGS, volume: str = VOLUME,
               marketing: str = MARKETING, promo: str = PROMO, holiday: str | None = HOLIDAY,
               digits: int = 2) -> DataFrame:
    """Per-row KPIs (F5) in the daily-forecast shape.

    Inputs are clamped at zero (F1); the KPIs come from the *unrounded*
    clamped inputs and are rounded once; the measures themselves are rounded
    for the output row, and period summaries sum these rounded fields (Q2).
    """
    decs = _decimal_cols(df)
    s, c, v, m = (_clamp(decs, x) for x in (sales, cogs, volume, marketing))
    dec = {x: x in decs for x in (sales, cogs, volume, marketing)}
    kpis = business_kpis(s, c, v, m, digits=digits, exact=all(dec.values()))
    cols = [F.col(k) for k in keys] + [
        F.col(date).cast("date").alias(D_DATE),
        _round_measure(s, dec[sales], digits).alias(D_SALES),
        _round_measure(c, dec[cogs], digits).alias(D_COGS),
        _round_measure(v, dec[volume], digits).alias(D_VOLUME),
        _round_measure(m, dec[marketing], digits).alias(D_MARKETING),
        F.col(promo).cast("boolean").alias(D_PROMO),
    ] + [col.alias(name) for name, col in kpis.items()]
    if holiday is not None and holiday in df.columns:
        cols.append(F.col(holiday).cast("int").alias(D_HOLIDAY))
    return df.select(*cols)


def kpi_standalone(df: DataFrame, sales: str, cogs: str, volume: str, marketing: str | None = None,
                   digits: int = 2) -> DataFrame:
    """Ad-hoc KPI calculator over an input table (F7 = P16 + F5 + F6).

    Rows with any negative input are not computed: they carry
    ``validation_status = 'rejected'`` and NULL KPIs (the original rejects the
    request); valid rows get the eight KPIs plus ``cogs_ratio_pct``.
    """
    mk = F.col(marketing) if marketing else F.lit(0.0)
    inputs = [F.col(sales), F.col(cogs), F.col(volume), mk]
    negative = F.lit(False)
    for x in inputs:
        negative = negative | F.coalesce(x < 0, F.lit(False))
    decs = _decimal_cols(df)
    s, c, v = (_clamp(decs, x) for x in (sales, cogs, volume))
    m = _clamp(decs, marketing) if marketing else F.lit(0.0)
    kpis = business_kpis(s, c, v, m, digits=digits)
    kpis["cogs_ratio_pct"] = cogs_ratio_pct(s, c, digits)
    out = [F.when(~negative, col).alias(name) for name, col in kpis.items()]
    status = F.when(negative, F.lit("rejected: all input values must be non-negative")) \
              .otherwise(F.lit("ok"))
    return df.select("*", *out, status.alias("validation_status"))


def kpi_rejects(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows failing the non-negativity validation."""
    bad = F.lit(False)
    for x in cols:
        bad = bad | F.coalesce(F.col(x) < 0, F.lit(False))
    return df.filter(bad)


# --------------------------------------------------------------------------- J1
def attach_holiday(daily: DataFrame, calendar: DataFrame, date: str = D_DATE,
                   cal_date: str = DATE, cal_flag: str = HOLIDAY,
                   cal_order: str | None = None) -> DataFrame:
    """Left-join a holiday calendar on date; dates missing from it get 0.

    The calendar is first reduced to one row per date: with ``cal_order``
    the last row by that order wins, as a later dict entry would.  Rows of a
    table have no order of their own, so without ``cal_order`` the larger
    flag is taken.  The reduced calendar has at most one row per calendar day,
    a bounded size, and the join is left to AQE, which broadcasts it when
    small.
    """
    if cal_order:
        flags = calendar.groupBy(F.col(cal_date).cast("date").alias("_hd")).agg(
            F.max_by(F.col(cal_flag), F.col(cal_order)).alias("_hf"))
    else:
        flags = calendar.groupBy(F.col(cal_date).cast("date").alias("_hd")).agg(
            F.max(cal_flag).alias("_hf"))
    out = daily.drop(D_HOLIDAY) if D_HOLIDAY in daily.columns else daily
    out = out.join(flags, out[date] == flags["_hd"], "left")
    return out.withColumn(D_HOLIDAY, F.coalesce(F.col("_hf").cast("int"), F.lit(0))).drop("_hd", "_hf")


# ------------------------------------------------------------------------ A1-A5
def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _totals_exprs() -> list[Column]:
    promo = F.col(D_PROMO)
    return [
        F.count(F.lit(1)).alias("total_days"),
        F.sum(D_SALES).alias("total_sales"),
        F.sum(D_COGS).alias("total_cogs"),
        F.sum(D_VOLUME).alias("total_volume"),
        F.sum(D_MARKETING).alias("total_marketing"),
        F.sum("gross_profit_eur").alias("total_gross_profit"),
        F.sum("predicted_operating_cash_flow_eur").alias("total_operating_cash_flow"),
        _sum0(F.when(promo, F.col(D_SALES))).alias("total_revenue_promotional_events"),
        _sum0(F.when(promo, F.col(D_VOLUME))).alias("total_volume_promotional_events"),
        _sum0(F.when(~promo, F.col(D_SALES))).alias("total_revenue_non_promotional"),
        _sum0(F.when(~promo, F.col(D_VOLUME))).alias("total_volume_non_promotional"),
        F.count_if(promo).alias("promo_days_count"),
        F.count_if(~promo).alias("non_promo_days_count"),
    ]


def period_totals(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Period totals and promo / non-promo conditional totals (A1, A2)."""
    return daily.groupBy(*keys).agg(*_totals_exprs())


def _impact(avg_a: Column, avg_b: Column) -> Column:
    return safe_div((avg_a - avg_b) * 100, avg_b)


def promo_columns(digits: int | None = 2) -> dict[str, Column]:
    """Promotional impact from period totals (A3)."""
    r = (lambda c: c) if digits is None else (lambda c: round_half_up(c, digits))
    aps = safe_div("total_revenue_promotional_events", "promo_days_count")
    anps = safe_div("total_revenue_non_promotional", "non_promo_days_count")
    apv = safe_div("total_volume_promotional_events", "promo_days_count")
    anpv = safe_div("total_volume_non_promotional", "non_promo_days_count")
    return {
        "avg_promo_sales": r(aps), "avg_non_promo_sales": r(anps),
        "avg_promo_volume": r(apv), "avg_non_promo_volume": r(anpv),
        "promotional_sales_impact_pct": r(_impact(aps, anps)),
        "promotional_volume_impact_pct": r(_impact(apv, anpv)),
    }


def promo_impact(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, digits: int | None = 2) -> DataFrame:
    """Average promo vs non-promo sales and volume and the impact % (A3)."""
    t = period_totals(daily, keys)
    return t.select(*keys, *[c.alias(n) for n, c in promo_columns(digits).items()],
                    "promo_days_count", "non_promo_days_count")


def _holiday_exprs() -> list[Column]:
    h = F.col(D_HOLIDAY)
    return [
        _sum0(F.when(h == 1, F.col(D_SALES))).alias("_hol_sales"),
        _sum0(F.when(h == 0, F.col(D_SALES))).alias("_non_sales"),
        _sum0(F.when(h == 1, F.col(D_VOLUME))).alias("_hol_volume"),
        _sum0(F.when(h == 0, F.col(D_VOLUME))).alias("_non_volume"),
        F.count_if(h == 1).alias("holiday_days_count"),
        F.count_if(h == 0).alias("non_holiday_days_count"),
    ]


def holiday_columns(digits: int | None = 2) -> dict[str, Column]:
    r = (lambda c: c) if digits is None else (lambda c: round_half_up(c, digits))
    ahs = safe_div("_hol_sales", "holiday_days_count")
    anhs = safe_div("_non_sales", "non_holiday_days_count")
    ahv = safe_div("_hol_volume", "holiday_days_count")
    anhv = safe_div("_non_volume", "non_holiday_days_count")
    return {
        "avg_holiday_sales": r(ahs), "avg_non_holiday_sales": r(anhs),
        "avg_holiday_volume": r(ahv), "avg_non_holiday_volume": r(anhv),
        "holiday_sales_lift_pct": r(_impact(ahs, anhs)),
        "holiday_volume_lift_pct": r(_impact(ahv, anhv)),
    }


def holiday_lift(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, digits: int | None = 2) -> DataFrame:
    """Holiday vs normal-day averages and lift % (A4); only flags exactly 0/1 count."""
    t = daily.groupBy(*keys).agg(*_holiday_exprs())
    return t.select(*keys, *[c.alias(n) for n, c in holiday_columns(digits).items()],
                    "holiday_days_count", "non_holiday_days_count")


def average_columns(digits: int | None = 2) -> dict[str, Column]:
    """Two per-day means and six ratio-of-sums averages (A5)."""
    r = (lambda c: c) if digits is None else (lambda c: round_half_up(c, digits))
    d = F.col("total_days").cast("double")
    return {
        "avg_daily_sales_revenue_eur": r(F.col("total_sales").cast("double") / d),
        "avg_daily_gross_profit_eur": r(F.col("total_gross_profit").cast("double") / d),
        "avg_gross_profit_margin_pct": r(safe_div(F.col("total_gross_profit").cast("double") * 100,
                                                  "total_sales")),
        "avg_asp_per_litre_eur": r(safe_div("total_sales", "total_volume")),
        "avg_cogs_per_litre": r(safe_div("total_cogs", "total_volume")),
        "avg_marketing_spend_ratio": r(safe_div(F.col("total_marketing").cast("double") * 100,
                                                "total_sales")),
        "avg_revenue_per_euro_marketing": r(safe_div("total_sales", "total_marketing")),
        "avg_litres_per_euro_marketing": r(safe_div("total_volume", "total_marketing")),
    }


def summary_averages(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS,
                     digits: int | None = 2) -> DataFrame:
    t = period_totals(daily, keys)
    return t.select(*keys, "total_days", *[c.alias(n) for n, c in average_columns(digits).items()])


# --------------------------------------------------------------------------- A6
def segment_totals(daily: DataFrame, dims: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Sales and volume totals per value of each dimension (A6), one pass.

    ``GROUPING SETS ((d1), (d2), ...)`` - Spark expands rows once per set and
    aggregates map-side, so this is one shuffle however many dimensions.
    Output is long: (dimension, segment_value, total_sales, total_volume).
    """
    name_case = F.lit(None).cast("string")
    value_case = F.lit(None).cast("string")
    for d in reversed(list(dims)):
        name_case = F.when(F.grouping(d) == 0, F.lit(d)).otherwise(name_case)
        value_case = F.when(F.grouping(d) == 0, F.col(d).cast("string")).otherwise(value_case)
    sets = [[F.col(d)] for d in dims]
    out = daily.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        name_case.alias("dimension"), value_case.alias("segment_value"),
        F.sum(D_SALES).alias("total_sales"), F.sum(D_VOLUME).alias("total_volume"))
    return out.select("dimension", "segment_value", "total_sales", "total_volume")


def _map_sets(keys: Sequence[str], dims: Sequence[str]) -> list[str]:
    """Dimensions whose maps need a grouping of their own: those that the keys do not fix."""
    return [d for d in dims if d not in keys]


def _by_set(daily: DataFrame, keys: Sequence[str], dims: Sequence[str], exprs: Sequence[Column]) -> DataFrame:
    """``exprs`` per (keys) and per (keys, d) for every free dimension, one pass; ``_set`` is 0 or the d's number."""
    free = _map_sets(keys, dims)
    if not free:
        return daily.groupBy(*keys).agg(*exprs, F.lit(0).alias("_set"))
    sets = [[F.col(k) for k in keys]] + [[F.col(k) for k in [*keys, d]] for d in free]
    which = F.lit(0)
    for i, d in enumerate(free):
        which = F.when(F.grouping(d) == 0, i + 1).otherwise(which)
    return daily.groupingSets(sets, *[F.col(c) for c in [*keys, *free]]).agg(*exprs, which.alias("_set"))


def _folded(grouped: DataFrame, keys: Sequence[str], dims: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Back to one row per key: ``carried`` columns of the key's own row, and the maps from the others."""
    free = _map_sets(keys, dims)

    def entry(d: str, v: str) -> Column:
        return F.struct(F.col(d), round_half_up(F.col(v).cast("double")))
    names = {"sales": "_map_sales", "volume": "_map_volume"}
    if not free:
        return grouped.select(*keys, *carried, *[F.map_from_entries(F.array(entry(d, c))).alias(f"{m}_by_{d.lower()}")
                                                 for d in dims for m, c in names.items()])
    own = F.col("_set") == 0
    # a key's few rows: one for itself, one per value of each free dimension
    maps = []
    for d in dims:
        here = F.col("_set") == free.index(d) + 1 if d in free else own
        maps += [F.map_from_entries(F.collect_list(F.when(here & F.col(d).isNotNull(), entry(d, c)))).alias(f"{m}_by_{d.lower()}")
                 for m, c in names.items()]
    return grouped.groupBy(*keys).agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in carried], *maps)


def _map_sums() -> list[Column]:
    return [F.sum(D_SALES).alias("_map_sales"), F.sum(D_VOLUME).alias("_map_volume")]


def segment_maps(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS,
                 dims: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Per scenario: sales and volume by each dimension as MAP<string,double>.

    One aggregate over the daily rows (grouping sets for dimensions that the
    key leaves open).  When the scenario key contains the dimension (the
    original's one-segment request) each map has the single entry {value:
    total}.
    """
    return _folded(_by_set(daily, keys, dims, _map_sums()), keys, dims, [])


# --------------------------------------------------------------------------- A7
DAY_FIELDS = [D_DATE, D_SALES, "gross_profit_eur", "gross_profit_margin_pct",
              "predicted_operating_cash_flow_eur", "asp_per_litre_eur", "cogs_per_litre",
              "marketing_spend_ratio", "revenue_per_euro_marketing", "litres_per_euro_marketing",
              D_PROMO]


DAYS = {"best_day_sales": (D_SALES, 1), "worst_day_sales": (D_SALES, -1), "highest_margin_day": ("gross_profit_margin_pct", 1)}
#: Days fit 7 digits of a key, hundredths (rounded fields) the rest of 38.
_DAY_RANGE = 10_000_000


def _day_key(field: str, sign: int) -> Column:
    """One number that orders days by a field of two decimals, rising or falling, then by the earlier date.

    A primitive key: ``max_by`` of a column by it keeps two primitive values,
    so all three days with all their fields fit one hash aggregate.
    """
    hundredths = F.round(F.col(field).cast("decimal(28,2)") * 100, 0).cast("decimal(29,0)")
    return (hundredths * F.lit(sign) * F.lit(_DAY_RANGE).cast("decimal(8,0)")
            + (F.lit(_DAY_RANGE // 2) - F.unix_date(F.col(D_DATE))).cast("decimal(8,0)")).cast("decimal(38,0)")


def _day_exprs() -> list[Column]:
    keyed = {name: _day_key(*by) for name, by in DAYS.items()}
    return [F.max_by(F.col(c).cast("double") if c not in (D_DATE, D_PROMO) else F.col(c), key).alias(f"_{name}_{c}")
            for name, key in keyed.items() for c in DAY_FIELDS]


def _day_structs() -> list[Column]:
    return [F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in DAY_FIELDS]).alias(name) for name in DAYS]


def performance_days(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Best / worst sales day and highest-margin day as 11-field records.

    Ties go to the earliest date (the original scans days in date order and
    keeps the first extreme).  Sales and margin are the rounded fields of two
    decimals.  One hash aggregate, combined on the map side.
    """
    return daily.groupBy(*keys).agg(*_day_exprs()).select(*keys, *_day_structs())


def segment_map_rows(maps: DataFrame, keys: Sequence[str], dims: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """The maps of ``segment_maps`` as rows: keys, dimension, segment_value, sales, volume."""
    def entries(d: str) -> Column:
        return F.transform(F.map_entries(f"sales_by_{d.lower()}"), lambda e: F.struct(
            F.lit(d).alias("dimension"), e["key"].alias("segment_value"), e["value"].alias("sales"),
            F.element_at(f"volume_by_{d.lower()}", e["key"]).alias("volume")))
    return maps.select(*keys, F.inline(F.flatten(F.array(*[entries(d) for d in dims]))))


def best_worst_flat(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """A7 flattened: all 11 fields of each of the three days."""
    p = performance_days(daily, keys)
    cols = [F.col(k) for k in keys]
    for name in ("best_day_sales", "worst_day_sales", "highest_margin_day"):
        short = name.replace("_sales", "").replace("_day", "")
        cols += [F.col(f"{name}.{c}").alias(f"{short}_{c}") for c in DAY_FIELDS]
    return p.select(*cols)


# --------------------------------------------------------------------------- A8
def forecast_summary(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, nested: bool = True,
                     digits: int = 2) -> DataFrame:
    """The full period summary per scenario (A8): A1-A5 in one aggregation,
    plus segment maps (A6) and the three performance days (A7) when
    ``nested``, from the same pass over the daily rows.  ``daily`` must carry
    ``holiday_indicator`` (see J1).
    """
    exprs = [F.min(D_DATE).alias("period_start"), F.max(D_DATE).alias("period_end"), *_totals_exprs(), *_holiday_exprs()]
    extra = []
    if nested:
        grouped = _by_set(daily, keys, SEGMENT_KEYS, [*exprs, *_day_exprs(), *_map_sums()])
        carried = [c for c in grouped.columns if c not in (*keys, *SEGMENT_KEYS, "_set", "_map_sales", "_map_volume")]
        agg = _folded(grouped, keys, SEGMENT_KEYS, carried)
        extra = [f"{m}_by_{d.lower()}" for d in SEGMENT_KEYS for m in ("sales", "volume")] + _day_structs()
    else:
        agg = daily.groupBy(*keys).agg(*exprs)
    totals = {f"total_{a}": F.round(F.col(f"total_{b}"), digits).cast("double") for a, b in [
        ("sales_revenue_eur", "sales"), ("cogs_eur", "cogs"), ("volume_litres", "volume"),
        ("marketing_spend_eur", "marketing"), ("gross_profit_eur", "gross_profit"),
        ("operating_cash_flow_eur", "operating_cash_flow")]}
    cols = [F.col(k) for k in keys] + [F.col("period_start"), F.col("period_end"), F.col("total_days")]
    cols += [c.alias(n) for n, c in totals.items()]
    cols += [c.alias(n) for n, c in average_columns(digits).items()]
    cols += [c.alias(n) for n, c in promo_columns(digits).items()]
    cols += [F.col("promo_days_count"), F.col("non_promo_days_count")]
    cols += [c.alias(n) for n, c in holiday_columns(digits).items()]
    cols += [F.col("holiday_days_count"), F.col("non_holiday_days_count")]
    return agg.select(*cols, *extra)


def summary_ratios(summary: DataFrame) -> DataFrame:
    """Marketing ROI, cash flow per day, share of promo / holiday days."""
    d = F.col("total_days").cast("double")
    return summary.withColumns({
        "marketing_roi": F.col("avg_revenue_per_euro_marketing"),
        "operating_cash_flow_per_day": F.col("total_operating_cash_flow_eur") / d,
        "promo_days_pct": F.col("promo_days_count") / d * 100,
        "holiday_days_pct": F.col("holiday_days_count") / d * 100,
    })


# -------------------------------------------------------------------------- A12
def basic_cards(daily: DataFrame, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Three sums and the *unweighted* mean margin (A12; cf. ratio-of-sums in A5)."""
    return daily.groupBy(*keys).agg(
        F.sum(D_SALES).alias("total_sales_revenue"),
        F.sum("gross_profit_eur").alias("total_gross_profit"),
        F.avg("gross_profit_margin_pct").alias("avg_gross_margin_pct"),
        F.sum("predicted_operating_cash_flow_eur").alias("total_operating_cash_flow"))


# ----------------------------------------------------------------------- A26-A29
def _guarded_corr(x: str, y: str) -> Column:
    """Pearson r from population moments; NULL when either side is constant.

    Built from ``covar_pop`` / ``stddev_pop`` so the only division sits
    inside the guard: Spark 4's ``corr`` raises on a constant column under
    ANSI even when wrapped in ``when`` (the aggregate is evaluated eagerly).
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    sx, sy = F.stddev_pop(xs), F.stddev_pop(ys)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(xs, ys) / (sx * sy))


def sensitivity(fact: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, digits: int = 4) -> DataFrame:
    """Driver sensitivities per scenario (A26-A28), one aggregation:

    competitor index vs revenue, inflation and confidence vs revenue, and
    temperature vs volume (r, slope, intercept, R^2 of the least-squares line).
    """
    t, v = F.col(TEMPERATURE).cast("double"), F.col(VOLUME).cast("double")
    vt = F.var_pop(t)
    slope = F.when(vt > 0, F.covar_pop(t, v) / vt)
    intercept = F.when(vt > 0, F.avg(v) - F.covar_pop(t, v) / vt * F.avg(t))
    r = _guarded_corr(TEMPERATURE, VOLUME)
    rnd = lambda c: round_stat(c, digits)
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        rnd(_guarded_corr(COMPETITOR, REVENUE)).alias("competitor_sensitivity"),
        rnd(_guarded_corr(INFLATION, REVENUE)).alias("inflation_sensitivity"),
        rnd(_guarded_corr(CONFIDENCE, REVENUE)).alias("confidence_sensitivity"),
        rnd(r).alias("temperature_volume_corr"),
        rnd(slope).alias("temperature_volume_slope"),
        rnd(intercept).alias("temperature_volume_intercept"),
        rnd(r * r).alias("temperature_volume_r2"),
    )


def romi(fact: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, sales: str = REVENUE,
         marketing: str = MARKETING) -> DataFrame:
    """Return on marketing investment (A29): incremental sales / spend.

    Incremental sales = (mean sales on days with spend - mean on days
    without) x number of days with spend; NULL when either group is empty or
    no money was spent.
    """
    has = F.col(marketing) > 0
    agg = fact.groupBy(*keys).agg(
        F.count_if(has).alias("days_with_marketing"),
        F.count_if(~has).alias("days_without_marketing"),
        F.sum(F.when(has, F.col(sales))).alias("_sw"),
        F.sum(F.when(~has, F.col(sales))).alias("_so"),
        F.sum(F.col(marketing)).alias("total_marketing"))
    avg_w = F.col("_sw").cast("double") / F.col("days_with_marketing")
    avg_o = F.col("_so").cast("double") / F.col("days_without_marketing")
    valid = (F.col("days_with_marketing") > 0) & (F.col("days_without_marketing") > 0) & \
            (F.col("total_marketing") > 0)
    incr = (avg_w - avg_o) * F.col("days_with_marketing")
    return agg.select(
        *keys, "days_with_marketing", "days_without_marketing",
        F.when(valid, incr).alias("incremental_sales"),
        F.when(valid, incr / F.col("total_marketing").cast("double")).alias("romi"))
