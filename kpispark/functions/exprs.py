"""Scalar Column -> Column expressions (guards, KPIs, rules).

All of these stay inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HOLIDAYS_FORECAST, HOLIDAYS_RESTAURANT, HOLIDAYS_SALES_DATA, MONEY  # noqa: F401


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp0(x) -> Column:
    """Python ``max(0, x)`` on doubles: negatives, NULL and NaN become 0 (F1).

    ``greatest(0, x)`` is not equivalent: it returns NaN for NaN, and NaN
    sorts above every number in Spark, so NaN is excluded explicitly.
    """
    x = _c(x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0), x).otherwise(F.lit(0.0))


def clamp0_money(x) -> Column:
    """F1 for exact decimal measures: keeps the DECIMAL type."""
    x = _c(x)
    return F.when(x.isNotNull() & (x > 0), x).otherwise(F.lit(0).cast(MONEY))


def safe_div(num, den, fallback: float = 0.0) -> Column:
    """``num / den`` when ``den > 0`` else ``fallback`` (F2), in double.

    A negative denominator also yields the fallback, as in the original.
    """
    num, den = _c(num).cast("double"), _c(den).cast("double")
    return F.when(den > 0, num / den).otherwise(F.lit(float(fallback)))


def cap(x, lo: float = -100.0, hi: float = 100.0) -> Column:
    """Clip to ``[lo, hi]``."""
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def round_half_up(x, digits: int = 2) -> Column:
    """Round a double to ``digits`` places: ``floor(x * 10^d + 0.5) / 10^d``.

    Plain IEEE arithmetic, so it stays in generated code (no BigDecimal) and
    gives the same double in any engine.  It rounds the double product
    ``x * 10^d`` half up, so it can differ from Python's correctly rounded,
    half-even ``round`` by one unit in the last place at (near-)ties:
    2.675 * 100 is exactly 267.5 in binary, giving 2.68 where Python gives
    2.67.  Never yields -0.0.
    """
    scale = float(10 ** digits)
    return F.floor(_c(x).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_stat(x, digits: int = 4) -> Column:
    """Rounding for statistics (means, std, correlations, sin/cos).

    Goes through ``decimal(38,6)`` first: that absorbs the last-bit
    differences that summation order or the math library introduce between
    engines, which the floor form would turn into a different last digit at a
    tie.  Costs a BigDecimal step, so it is used on aggregates, not rows.
    """
    return F.round(_c(x).cast("decimal(38,6)"), digits).cast("double")


def round_money(x, digits: int = 2) -> Column:
    """Round an exact decimal; stays exact."""
    return F.round(_c(x), digits)


def to_double(x) -> Column:
    return _c(x).cast("double")


def gross_profit(sales, cogs) -> Column:
    return _c(sales) - _c(cogs)


def operating_cash_flow(sales, cogs, marketing) -> Column:
    return _c(sales) - _c(cogs) - _c(marketing)


def business_kpis(sales, cogs, volume, marketing, digits: int | None = 2,
                  exact: bool = False) -> dict[str, Column]:
    """The eight row KPIs (F5) from clamped inputs, rounded once at the end.

    With ``exact`` (all inputs DECIMAL) gross profit and cash flow stay exact
    DECIMAL; ratios are always double.  ``digits=None`` leaves values unrounded.
    """
    s, c, v, m = (_c(x) for x in (sales, cogs, volume, marketing))
    gp = gross_profit(s, c)
    ocf = operating_cash_flow(s, c, m)
    ratios = {
        "gross_profit_margin_pct": cap(safe_div(to_double(gp) * 100, s)),
        "asp_per_litre_eur": safe_div(s, v),
        "cogs_per_litre": safe_div(c, v),
        "marketing_spend_ratio": safe_div(to_double(m) * 100, s),
        "revenue_per_euro_marketing": safe_div(s, m),
        "litres_per_euro_marketing": safe_div(v, m),
    }
    if digits is None:
        keep = (lambda x: x) if exact else to_double
        out = {"gross_profit_eur": keep(gp), "predicted_operating_cash_flow_eur": keep(ocf)}
        out.update(ratios)
    else:
        rnd = (lambda x: F.round(x, digits)) if exact else (lambda x: round_half_up(x, digits))
        out = {"gross_profit_eur": rnd(gp), "predicted_operating_cash_flow_eur": rnd(ocf)}
        out.update({k: round_half_up(v_, digits) for k, v_ in ratios.items()})
    order = ["gross_profit_eur", "gross_profit_margin_pct", "asp_per_litre_eur",
             "predicted_operating_cash_flow_eur", "cogs_per_litre", "marketing_spend_ratio",
             "revenue_per_euro_marketing", "litres_per_euro_marketing"]
    return {k: out[k] for k in order}


def cogs_ratio_pct(sales, cogs, digits: int | None = 2) -> Column:
    """COGS as a percentage of revenue."""
    r = safe_div(to_double(_c(cogs)) * 100, sales)
    return r if digits is None else round_half_up(r, digits)


def promo_day_rule(day_of_month) -> Column:
    """Promotional day when day-of-month % 7 == 0 or % 15 == 0."""
    d = _c(day_of_month)
    return F.when((d % 7 == 0) | (d % 15 == 0), F.lit(1)).otherwise(F.lit(0))


def holiday_rule(date_col, days=HOLIDAYS_SALES_DATA) -> Column:
    """1 when (month, day) is in the calendar, else 0."""
    d = _c(date_col)
    cond = F.lit(False)
    for m, dd in days:
        cond = cond | ((F.month(d) == m) & (F.dayofmonth(d) == dd))
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def seasonal_factor(day_of_year) -> Column:
    """1 + 0.2 * sin(2*pi*doy/365) (F16)."""
    return F.lit(1.0) + F.lit(0.2) * F.sin(F.lit(2.0) * F.pi() * _c(day_of_year) / F.lit(365))


def lookup(key, mapping: Mapping[str, float], default: float = 1.0) -> Column:
    """Map lookup with a default for missing keys."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in mapping.items()))
    return F.coalesce(m[_c(key)], F.lit(float(default)))


def error(actual, predicted) -> Column:
    """Residual actual - predicted."""
    return _c(actual) - _c(predicted)


def error_pct(actual, predicted) -> Column:
    """(actual - predicted) / actual * 100; NULL for a zero actual."""
    a = to_double(actual)
    return F.when(a != 0, to_double(error(actual, predicted)) / a * 100)


def within(actual, predicted, tolerance: float) -> Column:
    """1.0 when |error/actual| <= tolerance; a zero actual never counts (Q8)."""
    a = to_double(actual)
    inside = F.when(F.abs(to_double(error(actual, predicted)) / a) <= tolerance, F.lit(1.0))
    return F.when(a != 0, F.coalesce(inside, F.lit(0.0))).otherwise(F.lit(0.0))


def flag_to_bool(x) -> Column:
    return _c(x).cast("boolean")


def date_to_iso(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd")


def try_numeric(x) -> Column:
    """Coerce to double; unparseable values become NULL (P20)."""
    return F.expr(f"try_cast(`{x}` as double)") if isinstance(x, str) else x.try_cast("double")
