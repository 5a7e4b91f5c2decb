"""Calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, TIME_FEATURES
from .exprs import _c


def day_of_week(d) -> Column:
    """Monday = 0 ... Sunday = 6 (F8); ``F.dayofweek`` would give Sunday = 1."""
    return F.weekday(_c(d))


def iso_week(d) -> Column:
    """ISO-8601 week number (F10): 2021-01-01 is week 53."""
    return F.weekofyear(_c(d))


def basic_calendar(d) -> dict[str, Column]:
    """The 5-feature bundle of the domain models."""
    d = _c(d)
    return {
        "day_of_week": day_of_week(d),
        "month": F.month(d),
        "year": F.year(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": iso_week(d),
    }


def full_calendar(d) -> dict[str, Column]:
    """The 11-feature bundle of the generic engine, incl. cyclical terms."""
    d = _c(d)
    two_pi = F.lit(2.0) * F.pi()
    month, dow = F.month(d), day_of_week(d)
    feats = {
        "year": F.year(d),
        "month": month,
        "day": F.dayofmonth(d),
        "day_of_week": dow,
        "day_of_year": F.dayofyear(d),
        "week_of_year": iso_week(d),
        "quarter": F.quarter(d),
        "month_sin": F.sin(two_pi * month / F.lit(12)),
        "month_cos": F.cos(two_pi * month / F.lit(12)),
        "day_sin": F.sin(two_pi * dow / F.lit(7)),
        "day_cos": F.cos(two_pi * dow / F.lit(7)),
    }
    return {k: feats[k] for k in TIME_FEATURES}


def add_basic_calendar(df: DataFrame, date_col: str = DATE) -> DataFrame:
    return df.withColumns(basic_calendar(F.to_date(F.col(date_col))))


def add_full_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Adds the 11 generic calendar features; the date column is parsed to a date."""
    d = F.to_date(F.col(date_col))
    return df.withColumns(full_calendar(d))
