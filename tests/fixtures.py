"""Small deterministic fixtures of the reference's shapes (see FIXTURES.md)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from kpispark import schema as S

COUNTRIES = ["Germany", "United Kingdom", "France", "Spain"]
CHANNELS = ["Off-Trade", "On-Trade", "E-commerce"]
PRODUCTS = ["Beer", "Wine", "Spirits", "RTD"]


def sales_fixture(spark, days=40, start=dt.date(2023, 12, 1)):
    """Dense domain fact: 48 segments x ``days`` days, deterministic values."""
    rows = []
    for d in range(days):
        date = start + dt.timedelta(days=d)
        for i, c in enumerate(COUNTRIES):
            for j, ch in enumerate(CHANNELS):
                for k, p in enumerate(PRODUCTS):
                    base = 1000 + 100 * i + 10 * j + k
                    rev = base + 50 * math.sin(d / 3.0) + d
                    rows.append((date, c, ch, p, float(10 + k + d % 5), round(rev, 2), round(rev * 0.4, 2),
                                 float(100 + (d % 7) * 5), int(d % 7 == 0 or d % 15 == 0),
                                 100.0 + d % 10, 2.0 + (d % 3) * 0.1, 10.0 + d % 15,
                                 int((date.month, date.day) in [(1, 1), (12, 25)]), 0.8 + (d % 7) * 0.01))
    return spark.createDataFrame(rows, S.SALES_FACT_SCHEMA)


def demo_ecommerce(spark, days=60):
    rows = []
    for d in range(days):
        date = dt.date(2020, 1, 1) + dt.timedelta(days=d)
        for cat in ["Electronics", "Clothing", "Home"]:
            for reg in ["North", "South", "East", "West"]:
                rows.append((date, cat, reg, 1000.0 + d + len(cat), 50.0 + d % 4, 200.0 + d,
                             0.02 + (d % 5) / 1000, 80.0 + d % 9))
    return spark.createDataFrame(rows, "date date, product_category string, region string, daily_sales double, "
                                       "marketing_spend double, customer_visits double, conversion_rate double, "
                                       "avg_order_value double")


def scored_fixture(spark):
    """Hand-sized scored frame with a zero actual and a constant target."""
    rows = []
    base = dt.date(2024, 1, 1)
    for i in range(30):
        d = base + dt.timedelta(days=i)
        rows.append((d, "Germany", "Off-Trade", "Beer", "sales", 100.0 + i, 98.0 + 1.1 * i))
        rows.append((d, "France", "On-Trade", "Wine", "sales", 0.0 if i == 3 else 50.0 + i, 52.0 + i))
        rows.append((d, "Germany", "Off-Trade", "Beer", "cogs", 40.0, 40.0))
    return spark.createDataFrame(rows, S.SCORED_SCHEMA)


def col_values(df, col):
    return [r[0] for r in df.select(col).collect()]


def to_map(df, key, val):
    return {r[key]: r[val] for r in df.select(key, val).collect()}


__all__ = ["sales_fixture", "demo_ecommerce", "scored_fixture", "col_values", "to_map", "F"]
