"""Adapter: the driver's star-schema tables -> a (date x segment) sales fact.

Roles (SURVEY 7.3): date = ship date; Country / Channel / Product_Category =
region name / market segment / part type; revenue = sum of discounted price;
volume = sum of quantity; COGS = sum of quantity * retail price * 0.60;
marketing = sum of price * tax; promo day = any line with discount >= 0.08.

Scale notes
-----------
* Only the needed columns are read (pruned at the Parquet scan).
* ``nation`` and ``region`` are fixed-size code tables (25 and 5 rows at every
  scale factor), so broadcasting them is bounded by definition.  Customer,
  orders and part grow with the data and are joined by shuffle; AQE may still
  turn a join into a broadcast at run time when its measured size is small.
* The aggregate is computed map-side first (partial aggregation), so the
  shuffle after the joins carries at most one row per (task, date, segment).
  The fact has one row per (date, segment): its size is bounded by
  days x segments, not by the number of line items.
* Money is summed exactly (integer hundredths, then one DECIMAL cast) and
  kept DECIMAL; callers cast to double at output, so totals are identical in
  any engine.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import holiday_rule
from ..schema import (CHANNEL, COGS, COMPETITOR, CONFIDENCE, COUNTRY, DATE, HOLIDAY, INFLATION,
                      MARKETING, MONEY, PRODUCT, PROMO, REVENUE, TEMPERATURE, VOLUME)
from ..session import broadcast_if_small, broadcast_limit, estimated_bytes, table_path

# Fixed values of the adapter (ours): cost share of retail price (60 %), promo threshold.
COGS_SHARE_PCT = 60
PROMO_DISCOUNT = 0.08


# Declared schemas of the driver tables (DDL).  Reading with a schema skips
# Spark's footer-inference job on every read; the Parquet reader still checks
# the declared types against the files.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def _cents(c: str):
    """A 2-decimal money/rate column as exact integer hundredths (bigint).

    Products and sums of these stay on Spark's 64-bit integer path (the
    decimal path switches to BigDecimal above 18 digits, ~5x slower) and are
    exact; one cast to DECIMAL at the end gives the same value a DECIMAL sum
    would.  A 64-bit sum overflows only beyond 9.2e14 currency units per
    group, and then raises (ANSI) rather than wrapping.
    """
    # floor(x*100 + 0.5) is plain IEEE arithmetic (Spark's round() on a
    # double goes through BigDecimal, several times slower) and gives the
    # same integer in any engine
    return F.floor(F.col(c) * 100 + F.lit(0.5)).cast("long")


def _units_to_money(total, scale_digits: int):
    """Integer units of 10^-scale_digits -> exact MONEY decimal.

    A multiply by the exact constant 1E-k (a division would go through
    BigDecimal division with a MathContext).  A per-group total must stay
    below 10^18 units (COGS is the largest: 1e-6 units, about 1e17 per
    (day, segment) even at 100 TB); beyond that the cast raises.
    """
    step = F.lit(Decimal(1).scaleb(-scale_digits))     # 1E-k as an exact decimal literal
    return (total.cast("decimal(18,0)") * step).cast(MONEY)


def _avg_exact(c: str):
    """Mean of a 2-dp column as exact sum / count in double: engine independent."""
    return F.sum(_cents(c)).cast("double") / F.lit(100.0) / F.count(F.lit(1))


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (c_custkey, Country, Channel); nation/region are fixed 25/5-row tables."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias(COUNTRY))
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                      .select("n_nationkey", COUNTRY))
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias(CHANNEL))
    # decide on the customer scan (a reliable estimate); adding the fixed-size
    # geography does not change its row count
    small = estimated_bytes(cust) <= broadcast_limit(spark)
    seg = cust.join(geo, cust.c_nationkey == geo.n_nationkey).select("c_custkey", COUNTRY, CHANNEL)
    return F.broadcast(seg) if small else seg


def enriched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their segment columns and part price (all joins inner).

    lineitem is the stream side of every join.  Each dimension (orders,
    customer segment, part) is broadcast only when its own scan is estimated
    under the broadcast threshold; otherwise the join is a shuffle join that
    AQE can still re-plan and de-skew (a hot order / customer / part key is
    split by AQE's skew-join handling).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("l_shipdate").cast("date").alias(DATE))
    orders = broadcast_if_small(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    part = broadcast_if_small(read_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias(PRODUCT), "p_retailprice"))
    cust = customer_segments(spark, sf_dir)
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
              .join(cust, F.col("o_custkey") == cust.c_custkey)
              .join(part, li.l_partkey == part.p_partkey))


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (Date, Country, Channel, Product_Category) with exact DECIMAL measures."""
    lines = enriched_lines(spark, sf_dir)
    fact = lines.groupBy(DATE, COUNTRY, CHANNEL, PRODUCT).agg(
        # revenue in 1e-4 units: price cents x (100 - discount cents)
        _units_to_money(F.sum(_cents("l_extendedprice") * (F.lit(100) - _cents("l_discount"))), 4).alias(REVENUE),
        # COGS in 1e-6 units: quantity cents x retail cents x 60 (= 0.60)
        _units_to_money(F.sum(_cents("l_quantity") * _cents("p_retailprice") * F.lit(COGS_SHARE_PCT)), 6)
        .alias(COGS),
        _units_to_money(F.sum(_cents("l_quantity")), 2).alias(VOLUME),
        _units_to_money(F.sum(_cents("l_extendedprice") * _cents("l_tax")), 4).alias(MARKETING),
        F.max(F.when(F.col("l_discount") >= PROMO_DISCOUNT, 1).otherwise(0)).alias(PROMO),
        _avg_exact("l_quantity").alias(CONFIDENCE),
        _avg_exact("l_tax").alias(INFLATION),
        _avg_exact("l_discount").alias(COMPETITOR),
    )
    # Temperature proxy: a yearly sine, rounded through decimal so engines agree.
    temp = (F.lit(15.0) + F.lit(10.0) * F.sin(F.lit(2.0) * F.pi() * F.dayofyear(DATE) / F.lit(365)))
    return fact.select(
        DATE, COUNTRY, CHANNEL, PRODUCT, VOLUME, REVENUE, COGS, MARKETING, PROMO, CONFIDENCE, INFLATION,
        F.round(temp.cast("decimal(38,10)"), 6).cast("double").alias(TEMPERATURE),
        holiday_rule(DATE).alias(HOLIDAY), COMPETITOR)


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a second, single-month series: one row per (day, event_type)."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"), "event_type", "value")
    return ev.groupBy("date", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col("value").cast("decimal(15,2)")).cast(MONEY).alias("value_amount"))


def write_sales_fact(spark: SparkSession, sf_dir: str, path: str, mode: str = "overwrite") -> None:
    """Materialise the fact once per data load (Parquet, partitioned by year).

    At scale the 6-way join over the line items is the expensive part of
    every report; writing the fact once lets all summaries, rollups and
    accuracy tables start from a table bounded by days x segments.  Filters
    on ``year`` prune whole directories; filters on ``Date`` alone are pushed
    to the Parquet reader (row-group statistics), not turned into partition
    filters.
    """
    (sales_fact(spark, sf_dir).withColumn("year", F.year(DATE))
        .repartition("year").write.mode(mode).partitionBy("year").parquet(path))


def read_sales_fact(spark: SparkSession, path: str) -> DataFrame:
    """Read a fact written by ``write_sales_fact`` (same columns, same order;
    the ``year`` partition column is dropped)."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c != "year"])
