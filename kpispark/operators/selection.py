"""Exact order statistics by radix selection: no sort, no copy of the values, no sample.

A double gets a 64-bit integer that orders like it (sign, exponent, mantissa).
Pass by pass, 16 bits of it are histogrammed - only within the bins that hold
a wanted rank, so a pass shuffles partial counts, at most 65,536 bins per
column and wanted bin - and a running sum finds the bin of each rank.  A bin
whose smallest and largest value are equal is the answer; after four passes
every bin is.  The driver holds the wanted ranks, nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 16
MANTISSA = 52
LEAST_EXPONENT, MOST_EXPONENT = -1022, 1023


def order_key(x: Column) -> Column:
    """A bigint that orders like the double ``x``; both zeros are alike, NaN comes last, null stays null.

    Division by a power of two is exact, so the mantissa is, too; the
    logarithm may be one off near powers of two, which is mended.
    """
    size = F.abs(x)
    guess = F.greatest(F.lit(LEAST_EXPONENT), F.least(F.lit(MOST_EXPONENT), F.coalesce(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT)))).cast("int")
    rest = size / F.pow(F.lit(2.0), guess)
    exponent = F.when(rest >= 2.0, guess + 1).when((rest < 1.0) & (guess > LEAST_EXPONENT), guess - 1).otherwise(guess)
    part = (size / F.pow(F.lit(2.0), exponent) * F.lit(float(1 << MANTISSA))).cast("long")
    key = (exponent - LEAST_EXPONENT).cast("long") * F.lit(1 << MANTISSA) + part
    top = F.lit(2047 << MANTISSA)
    return (F.when(x.isNull(), F.lit(None).cast("long")).when(F.isnan(x), top + 1)
            .when(size == float("inf"), F.when(x > 0, top).otherwise(-top))
            .otherwise(F.when(x < 0, -key).otherwise(key)))


def values_at(df: DataFrame, wanted: Mapping[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of double columns (nulls have none): (column, rank) -> value.

    Reads ``df`` once per pass, usually two or three times: keep it if it is
    dear.  Ranks outside a column are left out.
    """
    spark, names = df.sparkSession, [c for c, r in wanted.items() if r]
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, int(r)): (0, int(r)) for c in names for r in wanted[c]}   # -> (bin, rank within it)
    for shift in range(64 - STEP, -1, -STEP):
        if not open_:
            break
        first = shift == 64 - STEP
        entries = []
        for i, c in enumerate(names):
            inside = sorted({b for (name, _), (b, _) in open_.items() if name == c})
            key = order_key(F.col(c))
            keep = F.col(c).isNotNull() if first else F.shiftright(key, shift + STEP).isin(inside) if inside else F.lit(False)
            entries.append(F.struct(F.lit(i).alias("c"), F.when(keep, F.shiftright(key, shift)).alias("bin"), F.col(c).alias("v")))
        bins = df.select(F.inline(F.array(*entries))).where("bin IS NOT NULL").groupBy("c", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins = bins.withColumn("inside", F.lit(0).cast("long") if first else F.shiftright("bin", STEP))
        upto = Window.partitionBy("c", "inside").orderBy("bin")           # at most 2**STEP bins
        bins = bins.withColumn("upto", F.sum("n").over(upto))
        asked = spark.createDataFrame([(names.index(c), b, at, r) for (c, r), (b, at) in open_.items()],
                                      "c int, inside long, at long, rank long")
        hits = bins.join(F.broadcast(asked), ["c", "inside"]).where("upto - n <= at AND at < upto").collect()
        open_ = {}
        for h in hits:  # one row per open rank
            if h["low"] == h["high"] or math.isnan(h["low"]):
                found[names[h["c"]], h["rank"]] = h["low"]
            else:
                open_[names[h["c"]], h["rank"]] = (h["bin"], h["at"] - (h["upto"] - h["n"]))
    return found


def quantile(values: Mapping[tuple[str, int], float], column: str, n: int, q: float) -> float | None:
    """The linearly interpolated quantile from the values at the two ranks around (n - 1) q."""
    if not n:
        return None
    at = q * (n - 1)
    low, high = values[column, math.floor(at)], values[column, math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def quantile_ranks(n: int, quantiles: Sequence[float]) -> list[int]:
    return sorted({f(q * (n - 1)) for q in quantiles for f in (math.floor, math.ceil)}) if n else []
