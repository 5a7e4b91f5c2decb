"""Radix selection against numpy; date shapes; exact small distinct counts."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpispark.operators import profile, selection


def bits(x):
    """The order-preserving key by the machine's own bits."""
    if math.isnan(x):
        return (2047 << 52) + 1
    b = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -b if x < 0 else b


ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       math.inf, -math.inf, math.nan, 0.1, 3.0, 1 - 2 ** -53, 1 + 2 ** -52, 2.0 ** 52 + 1, *[2.0 ** k for k in range(-1074, 1024, 37)],
       *[math.nextafter(2.0 ** k, 0) for k in range(-1020, 1024, 41)]]


def test_order_keys_are_the_doubles_bits(spark):
    rng = np.random.default_rng(1)
    values = ODD + (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist()
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.order_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in got] == [bits(r.v) for r in got]


@pytest.mark.parametrize("kind", ["odd", "ties", "spread", "one"])
def test_values_at_ranks(spark, kind):
    rng = np.random.default_rng(3)
    values = {"odd": [v for v in ODD if not math.isnan(v)], "ties": rng.integers(0, 4, 500).astype(float).tolist(),
              "spread": (rng.normal(size=800) * 10.0 ** rng.integers(-300, 300, 800)).tolist(), "one": [7.25]}[kind]
    df = spark.createDataFrame([(v, 1.0) for v in values] + [(None, 2.0)], "v double, w double").repartition(3)
    ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
    got = selection.values_at(df, {"v": ranks, "w": [0, len(values)], "none": []})
    order = np.sort(np.array(values))
    assert {r: got["v", r] for r in ranks} == {r: order[r] for r in ranks}
    assert got["w", len(values)] == 2.0 and got["w", 0] == 1.0
    assert selection.values_at(df, {"v": [len(values) + 5]}) == {}


def test_describe_equals_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), int(b), None) for a, b in zip(rng.exponential(size=333), rng.integers(-5, 5, 333))] + [(None, 3, None)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(4)
    got = {r.column_name: r for r in profile.describe(df).collect()}
    for i, name in enumerate("ab"):
        x = np.array([r[i] for r in rows if r[i] is not None], float)
        r = got[name]
        assert (r["count"], r.min, r.max) == (len(x), x.min(), x.max())
        assert [r.mean, r.std, r.p25, r.p50, r.p75] == pytest.approx([x.mean(), x.std(ddof=1), *np.quantile(x, [.25, .5, .75])], rel=1e-12)
    assert got["c"]["count"] == 0 and got["c"].p50 is None and got["c"].mean is None
    assert profile.describe(df.limit(0)).where("count = 0").count() == 3
    assert profile.describe(df.select(F.lit("x").alias("t"))).count() == 0
    assert "p25" not in profile.describe(df, quartiles=False).columns


def test_few_values_many_times(spark):
    df = spark.range(2000).select((F.col("id") % 7).cast("double").alias("v"))
    assert selection.values_at(df, {"v": [1000]}) == {("v", 1000): float(sorted(i % 7 for i in range(2000))[1000])}


def test_date_shapes(spark):
    rows = [("2024-01-31", "x"), ("2024-02-30", "2024/01/05"), ("2024-1-3", "05-11-2023"), (None, "11/05/2023"),
            ("2024-01-31 10:11:12", "2024-01-31T10:11:12"), ("9999-99-99", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r.column_name, r.format): (r.n, r.parsed) for r in profile.date_shapes(df, ["a", "b"]).collect()}
    assert got == {("a", "yyyy-MM-dd"): (3, 1), ("a", None): (1, 0), ("a", "yyyy-MM-dd HH:mm:ss"): (1, 1), ("b", None): (2, 0),
                   ("b", "yyyy/MM/dd"): (1, 1), ("b", "dd-MM-yyyy"): (1, 1), ("b", "MM/dd/yyyy"): (1, 1), ("b", "yyyy-MM-dd'T'HH:mm:ss"): (1, 1)}


@pytest.mark.parametrize("fmt,value", [("yyyy-MM-dd", "2021-03-04"), ("yyyy/MM/dd", "2021/03/04"), ("dd-MM-yyyy", "04-03-2021"),
                                       ("MM/dd/yyyy", "03/04/2021"), ("yyyy-MM-dd HH:mm:ss", "2021-03-04 05:06:07"),
                                       ("yyyy-MM-dd'T'HH:mm:ss", "2021-03-04T05:06:07")])
def test_every_format_has_its_shape(spark, fmt, value):
    df = spark.createDataFrame([(value,), (None,)], "s string")
    assert profile.profile(df).date == "s"
    assert profile.profile(df.unionByName(spark.createDataFrame([("no date",)], "s string"))).date is None
    assert [(r.format, r.n) for r in profile.date_shapes(df, ["s"]).collect()] == [(fmt, 1)]


@pytest.mark.parametrize("n", [19, 20, 21])
def test_roles_at_the_distinct_limit(spark, n):
    """Columns that are neither text nor numbers: categorical below 20 distinct values, exactly; one value holds most rows."""
    df = spark.range(4000).select(F.array(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % n)).alias("tags"),
                                  F.create_map(F.lit("k"), F.col("id") % n).alias("m"), F.lit(None).cast("boolean").alias("none"))
    prof = profile.profile(df)
    assert ("tags" in prof.categorical) == ("m" in prof.categorical) == (n < 20)
    assert "none" in prof.categorical
    assert profile.distinct_below(df.select(F.col("tags")), "tags", n + 1) and not profile.distinct_below(df, "tags", n)
