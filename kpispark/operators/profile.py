"""Schema profiling and dataset description.

Profiling reads the schema on the driver and runs *one* aggregation over all
rows: whether every value of a string column parses as a date, and distinct
counts (a set of the smallest hashes, so memory per column is fixed and small
counts are exact).  It returns a small ``TableProfile`` (one entry per
column), never data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .selection import quantile, quantile_ranks, values_at

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
# Date formats accepted by the string date probe.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm:ss"]


@dataclass
class TableProfile:
    date: str | None = None
    date_hits: list[str] = field(default_factory=list)
    numerical: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    potential_targets: list[str] = field(default_factory=list)

    def default_targets(self, k: int = 3) -> list[str]:
        return self.potential_targets[:k]

    def as_dict(self) -> dict:
        return asdict(self)


#: Digit pattern of each format: a value can only fit the format whose pattern it has.
DATE_SHAPES = {re.sub("[yMdHms]", "9", f.replace("'T'", "T")): f for f in DATE_FORMATS}


def date_shape(c: Column) -> Column:
    """The value's digit pattern where its length is that of a date pattern, else null."""
    lengths = sorted({len(s) for s in DATE_SHAPES})
    return F.when(F.octet_length(c).isin(lengths), F.translate(c, "0123456789", "9999999999"))


def parse_by_shape(c: Column, shape: Column) -> Column:
    """The timestamp of a value by the one format that its shape fits, else null: at most one parse a value."""
    out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for s, f in DATE_SHAPES.items():
        out = out.when(shape == s, F.try_to_timestamp(c, F.lit(f)))
    return out


def date_shapes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A small histogram per string column: (column_name, format, n, parsed); format null for values of no date shape.

    Nulls are not counted.  One pass with map-side counts, one row per column
    and format.
    """
    fmt = F.create_map(*[F.lit(x) for pair in DATE_SHAPES.items() for x in pair])
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in cols])))
    long = long.where("v IS NOT NULL").withColumn("shape", date_shape(F.col("v")))
    long = long.select("column_name", F.try_element_at(fmt, F.col("shape")).alias("format"),
                       parse_by_shape(F.col("v"), F.col("shape")).isNotNull().alias("ok"))
    return long.groupBy("column_name", "format").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("parsed"))


def distinct_estimate(c: str, as_text: bool = False) -> Column:
    """Distinct values of a column by a mergeable set of the smallest value hashes (a theta sketch).

    Exact while there are fewer than 2**12 of them; of fixed size whatever the
    values' frequencies; nulls do not count.
    """
    value = F.col(c).cast("string") if as_text else F.col(c)  # maps have no hash of their own
    return F.theta_sketch_estimate(F.theta_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value))))


def profile(df: DataFrame, date_override: str | None = None,
            max_distinct: int = S.CATEGORICAL_MAX_DISTINCT) -> TableProfile:
    """Detect the date column, numeric and categorical columns and likely targets.

    Rules (Q12-Q13): a date/timestamp column, or any column whose name contains
    "date" (the last hit wins; every hit leaves the feature set), or a string
    column whose non-null values all parse as dates (one at least).  Numeric types
    are numerical; names containing a target keyword are potential targets.
    Strings are categorical, as are other types with < 20 distinct values.
    """
    prof = TableProfile()
    fields = df.schema.fields
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)
               and "date" not in f.name.lower()]
    others = [f.name for f in fields
              if not isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType,
                                             T.TimestampNTZType) + NUMERIC_TYPES)]
    # one aggregate over all rows: do all values parse, and how many differ
    shapes = {c: f"_shape_{i}" for i, c in enumerate(strings)}
    shaped = df.select(*strings, *others, *[date_shape(F.col(c)).alias(s) for c, s in shapes.items()])
    aggs = [((F.count(F.col(c)) == F.count(parse_by_shape(F.col(c), F.col(s)))) & (F.count(F.col(c)) > 0)).alias(c)
            for c, s in shapes.items()]
    aggs += [distinct_estimate(c, isinstance(df.schema[c].dataType, T.MapType)).alias(c) for c in others]
    row = shaped.agg(*aggs).collect()[0] if aggs else {}
    parses = {c: bool(row[c]) for c in strings}
    distinct = {c: row[c] or 0 for c in others}
    for f in fields:
        name, dt = f.name, f.dataType
        is_date_type = isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if is_date_type or "date" in name.lower() or parses.get(name, False):
            prof.date_hits.append(name)
            prof.date = name
            continue
        if isinstance(dt, NUMERIC_TYPES):
            prof.numerical.append(name)
            if any(k in name.lower() for k in S.TARGET_KEYWORDS):
                prof.potential_targets.append(name)
        elif isinstance(dt, T.StringType) or distinct.get(name, max_distinct) < max_distinct:
            prof.categorical.append(name)
    if date_override:
        prof.date = date_override
    return prof


def profile_frame(df: DataFrame, prof: TableProfile | None = None) -> DataFrame:
    """The profile as a small DataFrame: one row per column with its role."""
    prof = prof or profile(df)
    rows = []
    for f in df.schema.fields:
        if f.name in prof.date_hits:
            role = "date"
        elif f.name in prof.numerical:
            role = "numerical"
        elif f.name in prof.categorical:
            role = "categorical"
        else:
            role = "ignored"
        rows.append((f.name, f.dataType.simpleString(), role, f.name in prof.potential_targets,
                     f.name == prof.date))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, role string, potential_target boolean, "
              "is_date_column boolean")


def dataset_info(df: DataFrame, prof: TableProfile | None = None, sample_rows: int = 3) -> dict:
    """Rows, columns, feature lists and a few sample rows."""
    prof = prof or profile(df)
    return {"rows": df.count(), "columns": df.columns, **prof.as_dict(),
            "sample": [r.asDict() for r in df.limit(sample_rows).collect()]}


def info_frame(df: DataFrame, prof: TableProfile | None = None) -> DataFrame:
    """The dataset info as (item, value) rows: row and column counts, the date column, feature lists in column order."""
    prof = prof or profile(df)
    told = {"columns": str(len(df.columns)), "date_column": prof.date, "numerical": ",".join(prof.numerical),
            "categorical": ",".join(prof.categorical), "potential_targets": ",".join(prof.potential_targets),
            "default_targets": ",".join(prof.default_targets())}
    rows = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("rows").alias("item"), "value")
    return rows.unionByName(df.sparkSession.createDataFrame(list(told.items()), "item string, value string"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, quartiles: bool = True) -> DataFrame:
    """count / mean / sample std / min / quartiles / max per numeric column.

    Long output, one row per column.  Counts, means and extremes are one wide
    aggregate; quartiles interpolate linearly between the two values around
    (n - 1) q, which radix selection finds (``selection``).  The columns are
    kept in Spark's cache meanwhile, so the input is computed once.
    """
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)])
    fields = "column_name string, count long, mean double, std double, min double, max double"
    fields += "".join(f", {n} double" for _, n in QUARTILES) if quartiles else ""
    if not cols:
        return df.sparkSession.createDataFrame([], fields)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        one = values.agg(*[F.struct(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).alias(f"_{i}")
                           for i, c in enumerate(cols)]).first()
        rows = [[c, *one[f"_{i}"]] for i, c in enumerate(cols)]
        if quartiles:
            shares = [q for q, _ in QUARTILES]
            found = values_at(values, {c: quantile_ranks(n, shares) for c, n, *_ in rows})
            rows = [[*r, *[quantile(found, r[0], r[1], q) for q in shares]] for r in rows]
    finally:
        values.unpersist()
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], fields)


QUARTILES = [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]


def distinct_below(df: DataFrame, col: str, limit: int = S.CATEGORICAL_MAX_DISTINCT) -> bool:
    """Distinct count < limit (A20), exact for limits up to 2**12 (see ``distinct_estimate``)."""
    return (df.agg(distinct_estimate(col).alias("n")).first()["n"] or 0) < limit


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns to double; unparseable values become NULL (P20)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols if c in df.columns})


def feature_default(name: str) -> float:
    """Value of a numeric feature that is missing when scoring, by name rule."""
    low = name.lower()
    if "lag" in low:
        return float(S.PREDICT_LAG)
    if "temp" in low:
        return float(S.PREDICT_TEMP)
    if "rate" in low or "index" in low:
        return float(S.PREDICT_RATE)
    return 0.0


def fill_missing_features(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Add absent feature columns with name-rule defaults (P22): categorical
    'default'; names with 'lag' 1000; 'temp' 20; 'rate'/'index' 1; else 0."""
    add = {c: F.lit(S.CATEGORICAL_DEFAULT) for c in categorical if c not in df.columns}
    add |= {c: F.lit(feature_default(c)) for c in numerical if c not in df.columns}
    return df.withColumns(add) if add else df
