"""Readers and writers.

Everything is a distributed read or write of a DataFrame; model directories
use the Spark ML format (readable from any executor), metrics and metadata
are small Parquet/JSON tables next to them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE, SALES_FACT_SCHEMA


# ------------------------------------------------------------------- sources
def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header (S1).  With ``schema`` no inference pass is made
    (the production path); without it types are inferred (generic upload)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """The domain sales table with its explicit schema, date parsed (S1 + S4)."""
    return read_csv(spark, path, SALES_FACT_SCHEMA)


def from_records(spark: SparkSession, records: Sequence[Mapping], schema: T.StructType | str | None = None
                 ) -> DataFrame:
    """Inline records -> table (S3); for request-sized inputs only."""
    return spark.createDataFrame([dict(r) for r in records], schema=schema)


def parse_dates(df: DataFrame, col: str = DATE, fmt: str | None = None) -> DataFrame:
    """Parse a date column (S4); unparseable values become NULL."""
    c = F.col(col)
    parsed = F.to_date(F.try_to_timestamp(c, F.lit(fmt))) if fmt else F.to_date(F.try_to_timestamp(c))
    if isinstance(df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        parsed = F.to_date(c)
    return df.withColumn(col, parsed)


# --------------------------------------------------------------------- sinks
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column (K1); one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Multi-table report (K2): one Parquet table per logical sheet."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(os.path.join(path, name))


def save_models(models: Mapping[str, PipelineModel], model_dir: str, metrics: DataFrame | None = None,
                schema: Mapping | None = None) -> None:
    """One Spark ML pipeline directory per target (K5), the metric table (rows
    are appended to those of earlier runs) and the data schema as metadata
    (K6), including the date column (Q19)."""
    for target, model in models.items():
        model.write().overwrite().save(os.path.join(model_dir, "models", target))
    if metrics is not None:
        metrics.write.mode("append").parquet(os.path.join(model_dir, "model_metrics"))
    if schema is not None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(dict(schema)),)], "schema_json string") \
             .coalesce(1).write.mode("overwrite").json(os.path.join(model_dir, "schema"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_model(path: str) -> tuple[PipelineModel | None, bool]:
    """Load one pipeline; a missing model gives (None, False), any other fault is raised."""
    spark = SparkSession.getActiveSession()
    if not path_exists(spark, os.path.join(path, "metadata")):
        return None, False
    return PipelineModel.load(path), True


def load_models(spark: SparkSession, model_dir: str, targets: Sequence[str] | None = None
                ) -> tuple[dict[str, PipelineModel], DataFrame | None, dict | None]:
    """Models per target, the metrics table and the schema."""
    schema = None
    if path_exists(spark, os.path.join(model_dir, "schema")):
        row = spark.read.schema("schema_json string").json(os.path.join(model_dir, "schema")).collect()
        schema = json.loads(row[0]["schema_json"]) if row else None
    if targets is None:
        targets = (schema or {}).get("target_columns", [])
    models = {}
    for t in targets:
        m, ok = load_model(os.path.join(model_dir, "models", t))
        if ok:
            models[t] = m
    table = os.path.join(model_dir, "model_metrics")
    metrics = spark.read.parquet(table) if path_exists(spark, table) else None
    return models, metrics, schema
