"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy step works on; bounds a Python worker's memory.
SLICE_BYTES = 2 << 20


#: Rows of an Arrow batch at most; documents are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session's Arrow batches are cut to ``BATCH_ROWS`` rows if they are larger."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to differ from all columns (case aside)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession, least: float = 0) -> int:
    """Partitions for an explicit shuffle: the session's setting, or more where the data needs it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(least), 1)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(column)
        sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
