"""Lag features, global row positions, splits and data preparation
(W1-W4, P10, P14, M5, M7).

Two lag strategies
------------------
``window``     ``lag(c, k) OVER (PARTITION BY group ORDER BY date)``.  One task
               holds a whole group, so use it only when a group's size has a
               bound that does not grow with the data - e.g. the sales fact,
               which has exactly one row per (segment, date), so a group never
               exceeds the number of calendar days however large the input.
``positions``  Skew-proof: every row gets its global position in
               (group, date, tie-break) order (``global_positions``); positions
               are cut into fixed-size blocks, each block gets the tail of the
               previous one, and ``lag`` runs per block.  Range partitioning
               splits a hot group over many tasks and a block never exceeds its
               fixed size, so no task ever holds a whole group.  Required when
               there is no group at all (W3), where a window would run in a
               single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DATE, DEFAULT_LAGS, SEGMENT_KEYS
from ..session import cut_lineage

POS = "_pos"


def _tiebreak(df: DataFrame) -> Column:
    """Deterministic order among rows that tie on (group, date).

    The original sorts with an unstable sort, so any fixed order is faithful;
    a hash of the whole row is stable under recomputation.
    """
    return F.xxhash64(*[F.col(c) for c in df.columns])


def global_positions(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                     num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``_pos``: 0-based position of each row in (group, order, tie-break) order.

    Distributed like ``zipWithIndex`` but without leaving the DataFrame API:
    range-partition on the full sort key (sampling splits even a single hot
    key range over many tasks), sort within partitions, number rows inside
    each partition, then add the row count of all earlier partitions.  The
    per-partition count table has one row per partition - a bound set by
    the partition count, not the data - so its prefix sum runs in one small
    task and is broadcast back.

    With ``materialize`` the numbered rows are written to the shared
    checkpoint folder first (``session.cut_lineage``), so both uses of them
    (counts and rows) read the same fixed data even if executors are lost and
    tasks re-run.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in list(group_cols) + list(order_cols)] + [F.col("_tb")]
    src = df.withColumn("_tb", _tiebreak(df))
    if materialize:
        # the range partitioner samples its input in a separate job; keep the
        # input for the second (numbering) job instead of recomputing it
        src = src.persist(StorageLevel.MEMORY_AND_DISK)
    numbered = (src.repartitionByRange(n, *keys)
                   .sortWithinPartitions(*keys)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_rip", F.monotonically_increasing_id()
                               - F.shiftleft(F.col("_pid").cast("long"), 33)))
    if materialize:
        numbered = cut_lineage(numbered)
        src.unpersist()
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # Bounded by the number of partitions: a single-partition window is fine here.
    offsets = counts.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_pid")
                    .withColumn(POS, F.col("_off") + F.col("_rip"))
                    .drop("_pid", "_rip", "_off", "_tb"))


def lag_features(df: DataFrame, target_cols: Sequence[str], group_cols: Sequence[str] | None = None,
                 date_col: str = DATE, lags: Sequence[int] = DEFAULT_LAGS,
                 strategy: str = "positions", block_rows: int | None = None) -> DataFrame:
    """``<target>_lag<k>`` for every target and lag: the value k rows earlier in
    the same group, ordered by date (row lag, not calendar lag) (W1-W3).

    ``positions``: rows are numbered globally (``global_positions``) and cut
    into blocks of ``block_rows`` consecutive positions.  Each block also
    receives the last ``max(lags)`` rows of the block before it ("carry-in"),
    so ``lag`` over a window per block sees every source row it needs; a lag
    value is kept only when its source row is in the same group.  One shuffle
    for all lags, and no window partition ever exceeds block_rows + max(lags)
    rows, however the groups are skewed.  By default a block is
    rows / shuffle partitions (one count over the checkpointed rows), so the
    window work spreads over as many tasks as the shuffle has partitions.
    """
    group_cols = list(group_cols or [])
    names = [(t, k, f"{t}_lag{k}") for t in target_cols for k in lags]
    if strategy == "window":
        if not group_cols:
            raise ValueError("window strategy needs group columns; use strategy='positions'")
        w = Window.partitionBy(*group_cols).orderBy(F.col(date_col))
        return df.withColumns({name: F.lag(F.col(t), k).over(w) for t, k, name in names})
    if strategy != "positions":
        raise ValueError(f"unknown strategy {strategy!r}")
    reach = max(lags)
    indexed = global_positions(df, [date_col], group_cols)
    if block_rows is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Parquet footers answer this count without reading rows
        block_rows = -(-indexed.count() // max(parts, 1))
    block_rows = max(int(block_rows), reach + 1)
    block = F.floor(F.col(POS) / F.lit(block_rows))
    # one read: a row goes to its own block and, near the block's end, to the next one too
    own = F.struct(block.alias("_blk"), F.lit(False).alias("_carry"))
    carry = F.struct((block + 1).alias("_blk"), F.lit(True).alias("_carry"))
    both = indexed.select("*", F.inline(F.when(
        F.col(POS) % F.lit(block_rows) >= F.lit(block_rows - reach), F.array(own, carry)).otherwise(F.array(own))))
    w = Window.partitionBy("_blk").orderBy(POS)
    gkey = F.struct(*[F.col(g) for g in group_cols]) if group_cols else None

    def same_group(k: int) -> Column:
        return F.lit(True) if gkey is None else (F.lag(gkey, k).over(w) == gkey)

    lagged = both.withColumns({name: F.when(same_group(k), F.lag(F.col(t), k).over(w))
                               for t, k, name in names})
    return lagged.filter(~F.col("_carry")).select(*df.columns, *[name for _, _, name in names])


def domain_lags(fact: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, date_col: str = DATE,
                targets: Sequence[str] = ("Net_Sales_Revenue_EUR", "COGS_EUR", "Net_Sales_Volume_Litres"),
                lags: Sequence[int] = (1,)) -> DataFrame:
    """Lag-1 of revenue, COGS and volume per segment.

    The fact has one row per (segment, date), so a window partition is at most
    the number of calendar days: the window strategy is bounded here.
    """
    return lag_features(fact, targets, keys, date_col, lags, strategy="window")


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any NULL or NaN."""
    return df.na.drop(subset=list(subset) if subset else None)


def date_split(df: DataFrame, cut: str, date_col: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Train = date < cut, test = date >= cut (P10)."""
    d = F.col(date_col).cast("date")
    c = F.to_date(F.lit(cut))
    return df.filter(d < c), df.filter(d >= c)


def label_date_split(df: DataFrame, cut: str, date_col: str = DATE) -> DataFrame:
    d = F.col(date_col).cast("date")
    return df.withColumn("split", F.when(d < F.to_date(F.lit(cut)), "train").otherwise("test"))


def positional_split(df: DataFrame, order_cols: Sequence[str], test_size: float = 0.2,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """First floor(n * (1 - test_size)) rows in (group, order) order are train.

    Note the original sorts by group *then* date, so with groups the test set
    is the last groups, not the last dates (Q5).  Adds ``position`` and
    ``split``.
    """
    indexed = global_positions(df, order_cols, group_cols)
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n").cast("double") * F.lit(1.0 - test_size))
    return (indexed.crossJoin(F.broadcast(n))  # one row
                   .withColumn("split", F.when(F.col(POS) < cut, "train").otherwise("test"))
                   .withColumnRenamed(POS, "position")
                   .drop("_n"))


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                 key_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Random train/test split when there is no date column (M5).

    Rows are ordered by a digest of ``seed`` and their content (``key_cols``
    if these tell the rows apart, else every column as text); the first
    floor(n * (1 - test_size)) train.  The share is exact, and the split is
    the same for any partitioning, recomputation or order of the input.
    Copies of a row have one digest and are interchangeable.
    """
    cols = list(key_cols or df.columns)
    # null and empty differ, and no value can run into the next one
    text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
            for c in cols]
    keyed = df.withColumn("_digest", F.md5(F.concat_ws("|", F.lit(str(seed)), *text)))
    tagged = positional_split(keyed, ["_digest"], test_size).drop("_digest", "position")
    return (tagged.where("split = 'train'").drop("split"), tagged.where("split = 'test'").drop("split"))


def split_report(df: DataFrame, split_col: str = "split", date_col: str = DATE) -> DataFrame:
    """Rows and date span per split."""
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.col(date_col).cast("date")).alias("min_date"),
        F.max(F.col(date_col).cast("date")).alias("max_date"))
