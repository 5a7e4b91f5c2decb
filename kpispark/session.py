"""Session construction and lineage helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark 4 records the Python call site of every Column expression for
    # error messages; that costs ~3-5 ms per expression while plans are built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app_name: str = "kpispark", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster the caller's settings win; locally we pin UTC, AQE and a
    shuffle width that matches the cores.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    settings = dict(LOCAL_DEFAULTS)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we only pick a local scratch
    folder when the setting is absent (tests, local runs).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext handle (e.g. Spark Connect)
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir() or None
    if not current:
        master = spark.conf.get("spark.master", "local")
        if not str(master).startswith("local"):
            # a machine-local folder would leave checkpoint files on each
            # executor's own disk: a cluster must name a shared folder
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/object store) "
                               "before running operators that checkpoint")
        current = tempfile.mkdtemp(prefix="kpispark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, how: str = "parquet") -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and drop its lineage.

    ``parquet`` (default) writes a Parquet table under the shared checkpoint
    folder and reads it back: columnar, compressed and cheaper to write than
    ``checkpoint``'s serialized rows.  ``checkpoint`` uses
    ``DataFrame.checkpoint``.  Never a local checkpoint, whose blocks die with
    the executor.
    """
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_folder(df.sparkSession)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, kind: str = "kpispark") -> str:
    """A new path under the shared checkpoint folder; what is written there goes with ``release``."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{kind}-{uuid.uuid4().hex}")
    _WRITTEN.append((spark, path))
    return path


# copies that this process has written: (session, path)
_WRITTEN: list[tuple[SparkSession, str]] = []


def release() -> int:
    """Delete the copies that ``cut_lineage`` has written so far; returns how many.

    Call it when no DataFrame that reads them is needed any more.  It also
    runs when the process ends, so a session leaves no copies behind.
    """
    gone = 0
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
        except Exception:  # noqa: BLE001 - the JVM may have ended before Python
            return gone
    return gone


atexit.register(release)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (from file sizes and projections; no data pass)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())
    except Exception:  # noqa: BLE001 - no plan handle: report "unknown, large"
        return 1 << 62


def parse_bytes(text: str) -> int:
    """A size as Spark settings write it: ``10485760``, ``10485760b``, ``100MB``, ``1g``, ``-1``."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", str(text).strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * 1024 ** " kmgtp".index(m[2] or " ")


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (-1: no broadcasts)."""
    return parse_bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760") or "10485760")


def broadcast_if_small(df: DataFrame, limit_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its estimated size is under ``limit_bytes``.

    The limit defaults to ``spark.sql.autoBroadcastJoinThreshold`` (-1 disables
    broadcasting).  Above the limit the frame is returned unchanged and the
    join falls back to a shuffle (sort-merge) join, with AQE free to
    re-plan from run-time sizes.  Use it on one pruned base-table scan, whose
    estimate is reliable; the estimate of a join result is not.
    """
    from pyspark.sql import functions as F
    if limit_bytes is None:
        limit_bytes = broadcast_limit(df.sparkSession)
    if limit_bytes < 0:
        return df
    return F.broadcast(df) if estimated_bytes(df) <= limit_bytes else df
