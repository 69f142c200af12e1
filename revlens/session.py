"""Session helpers: a local session for tests/bench and the shared scratch folder.

Library code never creates a session itself; it takes the caller's. The helpers here
are for tests, the bench and notebooks.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "revlens") -> SparkSession:
    """Local session configured like the cluster profile (UTC, AQE, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``). Only a local master, where driver
    and executors are one process, may fall back to a temporary folder; elsewhere an unset folder is an
    error, as executors could not see files written by others."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext; the conf names the folder
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = conf or _local_folder(sc.master if sc is not None else "connect")
    if sc is None:
        return folder
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def _local_folder(master: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="revlens-ckpt-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/revlens-{name}-{uuid.uuid4().hex[:12]}"


def pin_utc(spark: SparkSession) -> None:
    """Commit times are compared and rendered in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark):
    """Inside, Spark removes the shuffle files of an action as soon as it ends: what it wrote is all that is read of
    it. Else they stay until the driver happens to collect its garbage, next to those of every later step."""
    before = spark.conf.get(_RELEASE) if spark.conf.isModifiable(_RELEASE) else None
    if before is None:  # a Spark that doesn't know the setting
        yield
        return
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder: computes ``df`` once, cuts lineage,
    and survives executor loss (never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new plan: what ends with it is settled when it is made


def spread(df):
    """A scan of fewer splits than half the session's cores (a small file is one split, whatever the work on its
    rows) dealt out over all of them; any other scan as it is, without a shuffle."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect doesn't tell its cores
        return df
    return df if 2 * df.rdd.getNumPartitions() > cores else df.repartition(cores)


def persist_table(df, name: str = "table", codec: str | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Unlike a checkpoint, the result carries file-size statistics, so the planner can decide
    (with its own size check) to broadcast it when it turns out small. ``codec``: another compression than the
    session's, for large tables."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_released(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.parquet(path)


def persist_rows(df, name: str = "rows"):
    """``df`` computed once and kept in as few bytes as may be: as Parquet, or where Parquet lacks a type (void) as
    a checkpoint."""
    return materialize(df) if "void" in df.schema.simpleString() else persist_table(df, name, "zstd")
