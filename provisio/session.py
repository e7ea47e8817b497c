"""Spark session helpers.

The library never creates a session behind the user's back; these helpers
are for scripts, tests and the bench.  Configuration is chosen for a large
cluster first (AQE, skew handling, zstd Parquet) and scaled down for local
runs only through ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(master: str | None = None, app: str = "provisio",
                  shuffle_partitions: int | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # no stack trace is taken for every column expression; plans are built in half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("PROVISIO_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Only a local master (tests, bench), whose tasks all see this
    machine's disk, may go without: it gets a private scratch folder.  Any
    other master without a configured folder is refused.
    """
    try:
        sc = spark.sparkContext
    except Exception as e:  # noqa: BLE001 - sessions without a SparkContext (Spark Connect)
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share") from e
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="provisio-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the cluster's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/provisio-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def unsorted_folders(spark: SparkSession, most: int = 64) -> Iterator[None]:
    """Writes by folder keep a file open per folder, up to ``most`` in a task,
    instead of sorting the task's rows by folder first, so that a task's
    memory doesn't grow with its rows.  Rows of further folders are sorted as
    ever."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a (small, aggregated) frame: it is written as Parquet
    into the shared folder and read back.

    Used for per-cell aggregates that several downstream results reuse: the
    big scan runs once, a lost executor does not replay it, and later joins
    know the table's size, so the optimizer picks their strategy.
    """
    path = scratch_dir(df.sparkSession, "cells")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and, from the same job, small aggregates over the rows it writes."""
    seen = Observation(f"cells-{uuid.uuid4().hex[:12]}")
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return out, dict(seen.get)
