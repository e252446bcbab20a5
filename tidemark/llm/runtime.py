"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def smaller_batches(spark: SparkSession) -> None:
    """1,000 rows to an Arrow batch where the session has Spark's default of 10,000.

    Texts are long rows: 10,000 of them would cost hundreds of MB on both sides of each worker's pipe.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def checkpoint_ready(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; make a temporary folder only where none is set (tests)."""
    smaller_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint eagerly, so later steps do not repeat this one after a loss.

    The shuffle files behind the cut are not needed any more; asking both garbage collectors to run
    lets Spark's cleaner delete them now rather than at its half-hourly turn.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    out = df.checkpoint(eager=True)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def fixed_partitions(spark: SparkSession):
    """Plan without runtime re-planning, so that a checkpoint keeps its hash partitioning for later joins."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]):
    """What an operator keeps in a Python worker from task to task; a worker keeps the latest one alone."""
    if key not in _HELD:
        drop_held()
        _HELD[key] = build()
    return _HELD[key]


def drop_held() -> None:
    """Workers outlive operators: those that keep nothing themselves let go of what the one before kept."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give memory that this worker has freed back to the system: the operators after this one need it."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
