"""Session helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.session import ensure_checkpoint_dir

#: Where this package was imported from.
ROOT = str(Path(__file__).resolve().parents[2])

#: Bounds of an Arrow batch handed to a Python task.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, free shuffle files when an action ends, and make sure
    that a checkpoint folder is known.

    Steps are kept by ``saved``, so that nothing reads the shuffles behind them
    again; without the setting these files lie on the disks until the driver
    happens to collect garbage.

    The folder is the cluster's own (``spark.checkpoint.dir``); only a local
    session without one gets a folder of its own. Python workers look for this
    package where the driver found it; if they have no such folder, ship the
    package with ``spark.submit.pyFiles``.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def rest() -> None:
    """Gives back what the allocators hold of arrays that are gone. Python workers
    live on between stages, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, with a ``rest`` after each."""
    for batch in batches:
        yield batch
        del batch
        rest()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
