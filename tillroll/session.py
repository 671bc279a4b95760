"""Session helpers.

The library never creates sessions itself; these are for tests, the
bench and local runs. On a cluster, pass your own session.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int | None = None,
                  app: str = "tillroll", extra: dict | None = None) -> SparkSession:
    """A local session configured the way the reports expect.

    * AQE on (partition coalescing, skew-join splitting, runtime broadcast).
    * UTC session time zone (date_trunc/hour on TIMESTAMP use it).
    * requireAllClusterKeysForCoPartition off (see operators.lifetime).
    * Spark UI off: no server is started.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Join children hashed on a subset of the join keys are co-partitioned:
        # the lifetime spine is joined and windowed where it was generated.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # Delete checkpoint files once their DataFrames are unreachable.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; Spark
    picks it up at start. Only when nothing is set, ``allow_local`` is true
    and the master is ``local[...]`` (tests, local runs) is a fresh local
    folder chosen; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not (allow_local and sc.master.startswith("local[")):
        raise RuntimeError(
            "no checkpoint directory: set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-ckpt-"))
    return sc.getCheckpointDir()
