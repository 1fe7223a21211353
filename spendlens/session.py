"""Session helpers.

``get_session`` is for tests, the bench and local runs.  On a cluster the
caller owns the session; library code only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Conf applied by get_session.  AQE re-plans joins at runtime: a join side is
# broadcast only when its measured size is under the threshold, otherwise it
# stays a shuffle join; skewed partitions are split.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # checkpoints of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "spendlens", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("SPENDLENS_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("SPENDLENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is set.

    The cluster names its shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only a local-mode session without the setting (tests, bench)
    gets a fresh folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) before running distributed rankings")
    folder = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df, name: str):
    """``df`` written once under the checkpoint folder and read back: later steps read the same rows, column by column."""
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/spendlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
