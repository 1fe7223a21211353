"""Intermediate tables in the shared folder, and the package itself on the executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a ``local`` session without the setting (tests) gets a folder of its
    own; on a cluster a missing setting is an error, as executors would write
    to disks that others can't read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/spendlens-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage.

    A lost executor re-reads files instead of computing the frame again, and
    Spark knows the size of what it reads, so a join broadcasts it only if it
    is under the threshold.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hand memory that was freed in this process back to the system: the driver's own is small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' path, for functions that run in Python workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="spendlens-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file from here
    src = os.path.join(folder, "src")
    shutil.copytree(os.path.join(root, "spendlens"), os.path.join(src, "spendlens"),
                    ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "spendlens_package"), "zip", src))
    _shipped.add(app)
