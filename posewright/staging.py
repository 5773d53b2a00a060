"""Materialised intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing Parquet under ``spark.checkpoint.dir``. Spark's
committer makes a written table complete or absent, so a lost executor costs one task, not the table.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_roots: dict[str, object] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder, deleted when the driver ends.

    Only where the session names no such folder and runs on one machine (tests, local runs) is it a temporary
    one; on a cluster, where each executor would write to a folder of its own, it must be named.
    """
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="posewright-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        configured = f"file://{_local_root}"
    root = f"{configured.rstrip('/')}/posewright/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark._jvm
        atexit.register(_remove, root)
    return root


def _remove(root: str) -> None:
    jvm = _roots.pop(root, None)
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):
        pass  # the JVM has ended already


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows or bytes that one file of a staged table holds at least, where the table's size is known beforehand.
ROWS_A_FILE, BYTES_A_FILE, LEAST_FILES = 50_000, 32 << 20, 6


def stage(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None, size: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; later plans start from the files.

    With a bound on its ``rows``, a small table is written to few files; where rows are long, ``size`` bounds
    the bytes of their texts.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, rows // ROWS_A_FILE, size // BYTES_A_FILE))
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if shared_root(spark).split("://")[-1] in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()
