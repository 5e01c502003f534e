"""Folders that driver and executors share, for tables that a query writes and reads again.

They lie below ``spark.checkpoint.dir``.  Only a session that runs in one process (master ``local``) may go without that
setting: a temporary folder is put into it.  On a cluster, a missing setting is an error, as executors see no folder of the
driver's machine.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[str] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="recloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path; ``clean_up`` removes it."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clean_up(spark: SparkSession) -> int:
    """Removes all folders that this process has made, and tells how many.  To be called once no DataFrame that reads them
    is needed any more: results are lazy, so no operator can do so itself."""
    n = 0
    while _MADE:
        with contextlib.suppress(Exception):
            remove(spark, _MADE.pop())
            n += 1
    return n
