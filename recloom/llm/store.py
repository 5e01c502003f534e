"""Shared storage for what an operator writes between two steps, below ``spark.checkpoint.dir`` (see ``sources.scratch``)."""

from __future__ import annotations

import contextlib
import os
import urllib.parse
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from recloom.sources import scratch


class Scratch:
    """One run's folder below the shared root: ``save`` writes a table and reads it back, which also cuts its lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch.folder(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            scratch.remove(self.spark, self.path(name))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or a plain path, and the path inside it."""
    if "://" not in uri:
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), urllib.parse.unquote(uri.removeprefix("file:"))
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file://"):
        return pafs.LocalFileSystem(), urllib.parse.unquote(uri.removeprefix("file://"))
    return pafs.FileSystem.from_uri(uri)


def put_whole(uri: str, parts) -> int:
    """Writes byte strings as one file under a name of this attempt, then moves it in place, so that a retried or doubled
    task never leaves half a file.  Returns its size."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    try:
        with fs.open_output_stream(own) as out:
            for x in parts:
                size += len(x)
                out.write(x)
        fs.move(own, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(own)
        raise
    return size


def open_mapped(uri: str):
    """A random-access file: memory-mapped where the store is a local or mounted folder, else by ranged reads."""
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path, "r") if os.path.getsize(path) else pa.BufferReader(b"")
    return fs.open_input_file(path)
