"""Versioned tables with a pointer: readers resolve the pointer on each call and see one version whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The newest published version; pointers are files named by a counter alone that hold the version."""
    path, fs = _fs(spark, root)
    at = path(f"{root}/pointers")
    if not fs.exists(at):
        return None
    for name in sorted((s.getPath().getName() for s in fs.listStatus(at)), reverse=True):
        with_version = fs.open(path(f"{root}/pointers/{name}"))
        try:
            version = spark._jvm.org.apache.commons.io.IOUtils.toString(with_version, "UTF-8")
        finally:
            with_version.close()
        if version:  # a pointer that is just being written does not count yet
            return version
    return None


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/versions/{version}")


def publish(df: DataFrame, root: str, after: int | None = None) -> str:
    """Write a new version beside the old ones, then add its pointer: the creation of the file named by the next counter, which only one writer can do."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    path, fs = _fs(spark, root)
    at = path(f"{root}/pointers")
    fs.mkdirs(at)
    last = counter(spark, root) if after is None else after
    try:
        out = fs.create(path(f"{root}/pointers/{last + 1:012d}"), False)
    except Exception as e:
        if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
            raise
        raise RuntimeError(f"another writer published to {root}") from e
    out.write(bytearray(version.encode()))
    out.close()
    return version


def counter(spark: SparkSession, root: str) -> int:
    """How many versions were published; ``publish(..., after=counter)`` fails if another writer has come between."""
    path, fs = _fs(spark, root)
    at = path(f"{root}/pointers")
    return max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0) if fs.exists(at) else 0
