"""File systems as tasks see them: local, shared or remote, by path or URI."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    if "://" not in path:
        path = os.path.abspath(path)
    return pyarrow.fs.FileSystem.from_uri(path)


def _hadoop(spark: SparkSession, path: str):
    """The driver's file system of a path, as Spark's writers use it, and the path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def path_exists(spark: SparkSession, path: str) -> bool:
    system, there = _hadoop(spark, path)
    return system.exists(there)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    system, there = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(there)) if system.exists(there) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    system, there = _hadoop(spark, path)
    stream = system.open(there)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def rename_into(spark: SparkSession, content: str, path: str) -> None:
    """Write a small file that appears at once and whole; an error if the path is taken."""
    system, target = _hadoop(spark, path)
    written = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    system.mkdirs(target.getParent())
    stream = system.create(written, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    nothing = spark.sparkContext._gateway.new_array(kind, 0)
    try:
        context.rename(written, target, nothing)
    except Exception as error:
        system.delete(written, False)
        raise FileExistsError(f"{path} is there already") from error
