"""Small files whose names say what is valid: committed runs, refreshed runs. A mark is there whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def located(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = located(spark, name)
    return fs.exists(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order, without hidden ones; none if it is absent."""
    path, fs = located(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if not n.startswith((".", "_")))


def put(spark: SparkSession, folder: str, name: str, text: str = "") -> bool:
    """Writes a mark under another name and renames it; False if it was there already."""
    path, fs = located(spark, f"{folder}/{name}")
    if fs.exists(path):
        return False
    aside, _ = located(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(aside, path))


def move(spark: SparkSession, name: str, to: str) -> None:
    path, fs = located(spark, name)
    if not fs.rename(path, located(spark, to)[0]):
        raise OSError(f"cannot rename {name} to {to}")


def drop(spark: SparkSession, name: str) -> None:
    path, fs = located(spark, name)
    fs.delete(path, True)
