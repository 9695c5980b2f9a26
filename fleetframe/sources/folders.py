"""Folder names through the file system that the path belongs to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds directly; nothing for a folder that is not there."""
    place, system = _system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The sorted n of the sub-folders `prefix=n`."""
    found = [n.removeprefix(f"{prefix}=") for n in names(spark, path) if n.startswith(f"{prefix}=")]
    return sorted(int(n) for n in found if n.isdigit())


def remove(spark: SparkSession, path: str) -> None:
    place, system = _system(spark, path)
    system.delete(place, True)
