"""Files as Python tasks see them: one file system for a path, whoever lists, reads or writes it."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Hadoop's names of object stores that the client used here knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark itself would take for it; a local one without scheme.

    A path without a scheme lies on the cluster's default file system, not on each machine's disk.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(place).toString().rstrip("/")
    return uri.removeprefix("file://").removeprefix("file:")


def opened(path: str):
    """The file system and the path inside it."""
    from pyarrow import fs

    scheme, found, rest = path.partition("://")
    if not found:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def entries(folder: str, lane: int = 0, lanes: int = 1) -> Iterator[tuple[str, int]]:
    """Name and length of the files that a folder holds directly; nothing for one that is not there.

    Of several lanes each one gives the files whose names fall to it, and asks for the length of
    those only.
    """

    def own(name: str) -> bool:
        return zlib.crc32(name.encode(errors="surrogateescape")) % lanes == lane

    system, root = opened(folder)
    if system.type_name == "local":
        if os.path.isdir(root):
            with os.scandir(root) as found:
                yield from ((e.name, e.stat().st_size) for e in found if own(e.name) and e.is_file())
        return
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if own(info.base_name) and info.is_file:
            yield info.base_name, info.size
