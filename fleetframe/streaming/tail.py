"""Output lines of running jobs as they appear.

`tail_lines` streams files that are closed when they appear. `growing_lines` streams files that still
grow, through a data source of its own: the offset of a batch says how far each file is read, always up
to the end of a line, and a batch reads the bytes between two offsets in parts, a task each. The
engine's checkpoint keeps the offsets, so a batch that failed or a query that is started again reads
the same bytes, and every line comes once.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from fleetframe.functions.text import log_fields
from fleetframe.sources import places
from fleetframe.sources.lines import plain_path

PART_BYTES = 64 << 20  # of a file that one task reads
BLOCK = 1 << 20
LINES = "file string, position bigint, line string"
BATCH = 10_000  # lines handed on at once
LOOKING = 16  # files looked into at a time for the end of their last line


def tail_lines(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of (file, line) from the text files of a folder."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    lines = reader.load(folder)
    file = plain_path(F.col("_metadata.file_path")).alias("file")
    return lines.select(file, F.col("value").alias("line"))


def parsed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with their log fields."""
    return lines.withColumn("_f", log_fields(F.col(line))).select(
        *[c for c in lines.columns if c != line], "_f.*"
    )


def append_stream(df: DataFrame, path: str, checkpoint: str, **trigger):
    """Append the rows of a stream to a table; the file sink commits each batch once."""
    writer = df.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def _part_lines(stream, start: int, begin: int, limit: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the whole lines that begin in [begin, limit); none reaches past stop."""
    at = begin if begin == start else begin - 1
    stream.seek(at)
    rest, skip = b"", begin != start  # a line that began before this part belongs to the one before
    offset = at
    while at < stop:
        block = stream.read(min(BLOCK, stop - at))
        if not block:
            return
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if not skip:
                if offset >= limit:
                    return
                yield offset, line
            skip = False
            offset += len(line) + 1
        if offset >= limit:
            return


class _Part(InputPartition):
    """Bytes of a file: the lines that begin in [begin, limit), none beyond stop."""

    def __init__(self, file: str, start: int, begin: int, limit: int, stop: int):
        self.file, self.start, self.begin, self.limit, self.stop = file, start, begin, limit, stop


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.glob = options.get("glob", "*")
        self.part = int(options.get("partBytes", PART_BYTES))
        self.known: dict[str, tuple[int, int]] = {}  # length and end of the last whole line

    def initialOffset(self) -> dict:
        return {}

    def _ended(self, name: str, length: int) -> int:
        """Where the last whole line ends, looked for from the back."""
        old, least = self.known.get(name, (0, 0))
        if length == old:
            return least
        least = least if length > old else 0
        system, root = places.opened(self.folder)
        with system.open_input_file(f"{root}/{name}") as stream:
            at = length
            while at > least:
                begin = max(least, at - BLOCK)
                stream.seek(begin)
                found = stream.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
        return least

    def latestOffset(self) -> dict:
        seen = {n: size for n, size in places.entries(self.folder) if fnmatch.fnmatchcase(n, self.glob)}
        with ThreadPoolExecutor(LOOKING) as pool:
            ends = pool.map(self._ended, seen, seen.values())
            self.known = {n: (size, end) for (n, size), end in zip(seen.items(), ends)}
        return {n: end for n, (_, end) in sorted(self.known.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        parts = []
        for name, stop in end.items():
            first = start.get(name, 0)
            first = first if first <= stop else 0  # a file that has become shorter is a new one
            for begin in range(first, stop, self.part):
                parts.append(_Part(name, first, begin, min(begin + self.part, stop), stop))
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        p = partition
        system, root = places.opened(self.folder)
        path, found = f"{self.folder}/{p.file}", []
        with system.open_input_file(f"{root}/{p.file}") as stream:
            for position, line in _part_lines(stream, p.start, p.begin, p.limit, p.stop):
                found.append((position, line.decode(errors="replace")))
                if len(found) == BATCH:
                    yield _line_batch(path, found)
                    found = []
        if found:
            yield _line_batch(path, found)


def _line_batch(path: str, found: list[tuple[int, str]]) -> pa.RecordBatch:
    position, line = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(found)), pa.array(position, pa.int64()), pa.array(line, pa.string())],
        names=["file", "position", "line"],
    )


class GrowingFiles(DataSource):
    """Whole lines of the files that a folder holds, as they appear."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(dict(self.options))


def growing_lines(spark: SparkSession, folder: str, glob: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """Stream of (file, position, line) from files that grow; the position, in bytes, orders a file.

    A line without its line end is left for a later batch. A file that has become shorter is read
    from its beginning again.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format(GrowingFiles.name()).option("glob", glob)
    return reader.option("partBytes", part_bytes).load(places.qualified(spark, folder))
