"""Writers: manifests, exit records, output folders and what to do when they exist."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fleetframe.sources import folders, places

OUTPUT_BUCKETS = 64
MOVING = 16  # files that a commit moves at a time

# What to do when the target exists: fail, renew it, or keep what is there.
POLICIES = {"fail": "errorifexists", "renew": "overwrite", "keep": "ignore"}


def write_table(df: DataFrame, path: str, if_exists: str = "fail", by: list[str] | None = None):
    if by:
        # One file per folder where it is small, several tasks where a folder is large.
        df = df.hint("rebalance", *by)
    writer = df.write.mode(POLICIES[if_exists])
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def append_submissions(entries: DataFrame, path: str) -> None:
    """Add the entries of one or more submissions, one folder per submission timestamp."""
    entries.write.mode("append").partitionBy("submission_timestamp").parquet(path)


def latest_submission(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the latest submission; only its folder is opened, the others are just named."""
    key = "submission_timestamp="
    latest = max(n for n in folders.names(spark, path) if n.startswith(key))
    stamp = unquote(latest.removeprefix(key))
    return spark.read.parquet(f"{path}/{latest}").withColumn("submission_timestamp", F.lit(stamp))


def write_output(df: DataFrame, path: str, if_exists: str = "fail") -> None:
    """Job output, a folder per day and bucket of clusters; inside, rows are sorted by job.

    A folder per job would be as many folders as jobs; a reader of one job gets by with its
    bucket, `output_bucket`, and the statistics of the sorted files.
    """
    bucketed = df.withColumn("bucket", output_bucket(F.col("cluster_id")))
    by = ["datestr", "bucket"]
    sorted_ = bucketed.hint("rebalance", *by).sortWithinPartitions(*by, "cluster_id", "proc_id")
    sorted_.write.mode(POLICIES[if_exists]).partitionBy(*by).parquet(path)


def output_bucket(cluster_id: Column) -> Column:
    return F.pmod(F.xxhash64(cluster_id), F.lit(OUTPUT_BUCKETS)).cast("int")


class _NamedFilesWriter(DataSourceArrowWriter):
    """Tasks write below a hidden folder of this write; the commit moves whole files into place."""

    def __init__(self, folder: str):
        self.folder = folder
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = places.opened(self.folder)
        own = f"{self.staging}/{uuid.uuid4().hex}"  # of this attempt: a repeated task has another
        system.create_dir(f"{root}/{own}")
        name, stream = None, None
        for batch in iterator:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, system.open_output_stream(f"{root}/{own}/{file}")
                if line is not None:
                    stream.write(line.encode() + b"\n")
        if stream:
            stream.close()
        return _Staged(own)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = places.opened(self.folder)
        system.create_dir(root)
        staged = [(m.own, name) for m in messages if m for name, _ in places.entries(f"{self.folder}/{m.own}")]
        with ThreadPoolExecutor(MOVING) as pool:
            list(pool.map(lambda x: system.move(f"{root}/{x[0]}/{x[1]}", f"{root}/{x[1]}"), staged))
        self._drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, root = places.opened(self.folder)
        with contextlib.suppress(FileNotFoundError):
            system.delete_dir(f"{root}/{self.staging}")


@dataclass
class _Staged(WriterCommitMessage):
    own: str


class NamedFiles(DataSource):
    """Text files named by the first column of sorted rows, with the second as lines."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _NamedFilesWriter:
        return _NamedFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str, file: str = "file", order: str = "no", line: str = "line") -> None:
    """Text files named by a column, with their lines in order; a null line adds nothing.

    A file is written whole by one task, from sorted rows, and replaces one that was there. Files
    appear only once all tasks are done: those of a task that failed, or of the second of two
    attempts at one, are never seen. The commit itself moves file after file; if it breaks off, the
    write fails and is to be repeated.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    target = places.qualified(spark, folder)
    sorted_ = rows.select(file, order, line).repartition(file).sortWithinPartitions(file, order)
    sorted_.select(file, line).write.format(NamedFiles.name()).mode("append").save(target)


def write_chunks(df: DataFrame, path: str, if_exists: str = "fail") -> None:
    """Cut entries, one folder per chunk."""
    write_table(df, path, if_exists, ["chunk"])
