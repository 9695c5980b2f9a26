"""Files of a run directory: job markers and data files."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.functions.text import matches_any
from fleetframe.sources import places
from fleetframe.sources.lines import plain_path

LISTED = "path string, length bigint"
LISTING_BATCH = 10000
LANES = 4  # tasks that list a folder
MARKER = r"^(out|err|log|exitcode)_.*_\d+_\d+\.txt$"


def _scan_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder, lane, lanes in zip(batch["folder"], batch["lane"], batch["lanes"]):
            rest = ((f"{folder}/{name}", size) for name, size in places.entries(folder, lane, lanes))
            while part := list(itertools.islice(rest, LISTING_BATCH)):
                yield pd.DataFrame(part, columns=["path", "length"])


def list_files(
    spark: SparkSession, folders: str | list[str], glob: str | list[str] = "*", lanes: int = LANES
) -> DataFrame:
    """(path, length) of the files in some folders; their content is not read.

    Empty files count, which Spark's own file sources leave out: an empty error file or exit
    record says something about its job. Each folder is listed by `lanes` tasks: each reads the
    names, one at a time, and asks only for the files that fall to it, so a folder with very many
    files is not one task's work. A path without a scheme is one of the cluster's file system.
    """
    named = [folders] if isinstance(folders, str) else list(folders)
    paths = [(places.qualified(spark, f),) for f in named]
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    table = spark.createDataFrame(paths, "folder string").select("folder", lane, F.lit(lanes).alias("lanes"))
    base = F.substring_index(F.col("path"), "/", -1)
    globs = [glob] if isinstance(glob, str) else list(glob)
    # By range each pair is a task of its own; by hash some would fall together.
    spread = table.repartitionByRange(len(paths) * lanes, "folder", "lane")
    return spread.mapInPandas(_scan_folders, LISTED).filter(matches_any(base, globs))


def parse_marker_names(listing: DataFrame, path: str = "path") -> DataFrame:
    """kind, name, cluster_id, proc_id of '{kind}_{name}_{cluster}_{proc}.txt'; others dropped.

    The name may hold underscores of its own.
    """
    base = F.substring_index(F.col(path), "/", -1)
    ids = F.substring_index(base, "_", -2)
    kind = F.substring_index(base, "_", 1)
    # What lies between the kind and the two ids, without the underscores around it.
    name = F.substring(
        base, F.length(kind) + 2, F.length(base) - F.length(kind) - F.length(ids) - 2
    )
    return listing.filter(base.rlike(MARKER)).withColumns(
        {
            "kind": kind,
            "name": name,
            "cluster_id": F.substring_index(ids, "_", 1).try_cast("bigint"),
            "proc_id": F.substring_index(F.substring_index(ids, "_", -1), ".", 1).try_cast("int"),
        }
    )


def read_markers(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """Marker table of run directories. Only exit records are opened."""
    columns = ["kind", "name", "cluster_id", "proc_id", "exitcode"]
    listed = parse_marker_names(list_files(spark, folders))
    closed = listed.filter((F.col("kind") != "exitcode") | (F.col("length") == 0))
    records = spark.read.option("pathGlobFilter", "exitcode_*.txt").text(folders, wholetext=True)
    code = F.regexp_replace("value", r"\s+", "").try_cast("int")
    opened = parse_marker_names(
        records.select(plain_path(F.col("_metadata.file_path")).alias("path"), code.alias("exitcode"))
    )
    no_code = F.lit(None).cast("int")
    return closed.withColumn("exitcode", no_code).select(*columns).unionByName(
        opened.select(*columns)
    )


def file_params(
    spark: SparkSession, folders: str | list[str], glob: str | list[str], out: str = "file"
) -> DataFrame:
    """One parameter row per data file."""
    return list_files(spark, folders, glob).select(F.col("path").alias(out))
