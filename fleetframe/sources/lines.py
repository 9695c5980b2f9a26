"""Texts as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.operators.ordered import index_within


def plain_path(encoded: Column) -> Column:
    """The path as it is named on disk; `_metadata.file_path` is URI-encoded, with a plain plus."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 0.

    Files are read in splits, so a large file is not one row. Inside a split the row number of
    the scan keeps the order, and splits are ordered by their offset; the numbering then goes
    by split and needs no task that sees a whole file.
    """
    raw = spark.read.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    numbered = index_within(raw, ["file"], ["_offset", "_row"], "line_no")
    return numbered.select("file", "line_no", "line")


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text) with one row per file, for small documents such as JSON objects."""
    return spark.read.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text")
    )
