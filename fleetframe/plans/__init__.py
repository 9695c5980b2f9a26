"""Queries on the driver's tables, each with the SQL that gives the same rows.

The tables are not job records, so each query derives a job-like view of a whole table by a
fixed rule that plain SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
