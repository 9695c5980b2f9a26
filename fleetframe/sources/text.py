"""Queue listings and KEY=value dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.status import status_code
from fleetframe.functions.text import strip


def parse_queue(lines: DataFrame, line: str = "value") -> DataFrame:
    """Queued jobs in a listing; other lines do not start with `cluster.proc` and are dropped.

    Word 0 is cluster.proc, word 1 the user, word 5 the status letter, the last the script.
    """
    jobs = lines.filter(F.col(line).rlike(r"^\s*\d+\.\d+(\s|\z)"))
    rows = jobs.select(F.split(strip(F.col(line)), r"\s+").alias("_w"))
    job = F.split(F.get("_w", 0), r"\.")
    return rows.select(
        F.get(job, 0).try_cast("bigint").alias("cluster_id"),
        F.get(job, 1).try_cast("int").alias("proc_id"),
        status_code(F.get("_w", 5)).alias("status"),
        F.get("_w", 1).alias("user"),
        F.element_at("_w", -1).alias("sh_base"),
        F.lit(None).cast("string").alias("rundir"),
    )


def parse_env(lines: DataFrame, keys: list[str], order: str = "line_no", line: str = "line"):
    """Variables of a dump: cut at the first '=', the last line of a variable counts.

    Blank lines and lines without '=' are skipped, also those of a value over several lines.
    """
    text = strip(F.col(line))
    cut = lines.filter(text.contains("=")).withColumns(
        {
            "key": F.substring_index(text, "=", 1),
            "_value": F.get(F.split(text, "=", 2), 1),
        }
    )
    return cut.groupBy(*keys, "key").agg(F.max_by("_value", order).alias("value"))
