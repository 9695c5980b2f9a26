"""Job status: expected jobs against the queue and the files a job leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import status as S

JOB = ["cluster_id", "proc_id"]
BUCKETS = 64  # of a table that is kept by job; a few for each executor core suit best
ROWS_OF_A_BUCKET = 250_000  # of the jobs; one task joins a bucket, and held under 1 KB for each row of it


def expected_jobs(entries: DataFrame) -> DataFrame:
    """One row per submitted job. Ids that were stored as text become numbers."""
    jobs = entries.withColumn("proc_id", F.explode("proc_ids")).drop("proc_ids", "njobs")
    return jobs.withColumns(
        {
            "cluster_id": F.col("cluster_id").try_cast("bigint"),
            "proc_id": F.col("proc_id").try_cast("int"),
        }
    )


def union_queues(*queues: DataFrame) -> DataFrame:
    """All rows of all servers, repeats kept."""
    return reduce(DataFrame.unionByName, queues)


def select_queue(
    queue: DataFrame,
    cluster_id: int | None = None,
    proc_id: int | None = None,
    user: str | None = None,
) -> DataFrame:
    """Queue rows of a cluster, a job or an owner; None means no restriction."""
    wanted = {"cluster_id": cluster_id, "proc_id": proc_id, "user": user}
    for column, value in wanted.items():
        if value is not None:
            queue = queue.filter(F.col(column) == value)
    return queue


def sort_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*JOB)


def marker_evidence(markers: DataFrame) -> DataFrame:
    """One row per job: which marker files exist, and the exit code.

    An unreadable exit record counts as none and is reported in `bad_record`.
    """
    code = F.col("exitcode").try_cast("int")
    is_exit = F.col("kind") == "exitcode"
    return markers.groupBy(*JOB, "name").agg(
        F.bool_or(F.col("kind") == "log").alias("has_log"),
        F.bool_or(F.col("kind") == "out").alias("has_out"),
        F.bool_or(F.col("kind") == "err").alias("has_err"),
        F.max(F.when(is_exit, code)).alias("exitcode"),
        F.bool_or(is_exit & code.isNull()).alias("bad_record"),
    )


def job_status(expected: DataFrame, queue: DataFrame, markers: DataFrame) -> DataFrame:
    """Expected jobs with queue status, flags and the three verdicts.

    Queue rows are reduced to one per job (the least status code) by an aggregate on the join
    keys, so the join neither fans out nor moves them again.
    """
    queued = queue.groupBy(*JOB).agg(F.min("status").alias("status"))
    evidence = marker_evidence(markers)
    jobs = expected.join(queued, JOB, "left").join(evidence, [*JOB, "name"], "left")
    code = F.col("status")
    evidence_of_job = (code, F.col("has_log"), F.col("has_out"), F.col("exitcode"))
    return jobs.withColumns(
        {
            "flags": S.job_flags(*evidence_of_job),
            "status_name": S.status_name(code),
            "flag_names": S.evidence_names(*evidence_of_job),
            **S.verdicts(code, F.col("exitcode")),
        }
    ).drop("has_log", "has_out", "has_err")


def buckets_for(jobs: DataFrame, least: int = BUCKETS) -> int:
    """Buckets for tables about these jobs, so that a bucket, which one task joins, stays as large
    however many jobs there are. Rows that stand for a job more than once may be counted each."""
    return max(least, -(-jobs.count() // ROWS_OF_A_BUCKET))


def keep_by_job(rows: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Write expected jobs, a queue or markers as a table in buckets by job, and read it back.

    Tables with the same number of buckets join on the job, and are grouped by it, where they lie:
    `job_status` over three of them moves nothing. A bucket is one sorted file, and a read of one
    job opens one bucket. One task takes a whole bucket of each, so `buckets_for` tells their number.
    """
    writer = rows.repartition(buckets, *JOB).write.mode("overwrite").bucketBy(buckets, *JOB).sortBy(*JOB)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return rows.sparkSession.table(table)


def only_failed(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("failed"))


def _counts() -> list:
    outcome = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(outcome == "good").alias("good"),
        F.count_if(outcome == "failed").alias("failed"),
        F.count_if(outcome == "running").alias("running"),
    ]


def with_percentages(counts: DataFrame) -> DataFrame:
    """Share of each outcome in percent, null where there are no jobs."""
    return counts.withColumns(
        {
            f"{name}_pct": F.try_divide(F.lit(100.0) * F.col(name), F.col("total"))
            for name in ("good", "failed", "running")
        }
    )


def summary(jobs: DataFrame) -> DataFrame:
    """Outcome counts of all jobs; each job counts once."""
    return with_percentages(jobs.agg(*_counts()))


def cluster_summary(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome counts per cluster."""
    return with_percentages(jobs.groupBy(*keys).agg(*_counts()))


def summary_line(counts: DataFrame) -> DataFrame:
    """The counts as a line of text, percentages to one decimal."""
    part = ", ".join(f"{n}: %s (%.1f%%)" for n in ("good", "failed", "running"))
    cells = [F.col(c) for n in ("good", "failed", "running") for c in (n, f"{n}_pct")]
    return counts.select(F.format_string(f"total: %s, {part}", "total", *cells).alias("line"))


def status_lines(jobs: DataFrame) -> DataFrame:
    """'cluster.proc FLAGS Status' per job, ordered as the jobs are."""
    line = F.concat_ws(
        " ", F.concat_ws(".", *JOB), F.col("flag_names"), F.col("status_name")
    )
    return sort_jobs(jobs.select(*JOB, line.alias("line")))


def failed_count(jobs: DataFrame) -> DataFrame:
    """Jobs that would be resubmitted, recounted after the filter."""
    return jobs.agg(F.count_if(F.col("failed")).alias("n_failed"))


def clusters_done(latest: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per cluster, whether no job is idle or running.

    A job without a known status is not held to be active.
    """
    active = F.coalesce(F.col("status").isin(*S.ACTIVE_STATUSES), F.lit(False))
    return latest.groupBy(*(keys or ["cluster_id"])).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(active).alias("n_active"),
        F.bool_and(~active).alias("done"),
    )


def latest_status(events: DataFrame, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest status per job, combined on the map side before the shuffle."""
    return events.groupBy(*JOB).agg(
        F.max_by("status", F.struct(time, tie)).alias("status"), F.max(time).alias(time)
    )
