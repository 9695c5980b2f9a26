"""Job status: line items stand for jobs, their order for the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import settings
from fleetframe.functions import status as S
from fleetframe.operators import fanout, ledger
from fleetframe.plans import table
from fleetframe.session import work_dir


def expected(spark, sf) -> DataFrame:
    """(order, line number) repeats in the data, so it is made unique first."""
    lines = table(spark, sf, "lineitem")
    jobs = lines.select(
        F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("proc_id")
    ).distinct()
    return jobs.withColumn("name", F.concat(F.lit("order"), F.col("cluster_id")))


def queue(spark, sf) -> DataFrame:
    """Lines with status O are queued; the quantity gives the status code 0 to 6."""
    lines = table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "O")
    return lines.select(
        F.col("l_orderkey").alias("cluster_id"),
        F.col("l_linenumber").alias("proc_id"),
        F.floor(F.col("l_quantity") / 8).cast("int").alias("status"),
        F.col("l_returnflag").alias("user"),
    )


def markers(spark, sf) -> DataFrame:
    """Marker files by ship date, return flag and discount."""
    lines = table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    code = F.when(F.col("l_discount") < 0.08, 0).otherwise(1)
    none = F.lit(None).cast("int")

    def marker(kind, present, exitcode=none):
        return F.struct(F.when(present, F.lit(kind)).alias("kind"), exitcode.alias("exitcode"))

    kinds = F.array(
        marker("log", early),
        marker("out", F.col("l_returnflag").isin("A", "R")),
        marker("exitcode", F.col("l_returnflag") == "R", code.cast("int")),
    )
    rows = lines.select(
        F.concat(F.lit("order"), F.col("l_orderkey")).alias("name"),
        F.col("l_orderkey").alias("cluster_id"),
        F.col("l_linenumber").alias("proc_id"),
        F.explode(kinds).alias("_m"),
    )
    return rows.select("name", "cluster_id", "proc_id", "_m.*").filter(F.col("kind").isNotNull())


def jobs(spark, sf) -> DataFrame:
    return ledger.job_status(expected(spark, sf), queue(spark, sf), markers(spark, sf))


def status_kept(spark, sf):
    """The status of tables that are kept in buckets by job; the second question moves nothing."""
    tag = uuid.uuid4().hex
    buckets = ledger.buckets_for(table(spark, sf, "lineitem"), least=8)  # a count of rows reads no column
    kept = [
        ledger.keep_by_job(rows(spark, sf), f"{rows.__name__}_{tag}", work_dir(spark, rows.__name__), buckets)
        for rows in (expected, queue, markers)
    ]
    return _status(ledger.job_status(*kept))


def status_jobs(spark, sf):
    return _status(jobs(spark, sf))


def _status(found: DataFrame) -> DataFrame:
    return found.select(
        "cluster_id",
        "proc_id",
        "status",
        "status_name",
        "flag_names",
        "running",
        "failed",
        "success",
        "outcome",
    )


def status_summary(spark, sf):
    return ledger.summary(jobs(spark, sf))


def cluster_summary(spark, sf):
    return ledger.cluster_summary(jobs(spark, sf), ["cluster_id", "name"])


def failed_jobs(spark, sf):
    failed = ledger.only_failed(jobs(spark, sf))
    return ledger.sort_jobs(failed.select("cluster_id", "proc_id", "flag_names"))


def failed_count(spark, sf):
    return ledger.failed_count(jobs(spark, sf))


def status_lines(spark, sf):
    return ledger.status_lines(jobs(spark, sf))


def queue_of_user(spark, sf):
    both = ledger.union_queues(queue(spark, sf), queue(spark, sf))
    return ledger.select_queue(both, user="A").select("cluster_id", "proc_id", "status")


def resubmit_plan(spark, sf):
    environment = F.create_map(
        F.lit("CLUSTERNAME"), F.col("name"), F.lit("SEED"), F.col("cluster_id").cast("string")
    )
    plan = fanout.resubmission_plan(jobs(spark, sf).withColumn("environment", environment))
    old = fanout.resubmitted_proc_id(F.col("environment"))
    return plan.select(
        "cluster_id",
        "proc_id",
        "njobs",
        settings.map_text(F.col("environment")).alias("environment"),
        S.effective_proc_id(old, F.lit(0)).alias("effective_proc_id"),
    )


def effective_ids(spark, sf):
    """Returned items stand for jobs that replace another; odd lines have recorded their own id."""
    lines = table(spark, sf, "lineitem")
    number = F.col("l_linenumber")
    replaced = F.when(F.col("l_returnflag") == "R", (number + 100).cast("string"))
    environment = F.map_filter(
        F.create_map(F.lit(fanout.RESUBMITTED_PROC_ID), replaced), lambda _, v: v.isNotNull()
    )
    recorded = F.when(number % 2 == 1, number)
    return lines.select(
        F.col("l_orderkey").alias("cluster_id"),
        number.alias("proc_id"),
        S.effective_proc_id(fanout.resubmitted_proc_id(environment), recorded).alias("works_as"),
    )


_JOBS = """
with e as (
  select distinct l_orderkey as cluster_id, l_linenumber as proc_id from lineitem
), q as (
  select l_orderkey as cluster_id, l_linenumber as proc_id,
         min(cast(floor(l_quantity / 8) as int)) as status
  from lineitem where l_linestatus = 'O' group by 1, 2
), m as (
  select l_orderkey as cluster_id, l_linenumber as proc_id,
         bool_or(l_shipdate < timestamp '2000-01-01') as has_log,
         bool_or(l_returnflag in ('A', 'R')) as has_out,
         max(case when l_returnflag = 'R' then
               case when l_discount < 0.08 then 0 else 1 end end) as exitcode
  from lineitem group by 1, 2
), f as (
  select e.cluster_id, e.proc_id, 'order' || e.cluster_id as name, q.status,
         coalesce(m.has_log, false) as has_log, coalesce(m.has_out, false) as has_out, m.exitcode,
         case q.status when 0 then 'Unexpanded' when 1 then 'Idle' when 2 then 'Running'
           when 3 then 'Removed' when 4 then 'Completed' when 5 then 'Held'
           when 6 then 'Submission_err' end as status_name,
         q.status is not null and q.status not in (5, 6) as running
  from e left join q using (cluster_id, proc_id) left join m using (cluster_id, proc_id)
), jobs as (
  select *,
         concat_ws(',', case when status is not null then 'IN_HTCONDOR' end,
           case when status in (5, 6) then 'HTCONDOR_ERROR' end,
           case when has_log then 'GOT_SUBMITTED' else 'NOT_STARTED' end,
           case when has_out then 'EXITED' end,
           case when exitcode is null then 'NO_EXITCODE'
             when exitcode = 0 then 'GOOD_EXITCODE' else 'BAD_EXITCODE' end) as flag_names,
         not running and (coalesce(status in (5, 6), false) or exitcode is null or exitcode <> 0)
           as failed,
         coalesce(exitcode = 0, false) as success
  from f
), job as (
  select *, case when success then 'good' when failed then 'failed' else 'running' end as outcome
  from jobs
)
"""

_COUNTS = """
  count(*) as total, count(*) filter (outcome = 'good') as good,
  count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome = 'running') as running,
  100.0::double * count(*) filter (outcome = 'good') / count(*) as good_pct,
  100.0::double * count(*) filter (outcome = 'failed') / count(*) as failed_pct,
  100.0::double * count(*) filter (outcome = 'running') / count(*) as running_pct
"""

QUERIES = {
    "q_status_kept": (
        status_kept,
        _JOBS
        + """select cluster_id, proc_id, status, status_name, flag_names, running, failed,
                    success, outcome from job""",
    ),
    "q_status_jobs": (
        status_jobs,
        _JOBS
        + """select cluster_id, proc_id, status, status_name, flag_names, running, failed,
                    success, outcome from job""",
    ),
    "q_status_summary": (status_summary, _JOBS + "select" + _COUNTS + "from job"),
    "q_cluster_summary": (
        cluster_summary,
        _JOBS + "select cluster_id, name," + _COUNTS + "from job group by cluster_id, name",
    ),
    "q_failed_jobs": (
        failed_jobs,
        _JOBS + "select cluster_id, proc_id, flag_names from job where failed order by 1, 2",
    ),
    "q_failed_count": (
        failed_count,
        _JOBS + "select count(*) as n_failed from job where failed",
    ),
    "q_status_lines": (
        status_lines,
        _JOBS
        + """select cluster_id, proc_id, concat_ws(' ', cluster_id || '.' || proc_id, flag_names,
                    status_name) as line from job order by 1, 2""",
    ),
    "q_queue_of_user": (
        queue_of_user,
        """select l_orderkey as cluster_id, l_linenumber as proc_id,
                  cast(floor(l_quantity / 8) as int) as status
           from lineitem, (values (1), (2)) as twice(n)
           where l_linestatus = 'O' and l_returnflag = 'A'""",
    ),
    "q_effective_ids": (
        effective_ids,
        """select l_orderkey as cluster_id, l_linenumber as proc_id,
                  coalesce(case when l_returnflag = 'R' then l_linenumber + 100 end,
                           case when l_linenumber % 2 = 1 then l_linenumber end, 0) as works_as
           from lineitem""",
    ),
    "q_resubmit_plan": (
        resubmit_plan,
        _JOBS
        + """select cluster_id, proc_id, 1 as njobs,
                    'CLUSTERNAME=' || name || ';RESUBMITTED_PROC_ID=' || proc_id
                      || ';SEED=' || cluster_id as environment,
                    proc_id as effective_proc_id
             from job where failed""",
    ),
}
