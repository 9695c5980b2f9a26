"""Streams over the event table, each with the answer of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators import ledger
from fleetframe.plans import table
from fleetframe.session import work_dir
from fleetframe.sources import sinks
from fleetframe.streaming import done, late, tail

DONE = ["cluster_id", "n_jobs", "n_active", "done"]


def _as_status(events: DataFrame) -> DataFrame:
    """Users as clusters, the quarter of the number in `props` as job, the type as status."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", 1)
        .when(kind == "click", 2)
        .when(kind == "signup", 0)
        .when(kind == "purchase", 4)
        .otherwise(5)
    )
    number = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("cluster_id"),
        F.floor(number / 25).cast("int").alias("proc_id"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def _stream(spark, sf) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of files."""
    schema = table(spark, sf, "events").schema
    # A stream refuses the plain path of one file, but takes a pattern that only that path fits.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def done_batch(spark, sf):
    latest = ledger.latest_status(_as_status(table(spark, sf, "events")))
    return ledger.clusters_done(latest)


def _tracked(spark, sf) -> str:
    checkpoint = work_dir(spark, "latest")
    done.track_latest(_as_status(_stream(spark, sf)), checkpoint, availableNow=True).awaitTermination()
    return checkpoint


def done_stream(spark, sf):
    return done.done_from_latest(spark, _tracked(spark, sf))


def done_changes(spark, sf):
    """The events as files that arrive one after the other, the jobs' changes summed up."""
    events = _as_status(table(spark, sf, "events"))
    arrived, checkpoint = work_dir(spark, "arrived"), work_dir(spark, "latest")
    events.repartitionByRange(3, F.col("event_id") % 3).write.parquet(arrived)
    stream = spark.readStream.schema(done.LATEST).option("maxFilesPerTrigger", 1).parquet(arrived)
    done.track_latest(stream, checkpoint, availableNow=True).awaitTermination()
    return done.done_from_changes(done.changes(spark, checkpoint)).select(*DONE)


def done_give_up(spark, sf):
    """A job that has been silent for five days is no longer waited for."""
    return done.done_from_latest(spark, _tracked(spark, sf), give_up_after=5 * 86400).select(*DONE)


def late_bounded(spark, sf):
    """Events per hour of a stream with a bound on lateness; a later run would drop late ones."""
    events = late.bounded(_stream(spark, sf).select("event_id", "ts"))
    hourly = events.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n_events"))
    path = work_dir(spark, "hourly")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("window.start").alias("hour"), "n_events").write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    writer = hourly.writeStream.outputMode("update").option("checkpointLocation", work_dir(spark, "offsets"))
    writer.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    # Of an hour the last count stands; counts only grow.
    counts = spark.read.schema("hour timestamp, n_events bigint, batch int").parquet(path)
    return counts.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour")).agg(F.max("n_events").alias("n_events"))


def late_refused(spark, sf):
    """Events that arrive in three rounds: two thirds, the last day of these again, the late third.

    All are accepted, refused as repeats, or refused as more than a day late.
    """
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    early = events.filter("event_id % 3 <> 0")
    since = early.agg(F.date_trunc("millisecond", F.max("ts")) - F.expr("INTERVAL 1 DAY")).first()[0]
    again = early.filter(F.col("ts") > F.lit(since))
    arrived, path, checkpoint = (work_dir(spark, n) for n in ("arrived", "once", "offsets"))
    for rows in (early, again, events.filter("event_id % 3 = 0")):
        rows.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(events.schema).parquet(arrived)
        running = late.write_once(stream, path, checkpoint, ["event_id"], allowed=86400, availableNow=True)
        for query in running:
            query.awaitTermination()
    received, accepted = (spark.read.schema(events.schema).parquet(f"{path}/{n}") for n in ("received", "accepted"))
    parts = late.with_refused(received, accepted, ["event_id"])
    return parts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def follow_logs(spark, sf):
    """Log files by user, streamed while they grow: the odd events are added while the stream runs."""
    events = table(spark, sf, "events").select(
        F.concat(F.lit("user "), F.col("user_id") % 20, F.lit("+a%b.log")).alias("file"),
        ((F.col("event_id") % 2) * 1_000_000_000_000 + F.col("event_id")).alias("no"),
        F.concat("event_type", F.lit(" é "), "event_id").alias("line"),
    )
    logs, out, checkpoint = (work_dir(spark, n) for n in ("growing", "followed", "offsets"))

    sinks.write_files(events.filter("no < 1000000000000"), logs)
    lines = tail.growing_lines(spark, logs, "*.log", part_bytes=100_000)
    query = tail.append_stream(lines, out, checkpoint, processingTime="0 seconds")
    query.processAllAvailable()
    sinks.write_files(events, logs)  # the same lines and more behind them
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(tail.LINES).parquet(out).withColumn("file", F.substring_index("file", "/", -1))


def late_stream(spark, sf):
    """Each event is due at half past its hour."""
    events = _stream(spark, sf).select("event_id", "ts")
    due = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 30 MINUTES")
    marked = late.with_lateness(events, due, F.col("ts"))
    path = work_dir(spark, "lateness")
    tail.append_stream(
        marked.select("event_id", "early_seconds", "lateness"),
        path,
        work_dir(spark, "offsets"),
        availableNow=True,
    ).awaitTermination()
    return spark.read.parquet(path)


def log_stream(spark, sf):
    """The events are written as log files, which are then followed."""
    events = table(spark, sf, "events")
    line = F.concat(
        F.lit("\x1b[33m[fleet|"), F.lpad(F.upper("event_type"), 8, " "), F.lit("|"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("|user"), "user_id",
        F.lit("]:\x1b[0m event "), "event_id",
    )
    logs = work_dir(spark, "logs")
    events.select(line.alias("value")).write.text(logs)
    path = work_dir(spark, "parsed")
    fields = tail.parsed_lines(tail.tail_lines(spark, logs)).drop("file")
    tail.append_stream(fields, path, work_dir(spark, "offsets"), availableNow=True).awaitTermination()
    time = F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")
    return spark.read.parquet(path).withColumn("logged_at", time)


def latest_submission(spark, sf):
    """Orders as submission entries, one submission per month; the latest is read back."""
    orders = table(spark, sf, "orders")
    month = F.date_format("o_orderdate", "yyyyMM01_000000")
    entries = orders.select(
        month.alias("submission_timestamp"),
        F.col("o_orderkey").alias("cluster_id"),
        F.col("o_custkey").alias("njobs"),
    )
    path = work_dir(spark, "submissions")
    sinks.append_submissions(entries, path)
    return sinks.latest_submission(spark, path)


def output_table(spark, sf):
    """Orders as job output by day text, cluster and job; the folders are counted back."""
    orders = table(spark, sf, "orders")
    rows = orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "MMM").alias("datestr"),
        F.ascii("o_orderstatus").cast("bigint").alias("cluster_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("proc_id"),
    )
    path = work_dir(spark, "output")
    sinks.write_output(rows, path)
    sinks.write_output(rows, path, if_exists="keep")
    back = spark.read.parquet(path)
    return back.groupBy("datestr", "cluster_id", "proc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("sum_key")
    )


_DONE = """
with s as (
  select user_id as cluster_id, cast(props ->> '$.k' as int) // 25 as proc_id,
         arg_max(event_type, {'t': ts, 'e': event_id}) as kind
  from events group by 1, 2)
select cluster_id, count(*) as n_jobs, count(*) filter (kind in ('view', 'click')) as n_active,
       count(*) filter (kind in ('view', 'click')) = 0 as done
from s group by cluster_id
"""

QUERIES = {
    "q_done_batch": (done_batch, _DONE),
    "q_done_stream": (done_stream, _DONE),
    "q_done_changes": (done_changes, _DONE),
    "q_done_give_up": (
        done_give_up,
        """with s as (
             select user_id as cluster_id, cast(props ->> '$.k' as int) // 25 as proc_id,
                    arg_max(event_type, {'t': ts, 'e': event_id}) as kind, max(ts) as last
             from events group by 1, 2),
           w as (
             select cluster_id, kind in ('view', 'click')
                    and epoch_us((select max(ts) from events)) - epoch_us(last) <= 432000000000 as waits
             from s)
           select cluster_id, count(*) as n_jobs, count(*) filter (waits) as n_active,
                  count(*) filter (waits) = 0 as done
           from w group by cluster_id""",
    ),
    "q_late_bounded": (
        late_bounded,
        "select date_trunc('hour', ts) as hour, count(*) as n_events from events group by 1",
    ),
    "q_late_refused": (
        late_refused,
        """with t as (select date_trunc('milliseconds', max(ts)) - interval 1 day as since
                      from events where event_id % 3 <> 0)
           select event_id, ts,
                  case when event_id % 3 = 0 and ts <= since then 'late' else 'accepted' end as part
           from events, t
           union all
           select event_id, ts, 'repeat' from events, t where event_id % 3 <> 0 and ts > since""",
    ),
    "q_follow_logs": (
        follow_logs,
        """with l as (
             select 'user ' || (user_id % 20) || '+a%b.log' as file, event_id % 2 as part, event_id,
                    event_type || ' é ' || event_id as line
             from events)
           select file, line, cast(coalesce(sum(strlen(line) + 1) over (
                    partition by file order by part, event_id
                    rows between unbounded preceding and 1 preceding), 0) as bigint) as position
           from l""",
    ),
    "q_late_stream": (
        late_stream,
        """with s as (
             select event_id, (epoch_us(date_trunc('hour', ts) + interval 30 minutes)
                               - epoch_us(ts)) / 1000000.0::double as early_seconds
             from events)
           select *, case when early_seconds >= 0 then 'early'
                       when -early_seconds < 300 then 'late' else 'too_late' end as lateness
           from s""",
    ),
    "q_log_stream": (
        log_stream,
        """select 'fleet' as logger, upper(event_type) as level,
                  strftime(ts, '%Y-%m-%d %H:%M:%S') as logged_at, 'user' || user_id as module,
                  'event ' || event_id as message
           from events""",
    ),
    "q_latest_submission": (
        latest_submission,
        """with o as (select *, strftime(o_orderdate, '%Y%m01_000000') as submission_timestamp
                      from orders)
           select o_orderkey as cluster_id, o_custkey as njobs, submission_timestamp from o
           where submission_timestamp = (select max(submission_timestamp) from o)""",
    ),
    "q_output_table": (
        output_table,
        """select strftime(o_orderdate, '%b') as datestr,
                  cast(ascii(o_orderstatus) as int) as cluster_id,
                  cast(o_orderpriority[1] as int) as proc_id, count(*) as n_rows,
                  cast(sum(o_orderkey) as bigint) as sum_key
           from orders group by 1, 2, 3""",
    ),
}
