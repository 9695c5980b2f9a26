"""When is a cluster of jobs done: streams of status events to a per-cluster answer.

A streaming aggregate keeps the latest event of each job in the engine's state store: one row per job,
on the executors' disks, checkpointed as change logs. A question reads the state of the last committed
batch through the state data source, and what each batch changed through its change feed; there are no
files but the query's own checkpoint. A batch that is repeated starts from the state before it, so it
counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.functions.status import ACTIVE_STATUSES
from fleetframe.operators.ledger import JOB, clusters_done
from fleetframe.sources import folders

LATEST = "cluster_id bigint, proc_id int, status int, ts timestamp, event_id bigint"
# State on disk, not on the heap, with logs of changes, which the change feed reads.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_EVENT = "value.max"  # the aggregate's name in the state


def track_latest(events: DataFrame, checkpoint: str, **trigger):
    """Keep the latest event per job, by time and then event_id, in the state below the checkpoint.

    Partial aggregates are formed before the shuffle, so a cluster or job of any size leaves one
    row per job and task.
    """
    spark = events.sparkSession
    latest = events.groupBy(*JOB).agg(F.max(F.struct("ts", "event_id", "status")).alias("latest"))
    writer = latest.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:  # a query keeps the settings that it starts with
        return writer.trigger(**trigger).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that was committed, -1 without one."""
    done = [int(n) for n in folders.names(spark, f"{checkpoint}/commits") if n.isdigit()]
    return max(done, default=-1)


def tracked(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The latest event of each job after a committed batch, the last one if none is named."""
    if _committed(spark, checkpoint) < 0:
        return spark.createDataFrame([], LATEST)
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("key.*", f"{_EVENT}.*").select("cluster_id", "proc_id", "status", "ts", "event_id")


def done_from_latest(
    spark: SparkSession, checkpoint: str, give_up_after: float | None = None
) -> DataFrame:
    """Per-cluster answer from the tracked jobs; the latest event of a job counts.

    With `give_up_after`, an active job that has been silent for more seconds than that, by the
    newest event seen, is no longer waited for.
    """
    latest = tracked(spark, checkpoint)
    if give_up_after is not None:
        newest = latest.agg(F.max(F.unix_micros("ts"))).scalar()
        silent = (newest - F.unix_micros("ts")) / 1e6 > give_up_after
        latest = latest.withColumn("status", F.when(silent, F.lit(None)).otherwise(F.col("status")))
    return clusters_done(latest)


def changes(spark: SparkSession, checkpoint: str, since: int = 0) -> DataFrame:
    """What each batch from `since` on changed in a cluster: cluster_id, batch, jobs, active.

    A job's status after a batch is that of the latest event so far; an event seen twice, or one
    that comes too late to count, changes nothing. Changes can be asked for as far back as the
    engine keeps them (`spark.sql.streaming.minBatchesToRetain`); what a job was before `since` is
    read from the state of the batch before.
    """
    if _committed(spark, checkpoint) < since:
        return spark.createDataFrame([], "cluster_id bigint, batch bigint, jobs bigint, active bigint")
    feed = spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", since)
    states = feed.load(checkpoint).select("key.*", F.col("batch_id").alias("batch"), F.col(_EVENT).alias("_now"))
    if since:
        old = tracked(spark, checkpoint, since - 1)
        touched = states.select(*JOB).distinct()
        event = F.struct("ts", "event_id", "status").alias("_now")
        states = states.unionByName(
            old.select(*JOB, F.lit(since - 1).cast("bigint").alias("batch"), event).join(touched, JOB, "left_semi")
        )
    moved = states.withColumn("_was", F.lag("_now").over(Window.partitionBy(*JOB).orderBy("batch")))

    def active(state: str) -> Column:
        status = F.col(f"{state}.status")
        return F.coalesce(status.isin(*ACTIVE_STATUSES), F.lit(False)).cast("int")

    return (
        moved.filter(F.col("batch") >= since)
        .groupBy("cluster_id", "batch")
        .agg(
            F.sum(F.col("_was").isNull().cast("int")).alias("jobs"),
            F.sum(active("_now") - active("_was")).alias("active"),
        )
        .filter((F.col("jobs") != 0) | (F.col("active") != 0))
    )


def done_from_changes(changed: DataFrame) -> DataFrame:
    """Per-cluster answer from the changes: nothing is active any more."""
    return changed.groupBy("cluster_id").agg(
        F.sum("jobs").alias("n_jobs"),
        F.sum("active").alias("n_active"),
        (F.sum("active") == 0).alias("done"),
    )
