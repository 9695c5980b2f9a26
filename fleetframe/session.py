"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators are planned for. Nothing below depends on them for
# right results; they only steer the physical plan.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side is broadcast only once its size has been measured, never by the size of its files.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Split skewed join partitions even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A table already hashed on (cluster_id, proc_id) may join on (cluster_id, proc_id, name)
    # without being moved again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


_made: list[str] = []  # by this driver


def build_session(app: str = "fleetframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.match(r"local(\[|$)", master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="fleetframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; the first write creates it."""
    path = f"{shared_dir(spark)}/fleetframe/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_work(spark: SparkSession) -> None:
    """Delete what was written below the shared folder, once the results that read it are used."""
    while _made:
        place = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
