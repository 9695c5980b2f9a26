"""Lateness of streamed events, the bound it puts on state, and the rows that state refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetframe.functions.times import ALLOWED_LATENESS, early_seconds, lateness


def with_lateness(
    events: DataFrame, scheduled: Column, now: Column, allowed: float = ALLOWED_LATENESS
) -> DataFrame:
    """Label each row; a projection, so it is the same on a stream and on a table."""
    return events.withColumns(
        {
            "early_seconds": early_seconds(scheduled, now),
            "lateness": lateness(scheduled, now, allowed),
        }
    )


def bounded(events: DataFrame, time: str = "ts", allowed: float = ALLOWED_LATENESS) -> DataFrame:
    """Let stateful operators behind this one forget what is older than the allowed lateness.

    A wall-clock time column becomes a timestamp first, as a watermark needs one.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, f"{int(allowed)} seconds")


def once(events: DataFrame, keys: list[str], time: str = "ts", allowed: float = ALLOWED_LATENESS) -> DataFrame:
    """The first row of each key; repeats within the lateness and rows that come too late go.

    The state holds a key until the watermark has passed its first row by the allowed lateness.
    """
    return bounded(events, time, allowed).dropDuplicatesWithinWatermark(keys)


def write_once(
    events: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str],
    time: str = "ts",
    allowed: float = ALLOWED_LATENESS,
    **trigger,
) -> list[StreamingQuery]:
    """Start writing what comes to `path`/received and what is accepted to `path`/accepted.

    A stateful operator gives no word of the rows it drops, so each table is a query of its own with
    its own place in the source: `received` is a plain copy and `accepted` the state's choice.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    parts = {"received": stamped, "accepted": once(stamped, keys, time, allowed)}
    return [
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/{name}")
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(**trigger)
        .start()
        for name, rows in parts.items()
    ]


def with_refused(received: DataFrame, accepted: DataFrame, keys: list[str], out: str = "part") -> DataFrame:
    """All received rows, each `accepted`, a `repeat` of an accepted key, or `late`.

    The refused rows are the difference of the two tables as multisets, so the parts together are the
    input even where rows are equal in all columns. Null keys are keys like others. Rows that the
    accepting query has not read yet would count as refused: both queries must have come equally far.
    """
    refused = received.exceptAll(accepted)
    known = accepted.select(*[F.col(k).alias(f"_known{i}") for i, k in enumerate(keys)]).distinct()
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_known{i}"))
    repeats = refused.join(known, match, "left_semi").withColumn(out, F.lit("repeat"))
    late = refused.join(known, match, "left_anti").withColumn(out, F.lit("late"))
    return accepted.withColumn(out, F.lit("accepted")).unionByName(repeats).unionByName(late)
