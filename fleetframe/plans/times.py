"""Submission times, zone shifts and lateness."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetframe.functions import times as C
from fleetframe.operators.ordered import next_value
from fleetframe.plans import table


def timestamps(spark, sf):
    e = table(spark, sf, "events")
    text = C.timestamp_text(F.col("ts"))
    return e.select(
        "event_id",
        text.alias("submitted"),
        C.parse_timestamp_text(text).alias("parsed"),
        C.parse_timestamp_text(F.concat(F.lit("x"), text)).alias("malformed"),
        C.day_text(F.col("ts")).alias("day"),
    )


def to_utc(spark, sf):
    o = table(spark, sf, "orders")
    local = F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")
    zone = F.when(F.col("o_orderstatus") == "F", F.lit("Europe/Berlin")).otherwise(
        F.lit("America/Chicago")
    )
    return o.select("o_orderkey", C.local_to_utc(local, zone).alias("utc"))


def lateness(spark, sf):
    """The next event of the user less five hours is the schedule of an event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    following = next_value(e, ["user_id"], ["ts", "event_id"], "ts", "following")
    due = F.col("following") - F.expr("INTERVAL 5 HOURS")
    return following.select(
        "event_id",
        C.early_seconds(due, F.col("ts")).alias("early_seconds"),
        C.seconds_to_wait(due, F.col("ts")).alias("wait_seconds"),
        C.lateness(due, F.col("ts"), allowed=3600.0).alias("lateness"),
    ).filter(F.col("early_seconds").isNotNull())


QUERIES = {
    "q_timestamps": (
        timestamps,
        """select event_id, strftime(ts, '%Y%m%d_%H%M%S') as submitted,
                  date_trunc('second', ts) as parsed, cast(null as timestamp) as malformed,
                  strftime(ts, '%b%d') as day
           from events""",
    ),
    "q_to_utc": (
        to_utc,
        """select o_orderkey, timezone('UTC', timezone(
                    case when o_orderstatus = 'F' then 'Europe/Berlin' else 'America/Chicago' end,
                    o_orderdate + interval 9 hours)) as utc
           from orders""",
    ),
    "q_lateness": (
        lateness,
        """with n as (
             select event_id, ts,
                    lead(ts) over (partition by user_id order by ts, event_id)
                      - interval 5 hours as due
             from events
           ), s as (
             select event_id, (epoch_us(due) - epoch_us(ts)) / 1000000.0::double as early_seconds
             from n where due is not null)
           select event_id, early_seconds,
                  greatest(early_seconds, 0.0::double) as wait_seconds,
                  case when early_seconds >= 0 then 'early' when -early_seconds < 3600 then 'late'
                    else 'too_late' end as lateness
           from s""",
    ),
}
