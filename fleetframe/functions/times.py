"""Submission timestamps, zone shifts and lateness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyyMMdd_HHmmss"
DAY_FORMAT = "MMMdd"
ALLOWED_LATENESS = 300.0


def timestamp_text(time: Column) -> Column:
    return F.date_format(time, TIMESTAMP_FORMAT)


def parse_timestamp_text(text: Column) -> Column:
    """Wall-clock timestamp of a submission; null for any other text."""
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)).cast("timestamp_ntz")


def day_text(time: Column) -> Column:
    return F.date_format(time, DAY_FORMAT)


def local_to_utc(time: Column, zone: Column) -> Column:
    """Wall-clock time in `zone` to wall-clock time in UTC, by the zone rules of that moment."""
    return F.convert_timezone(zone, F.lit("UTC"), time.cast("timestamp_ntz"))


def wall_micros(time: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session time zone."""
    ntz = time.cast("timestamp_ntz")
    days = F.unix_date(ntz.cast("date")).cast("bigint")
    minutes = days * 1440 + F.hour(ntz) * 60 + F.minute(ntz)
    micros = (F.extract(F.lit("SECOND"), ntz) * 1000000).cast("bigint")
    return minutes * 60000000 + micros


def early_seconds(scheduled: Column, now: Column) -> Column:
    """Seconds from now to the schedule; negative when the schedule has passed."""
    return (wall_micros(scheduled) - wall_micros(now)) / F.lit(1000000.0)


def lateness(scheduled: Column, now: Column, allowed: float = ALLOWED_LATENESS) -> Column:
    """'early', 'late' (less than `allowed` seconds ago) or 'too_late'."""
    early = early_seconds(scheduled, now)
    return (
        F.when(early >= 0, F.lit("early"))
        .when(-early < allowed, F.lit("late"))
        .when(-early >= allowed, F.lit("too_late"))
    )


def seconds_to_wait(scheduled: Column, now: Column) -> Column:
    return F.greatest(early_seconds(scheduled, now), F.lit(0.0))
