"""Fan-out over all orders, retries, the second round, and entry ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetframe.operators import entries, fanout
from fleetframe.plans import table
from fleetframe.session import work_dir

KEYS = ["o_orderkey"]


def _params(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _bill(scope: dict) -> str:
    if scope["o_orderstatus"] == "F" and scope["o_totalprice"] > 250000:
        raise ValueError(f"order {scope['o_orderkey']}")
    return f"{scope['o_orderkey']} {scope['o_orderstatus']}"


def _bill_from_second_attempt(scope: dict) -> str:
    if scope["attempt"] < scope["o_totalprice"] // 150000:
        raise RuntimeError(f"attempt {scope['attempt']}")
    return scope["o_orderstatus"]


def _bill_any(scope: dict) -> str:
    if scope["o_totalprice"] > 400000:
        raise SystemExit(3)
    return "again"


def run(spark, sf):
    return fanout.fan_out(_params(spark, sf), _bill, KEYS)


def retry(spark, sf):
    allowed = F.when(F.col("o_orderstatus") == "P", 3).otherwise(1)
    params = _params(spark, sf).withColumn("allowed", allowed)
    ledger = fanout.fan_out(params, _bill_from_second_attempt, KEYS, attempts="allowed", pause=0)
    return ledger


def rerun(spark, sf):
    params = _params(spark, sf)
    path = work_dir(spark, "ledger")
    fanout.append_ledger(fanout.fan_out(params, _bill, KEYS), path)
    ledger = fanout.rerun_failed(params, path, _bill_any, KEYS, pause=0)
    return fanout.latest_attempt(ledger, KEYS)


def first_job(spark, sf):
    return fanout.first_job(_params(spark, sf), "o_orderkey")


def entry_ranges(spark, sf):
    """Event types as files, in the order of their names, cut into eleven chunks."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("file"), "event_id")
    numbered = entries.number_entries(events, "event_id")
    files = events.groupBy("file").agg(F.count(F.lit(1)).alias("n_entries"))
    # Names have no number to order by: the letters decide, of which there are few.
    files = files.withColumn("file_no", F.ascii("file"))
    chunks = entries.entry_chunks(files, n_chunks=11)
    return entries.cut_entries(numbered, chunks)


QUERIES = {
    "q_fanout": (
        run,
        """select o_orderkey, 0 as round, 1 as attempts, cast(bad as int) as exitcode,
                  case when not bad then o_orderkey || ' ' || o_orderstatus end as out,
                  case when bad then 'ValueError: order ' || o_orderkey end as err
           from (select *, o_orderstatus = 'F' and o_totalprice > 250000 as bad from orders)""",
    ),
    "q_retry": (
        retry,
        """with n as (
             select *, greatest(cast(floor(o_totalprice / 150000) as int), 1) as need,
                    case when o_orderstatus = 'P' then 3 else 1 end as allowed
             from orders)
           select o_orderkey, 0 as round, least(need, allowed) as attempts,
                  cast(need > allowed as int) as exitcode,
                  case when need <= allowed then o_orderstatus end as out,
                  case when need > allowed then 'RuntimeError: attempt ' || allowed end as err
           from n""",
    ),
    "q_rerun": (
        rerun,
        """with b as (
             select *, o_orderstatus = 'F' and o_totalprice > 250000 as bad,
                    o_totalprice > 400000 as worse
             from orders)
           select o_orderkey, cast(bad as int) as round, 1 as attempts,
                  case when bad and worse then 3 else 0 end as exitcode,
                  case when not bad then o_orderkey || ' ' || o_orderstatus
                    when not worse then 'again' end as out,
                  case when bad and worse then 'exit 3' end as err
           from b""",
    ),
    "q_first_job": (
        first_job,
        """select o_orderkey, o_orderstatus, o_totalprice from orders
           order by o_orderkey limit 1""",
    ),
    "q_entry_ranges": (
        entry_ranges,
        """with e as (
             select event_type as file, event_id,
                    row_number() over (partition by event_type order by event_id) - 1 as entry_no,
                    row_number() over (order by ascii(event_type), event_id) - 1 as p
             from events
           ), l as (select count(*) / 11.0::double as f from events),
           k as (select chunk, chunk * f as low, (chunk + 1) * f as high
                 from l, unnest(range(11)) as u(chunk)),
           c as (select e.*, chunk from e join k on p >= low and p < high)
           select file, event_id, entry_no, chunk,
                  min(entry_no) over (partition by chunk, file) as first,
                  max(entry_no) over (partition by chunk, file) + 1 as last
           from c""",
    ),
}
