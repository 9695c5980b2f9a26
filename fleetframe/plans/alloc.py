"""Budgets, slots and chunks: orders stand for requests, their customer for the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators import alloc, ordered
from fleetframe.plans import table

LIMIT = 25


def requests(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_custkey").alias("session"),
        F.col("o_orderkey").alias("i"),
        (F.lit(1) + F.floor(F.col("o_totalprice") / 100000)).cast("int").alias("njobs"),
    )


def budget_cap(spark, sf):
    return alloc.cap_requests(requests(spark, sf), LIMIT)


def requested_total(spark, sf):
    return alloc.total_requested(requests(spark, sf), LIMIT, ["session"])


def cluster_numbers(spark, sf):
    return alloc.number_clusters(requests(spark, sf))


def slots(spark, sf):
    laid = ordered.sum_before(requests(spark, sf), ["session"], "i", "njobs", "first")
    return alloc.slots(laid, first=F.col("first")).select("session", "i", "proc_id")


def replicas(spark, sf):
    return alloc.slots(requests(spark, sf)).select("session", "i", "proc_id")


def assign_clusters(spark, sf):
    """Clusters are runs of a thousand order keys; one that reaches 8 jobs reports one fewer."""
    entries = requests(spark, sf).withColumnRenamed("session", "submission")
    runs = entries.groupBy("submission", F.floor(F.col("i") / 1000).alias("cluster_id")).agg(
        F.sum("njobs").alias("_n")
    )
    clusters = runs.select(
        "submission",
        F.col("cluster_id").alias("i"),
        "cluster_id",
        F.when(F.col("_n") >= 8, F.col("_n") - 1).otherwise(F.col("_n")).alias("njobs"),
    )
    return alloc.assign_clusters(entries, clusters)


def hot_key_totals(spark, sf):
    """Two keys hold the whole table, in an order of text with many ties: cut into ranges."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("key"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("part"),
        F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("source"),
        F.col("l_quantity").cast("decimal(12,2)").alias("amount"),
    )
    # Rows that are equal in all of these columns are one row, so the order is unique.
    rows = lines.distinct()
    order = ["month", "job", "part", "item", "source", "amount"]
    return ordered.sum_before(rows, ["key"], order, "amount", "before", ranges=16).select(
        "key", "job", "part", "item", "source", F.col("before").cast("double").alias("before")
    )


def _items(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))


def chunks(spark, sf):
    return alloc.chunked(_items(spark, sf), "item", n_chunks=28)


def chunks_by_size(spark, sf):
    return alloc.chunked(_items(spark, sf), "item", chunk_size=700)


def chunk_sizes(spark, sf):
    return alloc.chunk_sizes(chunks(spark, sf), "item", 28)


def ith_chunk(spark, sf):
    return alloc.ith_chunk(_items(spark, sf), "item", n_chunks=28, i=5)


_REQUESTS = """
with r as (
  select o_custkey as session, o_orderkey as i,
         cast(1 + floor(o_totalprice / 100000) as int) as njobs
  from orders
), b as (
  select *, cast(coalesce(sum(njobs) over (partition by session order by i
              rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from r
)
"""


def _chunk_sql(n: str) -> str:
    return f"""
    with x as (
      select o_orderkey as item, row_number() over (order by o_orderkey) - 1 as p from orders
    ), l as (select count(*) as length, {n} as n from orders),
    k as (
      select chunk, chunk * (length::double / n) as low, (chunk + 1) * (length::double / n) as high
      from l, unnest(range(cast(n as bigint))) as u(chunk)
    ), c as (select item, chunk from x join k on p >= low and p < high)
    """


QUERIES = {
    "q_budget_cap": (
        budget_cap,
        _REQUESTS
        + f"""select session, i, njobs,
                     cast(least(njobs, greatest({LIMIT} - before, 0)) as bigint) as granted
              from b where before < {LIMIT}""",
    ),
    "q_requested_total": (
        requested_total,
        _REQUESTS
        + f"""select session, cast(sum(njobs) as bigint) as requested,
                     cast(least(sum(njobs), {LIMIT}) as bigint) as total
              from r group by session""",
    ),
    "q_cluster_numbers": (
        cluster_numbers,
        _REQUESTS
        + """select session, i, njobs,
                    row_number() over (partition by session order by i) - 1 as i_cluster
             from r""",
    ),
    "q_slots": (
        slots,
        _REQUESTS
        + "select session, i, unnest(range(before, before + njobs)) as proc_id from b",
    ),
    "q_replicas": (
        replicas,
        _REQUESTS + "select session, i, unnest(range(cast(njobs as bigint))) as proc_id from r",
    ),
    "q_assign_clusters": (
        assign_clusters,
        _REQUESTS
        + """, g as (
          select session, cast(floor(i / 1000) as bigint) as cluster_id,
                 cast(sum(njobs) as bigint) as s
          from r group by 1, 2
        ), c as (
          select *, high - n as low from (
            select session, cluster_id, case when s >= 8 then s - 1 else s end as n,
                   cast(sum(case when s >= 8 then s - 1 else s end)
                     over (partition by session order by cluster_id) as bigint) as high
            from g)
        ), j as (
          select b.session as submission, b.i, b.njobs, c.cluster_id,
                 b.before - c.low as first_proc_id,
                 coalesce(b.before + b.njobs <= c.high, false) as nested
          from b left join c
            on b.session = c.session and b.before >= c.low and b.before < c.high
        )
        select *, bool_or(not nested) over (partition by submission order by i) as drifted
        from j""",
    ),
    "q_hot_key_totals": (
        hot_key_totals,
        """with d as (
             select distinct l_linestatus as key, strftime(l_shipdate, '%Y-%m') as month,
                    l_orderkey as job, l_linenumber as part, l_partkey as item, l_suppkey as source,
                    cast(l_quantity as decimal(12,2)) as amount
             from lineitem)
           select key, job, part, item, source,
                  cast(coalesce(sum(amount) over (partition by key
                    order by month, job, part, item, source, amount
                    rows between unbounded preceding and 1 preceding), 0) as double) as before
           from d""",
    ),
    "q_chunks": (chunks, _chunk_sql("28") + "select item, chunk from c"),
    "q_chunks_by_size": (
        chunks_by_size,
        _chunk_sql("ceil(count(*) / 700.0)") + "select item, chunk from c",
    ),
    "q_chunk_sizes": (
        chunk_sizes,
        _chunk_sql("28")
        + """select chunk, count(*) as n_items, min(item) as first_item, max(item) as last_item
             from c group by chunk""",
    ),
    "q_ith_chunk": (ith_chunk, _chunk_sql("28") + "select item from c where chunk = 5"),
}
