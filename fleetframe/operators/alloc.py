"""Budgets, slots, chunks and the matching of submitted counts to requests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.ordered import (
    index_and_count,
    index_within,
    last_so_far,
    rows_at,
    sum_before,
)
from fleetframe.session import shuffle_partitions, work_dir

SLOT_BLOCK = 65536


def number_clusters(
    requests: DataFrame, session: str = "session", order: str = "i", out: str = "i_cluster"
) -> DataFrame:
    """Number the requests of a session from 0 in creation order."""
    return index_within(requests, [session], order, out)


def cap_requests(
    requests: DataFrame,
    limit: int | None,
    session: str = "session",
    order: str = "i",
    njobs: str = "njobs",
    out: str = "granted",
) -> DataFrame:
    """Grant requests in order until the limit of the session is used up.

    The last grant may be partial, requests without any grant are dropped. A limit of None
    means none at all, 0 grants nothing.
    """
    if limit is None:
        return requests.withColumn(out, F.col(njobs).cast("bigint")).filter(F.col(out) > 0)
    before = sum_before(requests, [session], order, njobs, "_before")
    left = F.greatest(F.lit(limit) - F.col("_before"), F.lit(0))
    granted = before.withColumn(out, F.least(F.col(njobs), left).cast("bigint")).drop("_before")
    return granted.filter(F.col(out) > 0)


def total_requested(
    requests: DataFrame, limit: int | None, keys: list[str] | None = None, njobs: str = "njobs"
) -> DataFrame:
    """Requested jobs and the part of them inside the limit."""
    total = F.coalesce(F.sum(njobs), F.lit(0))
    bounded = total if limit is None else F.least(total, F.lit(limit))
    return requests.groupBy(*(keys or [])).agg(
        total.alias("requested"), bounded.cast("bigint").alias("total")
    )


def slots(
    requests: DataFrame, njobs: str = "njobs", first: Column | None = None, out: str = "proc_id"
) -> DataFrame:
    """One row per job of a request, numbered from `first` (0) on.

    A request is cut into blocks of ids before the ids are unfolded, and the blocks are spread,
    so that one huge request does not stay in one task.
    """
    start = F.lit(0).cast("bigint") if first is None else first.cast("bigint")
    n = F.col(njobs).cast("bigint")
    blocks = requests.filter(n > 0).withColumns(
        {
            "_first": start,
            "_block": F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.expr(f"({njobs} - 1) div {SLOT_BLOCK}"))
            ),
        }
    )
    parts = shuffle_partitions(requests.sparkSession)
    low = F.col("_block") * SLOT_BLOCK
    high = F.least(low + SLOT_BLOCK, n) - 1
    # Only the blocks of large requests are spread; one block is no more than a task's share.
    large = blocks.filter(n > SLOT_BLOCK).repartition(parts)
    return (
        blocks.filter(n <= SLOT_BLOCK)
        .unionByName(large)
        .withColumn(out, F.explode(F.sequence(F.col("_first") + low, F.col("_first") + high)))
        .drop("_first", "_block")
    )


def chunk_of(index: Column, length: Column, n_chunks: Column) -> Column:
    """Chunk k of item i: k*f <= i < (k+1)*f with f = length/n_chunks in double.

    The bounds are rounded products, so the floor of i/f can be one off and is put right
    against both of them.
    """
    f = length.cast("double") / n_chunks.cast("double")
    guess = F.floor(index.cast("double") / f)
    return (
        F.when(index.cast("double") < guess.cast("double") * f, guess - 1)
        .when(index.cast("double") >= (guess + 1).cast("double") * f, guess + 1)
        .otherwise(guess)
    )


def chunked(
    items: DataFrame,
    order: str,
    n_chunks: int | None = None,
    chunk_size: int | None = None,
    out: str = "chunk",
) -> DataFrame:
    """Cut an ordered table into balanced chunks, by their number or by a size to aim at.

    With a size there are ceil(length/size) chunks, balanced again and so not of that size.
    """
    if (n_chunks is None) == (chunk_size is None):
        raise ValueError("give either n_chunks or chunk_size")
    indexed, length = index_and_count(items, order, "_index")
    if chunk_size is not None:
        n_chunks = -(-length // chunk_size)
    chunk = chunk_of(F.col("_index"), F.lit(length), F.lit(max(n_chunks, 1)))
    return indexed.withColumn(out, chunk.cast("bigint")).drop("_index")


def ith_chunk(items: DataFrame, order: str, n_chunks: int, i: int) -> DataFrame:
    """One chunk of `chunked`; of the others only the row counts of their ranges are read."""
    if not 0 <= i < n_chunks:
        raise IndexError(f"chunk {i} of {n_chunks}")
    length = items.count()
    f = length / n_chunks
    # One row more on either side covers the rounding; the rule itself decides.
    near = rows_at(items, order, int(i * f) - 1, math.ceil((i + 1) * f) + 1, "_index")
    chunk = chunk_of(F.col("_index"), F.lit(length), F.lit(n_chunks))
    return near.filter(chunk == i).drop("_index")


def chunk_sizes(chunks: DataFrame, order: str, n_chunks: int) -> DataFrame:
    """Size and order bounds of every chunk, also of the empty ones."""
    sizes = chunks.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min(order).alias("first_item"),
        F.max(order).alias("last_item"),
    )
    numbers = chunks.sparkSession.range(n_chunks).withColumnRenamed("id", "chunk")
    return numbers.join(sizes, "chunk", "left").withColumn(
        "n_items", F.coalesce("n_items", F.lit(0))
    )


def assign_clusters(
    entries: DataFrame, clusters: DataFrame, submission: str = "submission", order: str = "i"
) -> DataFrame:
    """Give each submitted entry the cluster whose run of jobs it falls into.

    Entries (`submission, i, njobs`) and reported clusters (`submission, i, njobs, cluster_id`)
    are both laid end to end. An entry belongs to the latest cluster that starts at or before
    it, if it starts before that cluster ends. `nested` says that the entry also ends inside;
    `drifted` marks entries at or after one that does not, where counting alone cannot tell.
    """
    laid = sum_before(entries, [submission], order, "njobs", "_start")
    runs = sum_before(clusters, [submission], order, "njobs", "_start").select(
        submission,
        F.col(order).alias("_order"),
        "_start",
        F.lit(0).alias("_kind"),
        F.struct(
            F.col("cluster_id"),
            F.col("_start").alias("low"),
            (F.col("_start") + F.col("njobs")).alias("high"),
        ).alias("_run"),
    )
    rows = laid.select(
        submission,
        F.col(order).alias("_order"),
        "_start",
        F.lit(1).alias("_kind"),
        F.struct(*[c for c in entries.columns if c != submission]).alias("_entry"),
    )
    # Written once: the steps below read it several times, and its positions are window results.
    path = work_dir(entries.sparkSession, "laid")
    both = rows.unionByName(runs, allowMissingColumns=True)
    both.write.parquet(path)
    both = entries.sparkSession.read.schema(both.schema).parquet(path)
    known = last_so_far(both, [submission], ["_start", "_kind", "_order"], "_run", "_at")
    inside = F.col("_start") < F.col("_at.high")
    end = F.col("_start") + F.col("_entry.njobs")
    found = (
        known.filter(F.col("_kind") == 1)
        .withColumn("_hit", F.when(inside, F.col("_at")))
        .select(
            submission,
            "_entry.*",
            F.col("_hit.cluster_id").alias("cluster_id"),
            (F.col("_start") - F.col("_hit.low")).alias("first_proc_id"),
            F.coalesce(end <= F.col("_hit.high"), F.lit(False)).alias("nested"),
        )
    )
    # Whether an entry of the submission before this one, or this one, is loose: counted as a sum
    # over the earlier rows, which is cut like any other.
    counted = sum_before(
        found.withColumn("_loose", (~F.col("nested")).cast("int")), [submission], order, "_loose", "_before"
    )
    drifted = (F.col("_before") > 0) | ~F.col("nested")
    return counted.withColumn("drifted", drifted).drop("_loose", "_before")
