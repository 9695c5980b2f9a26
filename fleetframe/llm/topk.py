"""Exact top-k inner products by a uniform threshold in three phases.

A score is the sum of the scores of slices of the vector; each slice is a list in the sense of the
method. First each block of candidates gathers its best entries of every slice's list and scores
them whole: the k-th best of a query's gathered scores is a cutoff that no true result can miss.
The cutoff goes back with the query. A candidate that reaches it must reach cutoff / slices in one
slice at least, so only such entries are collected; the scores they lack in the other slices are
resolved exactly, and of those that reach the cutoff each block hands on at most k.

Queries meet all candidates block by block, an equality join on block numbers; blocks have a fixed
size, so tasks do not grow with the table.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Rows that repeat an id are rows of their own: each is a candidate to all others,
and each asks if its id does. Other columns are not looked at, whatever their names. Shorter vectors are as if filled up with zeros. Scores beyond a long are cut to its range. A query
with fewer than k candidates returns them all; without candidates it returns nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import written

K = 20
SLICES = 2
BLOCK = 8192  # candidates of a task
QUERY_BLOCK = 2048  # queries of a task
STEP = 64  # queries scored at once
EXACT = 2**53  # whole numbers below this are exact as doubles


def quantized(vectors: DataFrame, key: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(id, v): floor(scale * x) of the rows that take part."""
    usable = F.expr(f"forall(`{vector}`, x -> x is not null and not isnan(x) and abs(double(x)) < double('inf'))")
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable)
    return rows.select(F.col(key).alias("id"), whole.alias("v"))


def _matrix(rows: pa.Table, exact: bool) -> np.ndarray:
    lists = rows["v"].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1).astype(float if exact else object)


def _slices(q: np.ndarray, c: np.ndarray, slices: int) -> list[np.ndarray]:
    cuts = np.linspace(0, q.shape[1], slices + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:]) if a < b]


def _steps(queries: pa.Table, candidates: pa.Table, slices: int):
    """For some queries at a time: their position and each slice's scores against the block."""
    highest = [
        np.abs(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)).max(initial=0)
        for t in (queries, candidates)
    ]
    width = len(queries["v"][0])
    exact = highest[0] * highest[1] * max(1, width) < EXACT / slices
    q, c = _matrix(queries, exact), _matrix(candidates, exact)
    for at in range(0, len(q), STEP):
        yield at, _slices(q[at : at + STEP], c, slices)


def _as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        bound = np.iinfo(np.int64)
        scores = np.array([min(max(int(s), bound.min), bound.max) for s in scores], object)
    return scores.astype(np.int64)


def _gathered(k: int, slices: int):
    def gather(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out_ids, out_scores = [], []
        if len(queries) and len(candidates):
            ids, own = queries["row"].to_numpy(), candidates["row"].to_numpy()
            for at, lists in _steps(queries, candidates, slices):
                total = sum(lists[1:], lists[0])
                n = total.shape[1]
                wide = min(k + 1, n)  # one more, as a query may find itself
                near = np.concatenate([np.argpartition(-s, wide - 1, axis=1)[:, :wide] for s in lists], 1)
                for i in range(len(total)):
                    seen = np.unique(near[i])
                    seen = seen[own[seen] != ids[at + i]]
                    best = np.sort(_as_long(total[i, seen]))[::-1][:k]
                    out_scores.append(best)
                    out_ids.append(np.full(len(best), ids[at + i]))
        return pa.table({
            "query": np.concatenate([np.zeros(0, np.int64), *out_ids]),
            "score": np.concatenate([np.zeros(0, np.int64), *out_scores]),
        })

    return gather


def _resolved(k: int, slices: int):
    def resolve(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [np.zeros((4, 0), np.int64)]
        if len(queries) and len(candidates):
            ids, own, named = queries["row"].to_numpy(), candidates["row"].to_numpy(), candidates["id"].to_numpy()
            asking = queries["id"].to_numpy()
            cutoff = queries["cutoff"].to_pylist()
            for at, lists in _steps(queries, candidates, slices):
                total = lists[0].shape[0]
                low = [cutoff[at + i] for i in range(total)]
                bound = np.array([-np.inf if x is None else x for x in low], float)[:, None]
                if lists[0].dtype == object:
                    bound = np.array([-(10**400) if x is None else x for x in low], object)[:, None]
                enough = lists[0] * len(lists) >= bound
                for s in lists[1:]:
                    enough |= s * len(lists) >= bound
                row, column = np.nonzero(enough)
                score = sum((s[row, column] for s in lists[1:]), lists[0][row, column])
                keep = (score >= bound[row, 0]) & (own[column] != ids[at + row])
                row, column, score = row[keep], column[keep], _as_long(score[keep])
                order = np.lexsort((own[column], named[column], ~score, row))  # ~ turns the order without overflow
                row, column, score = row[order], column[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                first = place < k
                asked = at + row[first]
                found.append(np.stack([ids[asked], asking[asked], named[column[first]], score[first]]))
        query, query_id, vec, score = np.concatenate(found, axis=1)
        return pa.table({"query": query, "query_id": query_id, "vec": vec, "score": score})

    return resolve


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
    k: int = K, slices: int = SLICES, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows; `is_query` is on `id`."""
    # The number of a row tells it from others of its id.
    numbered = quantized(vectors, key, vector).withColumn("row", F.monotonically_increasing_id())
    plain = written(numbered, "vectors")
    width, rows, asked = plain.agg(
        F.max(F.size("v")), F.count(F.lit(1)), F.count(F.when(is_query, 1))
    ).first()
    blocks, query_blocks = (max(1, math.ceil(n / b)) for n, b in ((rows, block), (asked, query_block)))
    filled = plain.select(
        "id", "row", F.expr(f"concat(v, array_repeat(0L, {width or 0} - size(v)))").alias("v")
    ).where(F.size("v") > 0)
    every = filled.select(
        "*", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
    )
    queries = filled.where(is_query).select(
        "*", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).alias("q")
    )

    def met(asking: DataFrame, function, schema: str) -> DataFrame:
        spread = asking.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        left = spread.withColumn("c", F.col("c").cast("long")).groupBy("c", "q")
        own = every.withColumn("q", F.col("q").cast("long"))
        right = own.toDF(*own.columns).groupBy("c", "q")  # columns of its own, as both are one table
        return left.cogroup(right).applyInArrow(function, schema)

    lists = met(queries, _gathered(k, slices), "query long, score long")
    nth = Window.partitionBy("query").orderBy(F.col("score").desc())
    cutoffs = written(
        lists.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= k).where(F.col("_n") == k)
        .select("query", F.col("score").alias("cutoff")),
        "cutoffs",
    )
    told = queries.join(cutoffs, F.col("row") == F.col("query"), "left").drop("query")
    entries = met(told, _resolved(k, slices), "query long, query_id long, vec long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec")
    return (
        entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec").alias("vec_id"), "score")
    )
