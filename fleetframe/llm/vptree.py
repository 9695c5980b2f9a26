"""Nearest neighbours by vantage-point trees, one per shard, with relaxed triangle pruning.

The rows are dealt into shards of a bounded size and each shard becomes a tree: a node has a vantage
point and the ranges of the distances from it to the points of its inner and its outer child. The
trees are written once; every row is in one of them. Blocks of queries then meet lanes of shards. In
a task a block walks the lane's trees one after another, all queries of the block together, first the
child that is nearer to more of them, and each query carries its k-th distance from tree to tree. By the triangle inequality a child
holds nothing nearer than the gap between a query's distance to the vantage point and the child's
range; the child is left out where factor * gap exceeds the query's k-th distance. Factor one
restores exact search; more prunes more and may miss some neighbours.

Defined results: vectors that are null, all zero or hold null or non-finite components take no part,
nor do rows without an id; a query among them gives no rows. Shorter vectors are as if filled up
with zeros. Rows that repeat an id are rows of their own: each is a candidate to the others, ties go
to the smaller id and then to the row written first. A query with fewer than k candidates gets all
that there are; an empty table gives an empty table. Other columns are not looked at, whatever their
names. Distances beyond the doubles are infinite and come last.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import written

K = 10
FACTOR = 6.0  # recall and work by factor: see the README
SHARD_ROWS = 4096
SHARD_BYTES = 8 << 20  # of a shard's vectors, whichever is less
LANE = 8  # shards that a task walks
QUERY_BLOCK = 64
LEAF = 64
SLACK = 1e-9  # relative rounding that a product of vectors may have

_INDEX = "shard long, ids binary, rows binary, vectors binary, tree binary"
_FOUND = "query_row long, query_id long, vec_id long, vec_row long, score double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, as doubles."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), whole.alias("v")).where("id is not null and v is not null")
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    return rows.where(f"{finite} and exists(v, x -> x <> 0)")


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row per query; from differences, so equal vectors have distance 0."""
    difference = queries[:, None, :] - points[None, :, :]
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("qpd,qpd->qp", difference, difference))


class Tree:
    """Nodes as rows of a table: vantage point, children, and the children's distance ranges.

    A child at or above 0 is a node; below 0, -1 - child is the first of a leaf's points. `order`
    has the points, so that each leaf is one stretch of it.
    """

    def __init__(self, order: np.ndarray, nodes: np.ndarray):
        self.order, self.nodes = order, nodes

    @classmethod
    def grown(cls, points: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
        chance = np.random.default_rng(seed)
        order, nodes = np.arange(len(points)), []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            if stop - start <= leaf:
                at, count = -1 - start, stop - start
            else:
                at, count = len(nodes), 0
                pick = int(chance.integers(start, stop))
                order[[start, pick]] = order[[pick, start]]
                rest = order[start + 1 : stop]
                far = distances(points[rest], points[order[start]][None])[0]
                by_distance = np.argsort(far, kind="stable")
                order[start + 1 : stop], far = rest[by_distance], far[by_distance]
                half = len(far) // 2
                nodes.append([order[start], 0, 0, 0, 0, far[0], far[half - 1], far[half], far[-1]])
                todo.append((start + 1 + half, stop, at, 1))
                todo.append((start + 1, start + 1 + half, at, 0))
            if parent >= 0:
                nodes[parent][1 + side], nodes[parent][3 + side] = at, count
        return cls(order, np.array(nodes, float).reshape(-1, 9))

    def packed(self) -> bytes:
        return self.order.astype(np.int64).tobytes() + self.nodes.tobytes()

    @classmethod
    def unpacked(cls, packed: bytes, points: int) -> Tree:
        order = np.frombuffer(packed, np.int64, points)
        return cls(order, np.frombuffer(packed, float, -1, 8 * points).reshape(-1, 9))


class Nearest:
    """The k nearest candidates so far of every query of a block, and the work it took."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int):
        self.queries, self.rows, self.k = queries, rows, k
        self.far = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.at = np.full((len(queries), k), -1)
        self.compared = 0

    def meet(self, who: np.ndarray, points: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare some queries with some points; by products first, the close ones by differences."""
        self.compared += len(who) * len(points)
        asked, bound = self.queries[who], self.far[who, -1]
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.einsum("qd,qd->q", asked, asked)[:, None] + np.einsum("pd,pd->p", points, points)
            beyond = size * (1 - SLACK) - 2 * (asked @ points.T) > (bound * bound * (1 + SLACK))[:, None]
        close = ~beyond & (rows[None, :] != self.rows[who][:, None])
        hit = np.flatnonzero(close.any(1))
        if len(hit):
            better, point = who[hit], np.flatnonzero(close[hit].any(0))
            ids, rows = ids[point], rows[point]
            met = np.where(close[np.ix_(hit, point)], distances(points[point], asked[hit]), np.nan)
            shape = met.shape
            every = np.concatenate([self.far[better], met], 1)
            names = np.concatenate([self.ids[better], np.broadcast_to(ids, shape)], 1)
            place = np.concatenate([self.at[better], np.broadcast_to(rows, shape)], 1)
            # What is not close sorts last as not a number; free places are infinite, with the last name.
            first = np.lexsort((place, names, every), axis=-1)[:, : self.k]
            gone = np.isnan(np.take_along_axis(every, first, 1))
            self.far[better] = np.where(gone, np.inf, np.take_along_axis(every, first, 1))
            self.ids[better] = np.where(gone, np.iinfo(np.int64).max, np.take_along_axis(names, first, 1))
            self.at[better] = np.where(gone, -1, np.take_along_axis(place, first, 1))

    def walk(self, tree: Tree, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, factor: float) -> None:
        everyone = np.arange(len(self.queries))
        if not len(tree.nodes):
            self.meet(everyone, points, ids, rows)
            return
        todo = [(0, 0, everyone, np.zeros(len(everyone)))]
        while todo:
            at, count, who, gap = todo.pop()
            near = factor * gap <= self.far[who, -1]
            who = who[near]
            if not len(who):
                continue
            if at < 0:
                leaf = tree.order[-1 - at : -1 - at + count]
                self.meet(who, points[leaf], ids[leaf], rows[leaf])
                continue
            node = tree.nodes[at]
            vantage = [int(node[0])]
            self.meet(who, points[vantage], ids[vantage], rows[vantage])
            far = distances(points[vantage], self.queries[who])[:, 0]
            gap = gap[near]
            inner = np.maximum(gap, np.maximum(node[5] - far, far - node[6]))
            outer = np.maximum(gap, np.maximum(node[7] - far, far - node[8]))
            sides = [(0, inner), (1, outer)]
            if 2 * np.count_nonzero(inner <= outer) >= len(who):
                sides.reverse()  # the last one put here comes first
            for side, bound in sides:
                todo.append((int(node[1 + side]), int(node[3 + side]), who, bound))


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    lists = rows["v"].combine_chunks()
    flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out[np.arange(width)[None, :] < cuts[:, None]] = flat
    return out


def _grower(width: int):
    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        points, shard = _matrix(rows, width), rows["shard"][0].as_py()
        tree = Tree.grown(points, shard)
        packed = [rows["id"].to_numpy().tobytes(), rows["row"].to_numpy().tobytes(), points.tobytes(), tree.packed()]
        return pa.table([[shard], *([p] for p in packed)], ["shard", "ids", "rows", "vectors", "tree"])

    return grow


def _searcher(width: int, k: int, factor: float):
    def search(asked: pa.Table, shards: pa.Table) -> pa.Table:
        asked = asked.sort_by("row")
        best = Nearest(_matrix(asked, width), asked["row"].to_numpy(), k)
        shards = shards.sort_by("shard")
        for ids, rows, vectors, tree in zip(*(shards[c] for c in ("ids", "rows", "vectors", "tree"))):
            ids, rows = (np.frombuffer(x.as_py(), np.int64) for x in (ids, rows))
            points = np.frombuffer(vectors.as_py(), float).reshape(-1, width)
            best.walk(Tree.unpacked(tree.as_py(), len(ids)), points, ids, rows, factor)
        found = best.at >= 0
        many = found.sum(1)
        return pa.table({
            "query_row": np.repeat(best.rows, many), "query_id": np.repeat(asked["id"].to_numpy(), many),
            "vec_id": best.ids[found], "vec_row": best.at[found], "score": best.far[found],
        })

    return search


def nearest(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding",
    k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, lane: int = LANE, block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found; `is_query` is on `id`."""
    numbered = usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id())
    plain = written(numbered, "vectors")
    width, count, asked = plain.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    width = width or 1
    shards = max(1, math.ceil(count / max(LEAF, min(shard_rows, SHARD_BYTES // (8 * width)))))
    lanes, blocks = math.ceil(shards / lane), max(1, math.ceil(asked / block))
    dealt = plain.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "id", "row", "v")
    index = written(dealt.groupBy("shard").applyInArrow(_grower(width), _INDEX), "trees")
    spread = index.select(
        "*", (F.col("shard") % lanes).alias("lane"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    queries = plain.where(is_query).select(
        "id", "row", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("long").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"),
    )
    found = queries.groupBy("lane", "block").cogroup(spread.groupBy("lane", "block")).applyInArrow(
        _searcher(width, k, factor), _FOUND
    )
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "vec_row")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
