"""SimHash near-duplicates: fingerprints joined with themselves over binary tries.

Two fingerprints that differ in 4 bits at most differ in one bit at most in one of three segments.
So there are three tries, each with another segment on top (the bits are rotated), whose first
levels have an error budget of one bit: a subtree meets itself and the subtrees one bit away, and
such a pair of subtrees is a task. Within the task node pairs are walked together, adding up the
differing bits and leaving pairs that exceed the budget, down to small leaves that are compared
whole. Node pairs that are already one component are left out too, as links serve components only.
The depth of the split follows the number of fingerprints; a subtree that is still too large is
dealt into chunks, and each pair of chunks becomes a task. Nothing is capped.

Defined results: a text without words, empty or null, has fingerprint zero, linked like any other.
Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows and equal texts
have equal fingerprints and so one component. component_id is the smallest id that is not null,
null where a component has none. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import text_hashes, whole_row, written
from fleetframe.llm.graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = (0, 22, 43)  # where each segment starts: 22, 21 and 21 bits
SEGMENT_BITS = 21
NODE = 2048  # wanted fingerprints of a subtree
CHUNK = 8192  # the most of a side of a task
LEAF = 1 << 16  # pairs compared at once


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    digest, stops = xxhash.xxh64_intdigest, ends[SHINGLE - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """The 64 bits as a signed long."""
    bits = np.array([simhash(t.as_py()) for t in text], np.uint64)
    return pa.array(bits.view(np.int64), pa.int64())


def hex64(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def link_roots(keys: np.ndarray, second: np.ndarray | None, budget: int = MAX_BITS) -> np.ndarray:
    """For sorted distinct keys (the first side, then the second) the position of each one's root.

    A walk over pairs of trie nodes; a node is a range of a sorted side, which shares its first
    bits. Without a second side the keys meet themselves.
    """
    every = keys if second is None else np.concatenate([keys, second])
    root = np.arange(len(every))
    if second is None:
        pairs = [(0, len(keys), 0, len(keys), 63, 0)]
    else:
        pairs = [(0, len(keys), len(keys), len(every), 63, 0)]
    while pairs:
        a, b, c, d, bit, differing = pairs.pop()
        if differing > budget or a == b or c == d:
            continue
        if root[a] == root[c] and (root[a:b] == root[a]).all() and (root[c:d] == root[a]).all():
            continue
        if (b - a) * (d - c) <= LEAF or bit < 0:
            close = np.bitwise_count(every[a:b, None] ^ every[None, c:d]) <= budget
            i, j = np.nonzero(close)
            met = np.stack([root[a + i], root[c + j]], 1)
            for x, y in np.unique(met[met[:, 0] != met[:, 1]], axis=0).tolist():
                x, y = root[x], root[y]
                if x != y:
                    root[root == max(x, y)] = min(x, y)
            continue
        mask = np.uint64(1 << bit)
        m = a + int(np.count_nonzero(every[a:b] & mask == 0))
        n = c + int(np.count_nonzero(every[c:d] & mask == 0))
        pairs.append((a, m, c, n, bit - 1, differing))
        pairs.append((m, b, n, d, bit - 1, differing))
        pairs.append((a, m, n, d, bit - 1, differing + 1))
        if a != c:  # the mirrored pair of a node with itself is the same
            pairs.append((m, b, c, n, bit - 1, differing + 1))
    return root


def _join_nodes(rows: pa.Table) -> pa.Table:
    keys = rows["key"].to_numpy().view(np.uint64)
    side = rows["side"].to_numpy()
    sides = [np.sort(keys[side == s]) for s in (0, 1)]
    turn = int(rows["turn"][0].as_py())
    if len(sides[1]):
        every = np.concatenate(sides)
        root = link_roots(*sides) if len(sides[0]) else np.arange(len(every))
    else:
        every = sides[0]
        alone = rows["flip"][0].as_py() < 0 and rows["i"][0] == rows["j"][0]
        root = link_roots(every, None) if alone else np.arange(len(every))
    moved = np.flatnonzero(root != np.arange(len(root)))
    u, v = every[moved], every[root[moved]]
    if turn:  # back to the bits as they were
        back = np.uint64(turn), np.uint64(64 - turn)
        u, v = ((x >> back[0]) | (x << back[1]) for x in (u, v))
    return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})


def trie_links(prints: DataFrame, node: int = NODE, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect whatever lies within 4 bits; `prints` has distinct longs `bits`.

    Not all close pairs: of each task's links those that span its components.
    """
    depth = min(SEGMENT_BITS, max(0, math.ceil(math.log2(max(1, prints.count()) / node))))
    turned = None
    for start in SEGMENTS:
        key = F.col("bits")
        if start:
            key = F.shiftleft("bits", start).bitwiseOR(F.shiftrightunsigned("bits", 64 - start))
        part = prints.select(F.lit(start).alias("turn"), key.alias("key"))
        turned = part if turned is None else turned.unionByName(part)
    top = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    placed = turned.withColumn("node", top)
    sizes = placed.groupBy(F.col("turn").alias("t"), F.col("node").alias("at")).agg(
        F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")
    )
    hot = written(sizes.where("chunks > 1"), "hot-nodes")

    def chunks_of(rows: DataFrame, at: str, out: str) -> DataFrame:
        match = (F.col("turn") == F.col("t")) & (F.col(at) == hot["at"])
        return rows.join(hot, match, "left").select(
            *rows.columns, F.coalesce("chunks", F.lit(1)).cast("int").alias(out)
        )

    own = chunks_of(placed, "node", "own").withColumn(
        "c", F.expr("cast(pmod(xxhash64(key), own) as int)")
    )
    flips = F.array(*[F.lit(b) for b in range(-1, depth)])
    met = own.withColumn("flip", F.explode(flips)).withColumn(
        "other", F.expr("case when flip < 0 then node else node ^ shiftleft(1L, flip) end")
    )
    met = chunks_of(met, "other", "theirs")
    met = met.withColumn("k", F.explode(F.expr("sequence(0, theirs - 1)")))
    # The side with the smaller node, or in one node the smaller chunk, comes first.
    first = F.expr("case when flip < 0 then c <= k else node < other end")
    tasks = met.select(
        "turn", "flip", "key",
        F.least("node", "other").alias("low"),
        F.when(first, F.col("c")).otherwise(F.col("k")).alias("i"),
        F.when(first, F.col("k")).otherwise(F.col("c")).alias("j"),
        F.when(first, 0).otherwise(1).alias("side"),
    )
    return tasks.groupBy("turn", "low", "flip", "i", "j").applyInArrow(
        _join_nodes, "u long, v long"
    )


def grouped(rows: DataFrame, bits: str = "bits", node: int = NODE, chunk: int = CHUNK) -> DataFrame:
    """(bits, root): the component of every distinct fingerprint, named by its smallest member."""
    prints = written(rows.select(F.col(bits).alias("bits")).distinct(), "fingerprints")
    roots = components(trie_links(prints, node, chunk))
    return prints.join(roots, F.col("bits") == F.col("node"), "left").select(
        "bits", F.coalesce("root", "bits").alias("root")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, `bits` and component_id."""
    prints = written(docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("bits")), "bits")
    roots = written(grouped(prints), "roots")
    least = prints.groupBy("bits").agg(F.min("id").alias("id"))
    named = roots.join(least, "bits").groupBy("root").agg(F.min("id").alias("component_id"))
    by_bits = written(roots.join(named, "root").select("bits", "component_id"), "components")
    return prints.join(by_bits, "bits").select(F.col("id").alias(key), "bits", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Null ids come last; equal ids are told apart by their texts, and of repeated rows one stays.
    """
    h1, h2 = text_hashes(text)
    prepared = docs.select(
        F.col(key).isNull().alias("late"), F.col(key).alias("id"), h1.alias("h1"), h2.alias("h2"),
        fingerprint(F.col(text)).alias("bits"),
    )
    prints = written(
        prepared.groupBy("late", "id", "h1", "h2", "bits").agg(F.count(F.lit(1)).alias("copies")),
        "bits",
    )
    roots = written(grouped(prints), "roots")
    first = F.min(F.struct("late", "id", "h1", "h2", "copies")).alias("first")
    by_bits = prints.groupBy("bits").agg(first)
    kept = roots.join(by_bits, "bits").groupBy("root").agg(F.min("first").alias("first"))
    own = docs.select(
        whole_row(docs).alias("doc"), F.col(key).alias("own"), h1.alias("t1"), h2.alias("t2")
    )
    stay = own.join(
        kept.select("first.*").hint("merge"),
        F.col("own").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")),
    )
    repeated = stay.where("copies > 1").dropDuplicates(["late", "id", "h1", "h2"])
    return stay.where("copies = 1").unionByName(repeated).select("doc.*")
