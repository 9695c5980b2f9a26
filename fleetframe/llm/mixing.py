"""Mixing sources to target weights by subset-sum budget fitting.

Per source, documents are counted by exact length. A first pass deals the budget over the lengths
in proportion, but for a reserve, and what remains is fitted by a bounded knapsack (which sums can
be reached with the documents left). Then so many documents of each length are chosen in a seeded
order. A budget beyond the source's size takes every document once
and fits the excess the same way, so no document is taken more than twice.

Defined results: a null text has size zero; a null source is a source of its own, last in order.
Repeated rows are rows like any other. A table without words has targets of zero. An empty table
gives an empty table. Reruns agree: the order is a hash of the row and the seed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import WORD, ranked, whole_row, written

WEIGHTS = (3, 1, 2)  # repeating over the sources
SHARE = 1.5  # of all sizes
MOST = 2.0  # times a source's own size
SEED = 17
RESERVE = 1 << 15  # words of a budget that the proportional pass leaves to the knapsack
SPAN = 1 << 17  # sums that the knapsack tells apart; a larger rest is fitted in coarser units
ROW = ("doc_id", "source", "text")
RANK_ROWS = 1_000_000  # rows of one source and length that one task numbers


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); what a full source cannot take is
    dealt again by weight until no target exceeds its bound."""
    spark = sizes.sparkSession
    # Position in code point order, nulls last: counted per partition of the sorted rows.
    ordered = written(
        sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()),
        "sources",
    )
    per_part = ordered.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()
    starts, seen = {}, 0
    for part, n in per_part:  # a row per partition
        starts[part] = seen
        seen += n
    shift = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part long, shift long")
    weighed = written(
        ordered.join(F.broadcast(shift), F.shiftright("_at", 33) == F.col("part")).select(
            "source", "source_size",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.expr("shift + (_at & 8589934591)") % len(weights) + 1).cast("int"),
            ).alias("weight"),
        ),
        "weights",
    )
    # One level for all: target = min(bound, level * weight). Sources below the level's demand
    # are full; each round fixes more of them until none is above.
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, bound = 0.0, F.col("source_size") * most
    while total:
        full = F.col("weight") * level >= bound
        open_weight, taken = weighed.agg(
            F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, bound))
        ).first()
        if not open_weight:
            break
        fresh = (share * total - (taken or 0.0)) / open_weight
        if fresh <= level:
            break
        level = fresh
    return weighed.select(
        "source", "source_size", F.least(bound, F.col("weight") * F.lit(level)).alias("target")
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take so that their sizes come near the budget."""
    order = np.argsort(-lengths)
    lengths, counts = lengths[order], counts[order]
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if total and budget > 0:
        share = min(1.0, max(0.0, budget - RESERVE) / total)
        due = share * np.cumsum(lengths * counts)
        sum_ = 0
        for i, (length, have) in enumerate(zip(lengths.tolist(), counts.tolist())):
            if length:
                taken[i] = min(have, max(0, int((due[i] - sum_) // length)))
                sum_ += int(taken[i]) * length
        missing = round(budget) - sum_
        if missing > 0:
            unit = max(1, math.ceil(2 * missing / span))
            taken += _knapsack(lengths, counts - taken, missing, unit)
    out = np.zeros(len(lengths), np.int64)
    out[order] = taken
    return out


def _knapsack(lengths: np.ndarray, left: np.ndarray, missing: int, unit: int) -> np.ndarray:
    """Bounded subset sums as bits of a whole number; the sum nearest to `missing` wins."""
    goal = round(missing / unit)
    mask = (1 << (2 * goal + 1)) - 1
    reached, steps = 1, []
    for i in np.random.default_rng(SEED).permutation(len(lengths)).tolist():
        size, have = round(lengths[i] / unit), int(left[i])
        if not 0 < size <= 2 * goal:
            continue
        have, pack = min(have, 2 * goal // size), 1
        while have:  # 1, 2, 4, ... copies make any number of them
            pack = min(pack, have)
            steps.append((i, pack, size * pack, reached))
            reached |= (reached << (size * pack)) & mask
            have, pack = have - pack, pack * 2
        if reached >> goal & 1:
            break
    gap = next(g for g in range(goal + 1) if reached >> (goal - g) & 1 or reached >> (goal + g) & 1)
    at = goal - gap if reached >> (goal - gap) & 1 else goal + gap
    more = np.zeros(len(lengths), np.int64)
    for i, pack, size, before in reversed(steps):
        if not before >> at & 1:
            more[i] += pack
            at -= size
    return more


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = target >= size
    quota = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), target - size * whole)
    return pd.DataFrame(
        {"source": rows["source"], "size": rows["size"], "passes": int(whole), "quota": quota}
    )


def mixed(docs: DataFrame, seed: int = SEED, row: tuple[str, ...] = ROW) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every row of (doc_id, text, source).

    `draw` is the hash of the columns `row` that orders the rows; copies is how often the mix holds
    a row: 0, 1 or 2.
    """
    sized = written(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed, row).alias("draw")
        ),
        "sizes",
    )
    histogram = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = written(targets(sizes), "targets")
    wanted = histogram.join(
        aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    # A source's group is its distinct lengths, of which a corpus of W words has at most sqrt(2 W).
    quotas = wanted.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, passes int, quota long"
    )
    rules = written(
        quotas.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
            F.col("source").alias("_source"), F.col("size").alias("_size"),
            "passes", "quota", "source_size", "target",
        ),
        "quotas",
    )
    most = histogram.agg(F.max("n")).first()[0] or 0
    salts = max(64, math.ceil(most / RANK_ROWS))
    # The salt is the upper part of the draw, so the numbering follows the draw as a whole.
    salt = F.shiftrightunsigned("draw", 32) % salts
    numbered = ranked(sized, ["source", "size"], [F.col("draw"), F.col("doc_id")], "_rank", salt)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    copies = F.col("passes") + (F.col("_rank") < F.col("quota")).cast("int")
    return numbered.join(rules, same).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
        copies.alias("copies"), "draw",
    )


def draw(seed: int = SEED, row: tuple[str, ...] = ROW) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in row])


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix themselves, a document as often as it is taken."""
    # Rows that are equal in all columns share a draw: they are one row with the sum of their copies.
    whole = (*ROW, *sorted(set(docs.columns) - set(ROW)))
    shares = mixed(docs, seed, whole)
    by_draw = shares.groupBy(F.col("draw").alias("_draw"), F.col("doc_id").alias("_id")).agg(
        F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    )
    held = docs.select(whole_row(docs).alias("_doc"), "doc_id", draw(seed, whole).alias("_own"))
    wanted = (F.col("_own") == F.col("_draw")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    taken = held.join(by_draw.where("_copies > 0").hint("merge"), wanted)
    once = taken.where("_rows = 1").unionByName(
        taken.where("_rows > 1").dropDuplicates(["_draw", "_id"])
    )
    return once.select("_doc", F.explode(F.sequence(F.lit(1), "_copies"))).select("_doc.*")
