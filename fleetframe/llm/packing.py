"""Best-fit packing of documents into sequences by a linear grouping scheme.

Lengths are small whole numbers, so the plan is made from their histogram, which has a row per
possible length however large the corpus: large lengths are dealt into groups of equal cardinality
and rounded up to the longest of their group; the few sizes that are left are packed into
configurations by a linear program (columns from a knapsack); actual documents take the places of
the rounded ones, longest first. Documents of configurations that come out loose, and what rounding
the program left over, are grouped again; the last of them and all small documents go best-fit into
the space that remains. The plan is a table of places, at most a few ten thousand
rows, and a document finds its own by its length and its rank among documents of that length.

Defined results: a null text is an empty one, whose only id is the end. Repeated rows are packed
each. Only documents longer than a sequence are cut, and only their first piece may be shorter
than a sequence. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import ranked, written

CAPACITY = 1024
END_ID = 2
GROUPS = 400  # of equal cardinality
SMALL = 8  # a length below capacity / SMALL is small
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
NEAR = 1e-3  # how far from its optimum the linear program may stop
ROUNDS = 40  # of pricing at most; the program has a solution after any of them
LOOSE = 1  # free tokens of a configuration that stays
FAIR = 0.1  # share of the large documents that another round has to place
RANK_ROWS = 1_000_000  # documents of one length that one task numbers


def token_pieces(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """(key, piece, start, length, ids): `ids` are little-endian unsigned 32-bit token ids.

    The ids are those of `tokenizers` with the vocabulary's JSON file and without special tokens
    added; an end-of-text string inside a text is its special id there and here. `ranks` holds the
    same vocabulary in the form that `tiktoken` reads, which is several times faster.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as file:  # part of the installed tokenizers, on every executor
            words = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        coder = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=words, special_tokens={})

        def ids_of(text: str) -> list[int]:
            if SPECIAL not in text:
                return coder.encode_ordinary(text)
            first, *rest = map(coder.encode_ordinary, text.split(SPECIAL))
            return first + [i for part in rest for i in (SPECIAL_ID, *part)]

        for batch in batches:
            rows, pieces, starts, lengths, data = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = ids_of(value.as_py() or "")
                ids.append(end_id)
                packed = np.array(ids, "<u4").tobytes()
                at, n, piece = 0, len(ids) % capacity or capacity, 0
                while at < len(ids):
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(n)
                    data.append(packed[4 * at : 4 * (at + n)])
                    at, n, piece = at + n, capacity, piece + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                names=[key, "piece", "start", "length", "ids"],
            )

    fields = [
        T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
    return docs.select(key, text).mapInArrow(cut, T.StructType(fields))


# --- the plan, on the histogram ---


def _groups(counts: dict[int, int], wanted: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, its actual (length, count) runs), longest first, of equal cardinality."""
    each = math.ceil(sum(counts.values()) / wanted)
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                if groups and groups[-1][0] == length:
                    room = each  # a group that would round to the same length is the same size
                else:
                    groups.append((length, []))
                    room = each
            n = min(left, room)
            runs = groups[-1][1]
            if runs and runs[-1][0] == length:
                runs[-1] = (length, runs[-1][1] + n)
            else:
                runs.append((length, n))
            left, room = left - n, room - n
    return groups


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest worth that fits into each space, and its last piece (-1: as for one token less).

    No piece is shorter than the shortest, so that many spaces follow from the ones before at once.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    width = int(sizes.min())
    for low in range(width, capacity + 1, width):
        space = np.arange(low, min(low + width, capacity + 1))
        left = space[None, :] - sizes[:, None]
        value = np.where(left >= 0, best[np.maximum(left, 0)] + worth[:, None], -1.0)
        pick = value.argmax(0)
        top = value[pick, np.arange(len(space))]
        most = np.maximum.accumulate(np.maximum(top, best[low - 1]))
        best[space], last[space] = most, np.where(top >= most, pick, -1)
    return best, last


def _content(sizes: np.ndarray, last: np.ndarray, space: int) -> np.ndarray:
    """How many pieces of each size the best filling of a space has."""
    counts = np.zeros(len(sizes), int)
    while space > 0:
        if last[space] < 0:
            space -= 1
        else:
            counts[last[space]] += 1
            space -= sizes[last[space]]
    return counts


def _first_columns(sizes: np.ndarray, needs: np.ndarray, capacity: int) -> np.ndarray:
    """A basis: the longest size left with the fullest filling, as often as its pieces last.

    The size that is used up first has this column; later ones do without it, so they are independent.
    """
    columns = np.diag((capacity // sizes).astype(float))
    left, open_ = needs.copy(), np.ones(len(sizes), bool)
    while open_.any():
        among = np.flatnonzero(open_)
        first = among[0]
        _, last = _knapsack(sizes[among], sizes[among] / capacity, capacity)
        content = np.zeros(len(sizes))
        content[among] = _content(sizes[among], last, capacity - sizes[first])
        content[first] += 1
        lasts = np.where(content > 0, left / np.maximum(content, 1), np.inf)
        used = int(lasts.argmin())
        columns[:, used] = content
        left = left - lasts[used] * content
        open_[used] = False
        open_ &= left > 1e-9  # the others keep the column that holds only them
    return columns


def configurations(sizes: list[int], needs: list[int], capacity: int) -> list[tuple[float, np.ndarray]]:
    """(how often, pieces of each size): a basic solution of the linear program.

    `sizes` come longest first. Any prices of the pieces bound the number of sequences from below;
    new configurations are priced half way between the current prices and those of the best bound
    so far, which begins with the share of a sequence that a piece takes. One table of fillings
    gives a configuration for every size, the best that holds it; those that pay enter the basis.
    """
    sizes_, needs_ = np.array(sizes), np.array(needs, float)
    columns = _first_columns(sizes_, needs_, capacity)
    trusted, bound = sizes_ / capacity, float(sizes_ @ needs_) / capacity
    for _ in range(ROUNDS):
        inverse = np.linalg.inv(columns)  # anew each round, so that errors do not add up
        amount = inverse @ needs_
        if amount.sum() <= bound * (1 + NEAR):
            break
        prices, entered = inverse.sum(0), False
        for worth in ((np.maximum(prices, 0) + trusted) / 2, np.maximum(prices, 0)):
            best, last = _knapsack(sizes_, worth, capacity)
            if worth @ needs_ / best[capacity] > bound:
                trusted, bound = worth / best[capacity], float(worth @ needs_ / best[capacity])
            value = worth + best[capacity - sizes_]
            for first in np.argsort(-value, kind="stable"):
                fresh = _content(sizes_, last, capacity - sizes_[first])
                fresh[first] += 1
                gain = prices @ fresh - 1
                if gain <= 1e-6:
                    continue
                amount, step = inverse @ needs_, inverse @ fresh
                ratio = np.where(step > 1e-7, np.maximum(amount, 0) / np.where(step > 1e-7, step, 1), np.inf)
                tied = ratio <= ratio.min() * (1 + 1e-9) + 1e-9
                out = int(np.where(tied, step, 0).argmax())  # the safest of those that are used up
                columns[:, out] = fresh
                pivot = inverse[out] / step[out]
                inverse -= np.outer(step, pivot)
                inverse[out] = pivot
                prices = prices - gain * pivot
                entered = True
            if entered:
                break
        if not entered:
            break
    amount = np.linalg.solve(columns, needs_)
    return [(float(x), columns[:, i].astype(int)) for i, x in enumerate(amount) if x > 1e-6]


class _Bins:
    """Sequences in runs of equal content: (how many, [(length, copies), ...]) by free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_free: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]

    def add(self, n: int, content: tuple) -> None:
        free = self.capacity - sum(length * copies for length, copies in content)
        self.by_free[free].append((n, content))

    def best_fit(self, length: int, n: int) -> None:
        """Place n pieces, each where the least space is left over; open sequences if none fits."""
        free = length
        while n and free <= self.capacity:
            if not self.by_free[free]:
                free += 1
                continue
            have, content = self.by_free[free].pop()
            n = self._fill(length, n, have, content, free)
        if n:
            self._fill(length, n, -(-n // (self.capacity // length)), (), self.capacity)

    def _fill(self, length: int, n: int, have: int, content: tuple, free: int) -> int:
        copies = free // length  # the fullest stays the best fit until it is full
        full = min(have, n // copies)
        if full:
            self.add(full, content + ((length, copies),))
            have, n = have - full, n - full * copies
        if have and n:
            self.add(1, content + ((length, n),))
            have, n = have - 1, 0
        if have and (content or n):
            self.by_free[free].append((have, content))
        return n

    def runs(self) -> list[tuple[int, tuple]]:
        return [run for runs in self.by_free for run in runs if run[1]]


def _rounded(found: list[tuple[float, np.ndarray]], needs: list[int]) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of configurations: rounded down, then one more of each that can still be filled.

    Those with the greatest fractions come first.
    """
    left, out = np.array(needs), []
    for x, content in found:
        held = content > 0
        often = min(int(x + 1e-6), int((left[held] // content[held]).min()))  # x is a float
        left -= often * content
        out.append((often, content))
    fractions = [x - often for (x, _), (often, _) in zip(found, out)]
    for i in sorted(range(len(out)), key=lambda i: -fractions[i]):
        often, content = out[i]
        if fractions[i] > 1e-6 and (content <= left).all():
            left -= content
            out[i] = (often + 1, content)
    return [(often, content) for often, content in out if often]


def _substituted(large: dict[int, int], capacity: int, groups: int) -> list[tuple[int, tuple]]:
    """Configurations of the rounded lengths with actual documents in their places."""
    grouped = _groups(large, groups)
    queues = [list(runs) for _, runs in grouped]
    needs = [sum(c for _, c in runs) for _, runs in grouped]
    out = []
    for often, content in _rounded(configurations([s for s, _ in grouped], needs, capacity), needs):
        # Each place takes a stretch of its group's documents; where the length changes in any
        # of them, another kind of sequence begins.
        stretches = []
        for g in [g for g, copies in enumerate(content) for _ in range(copies)]:
            taken, left = [], often
            while left:
                length, have = queues[g][0]
                n = min(left, have)
                taken.append((length, n))
                left -= n
                queues[g][0] = (length, have - n)
                if have == n:
                    queues[g].pop(0)
            stretches.append(taken)
        while stretches[0]:
            n = min(s[0][1] for s in stretches)
            lengths: dict[int, int] = {}
            for s in stretches:
                length, have = s[0]
                lengths[length] = lengths.get(length, 0) + 1
                s[0] = (length, have - n)
                if have == n:
                    s.pop(0)
            out.append((n, tuple(lengths.items())))
    return out


def configured(
    counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS
) -> tuple[list[tuple[int, tuple]], dict[int, int]]:
    """Sequences of large documents by configurations, and the histogram of what they do not hold.

    Configurations whose actual documents leave more than LOOSE tokens free are given up. Their
    documents and those that rounding the linear program left over are grouped anew, more finely as
    they are fewer, and planned again, as long as that places a fair share of them.
    """
    runs, rest = [], {n: c for n, c in counts.items() if c}
    while True:
        large = {n: c for n, c in rest.items() if n * SMALL > capacity}
        placed = 0
        for n, content in _substituted(large, capacity, groups) if large else []:
            if capacity - sum(length * copies for length, copies in content) > LOOSE:
                continue
            runs.append((n, content))
            for length, copies in content:
                placed += n * copies
                rest[length] -= n * copies
                if not rest[length]:
                    del rest[length]
        if placed <= FAIR * sum(large.values()):
            return runs, rest


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """(sequences, [(length, copies), ...]) for the histogram of lengths of at most `capacity`.

    The large documents that no configuration holds go best-fit, and so do the small ones behind.
    """
    runs, rest = configured(counts, capacity, groups)
    bins = _Bins(capacity)
    for n, content in runs:
        bins.add(n, content)
    for length in sorted(rest, reverse=True):
        bins.best_fit(length, rest[length])
    return bins.runs()


def places(runs: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, sequences, first sequence, offset) for each run and length."""
    at: dict[int, int] = {}
    out, first = [], 0
    for n, content in runs:
        offset = 0
        for length, copies in content:
            start = at.get(length, 0)
            at[length] = start + n * copies
            out.append((length, start, start + n * copies, n, first, offset))
            offset += length * copies
        first += n
    return out


PLACES = "p_length long, p_from long, p_to long, p_many long, p_first long, p_offset long"


def packed(pieces: DataFrame, key: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to written rows of (key, piece, length, ...).

    Lengths are at most `capacity`; a full one is a sequence of its own. The table of places is
    broadcast: it has a row for each stretch of one length in the plan, which the number of lengths
    and groups bounds, whatever the number of rows.
    """
    spark = pieces.sparkSession
    part = pieces.where(F.col("length") < capacity)
    counts = {r[0]: r[1] for r in part.groupBy("length").count().collect()}
    # Full pieces need no place; negative numbers never meet the others.
    own = pieces.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    table = spark.createDataFrame(places(plan(counts, capacity, groups)), PLACES)
    salts = max(64, math.ceil(sum(counts.values()) / RANK_ROWS))
    order = [F.col(c) for c in pieces.columns]
    salt = F.pmod(F.xxhash64(key, "piece"), F.lit(salts))
    found = ranked(part, ["length"], order, "_rank", salt)
    here = (F.col("length") == F.col("p_length")) & F.expr("_rank >= p_from and _rank < p_to")
    placed = found.join(F.broadcast(table), here).select(
        *pieces.columns,
        F.expr("p_first + (_rank - p_from) % p_many").alias("sequence_id"),
        F.expr("p_offset + cast((_rank - p_from) div p_many as long) * length").alias("offset"),
    )
    return placed.unionByName(own)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the documents' ids one after the other; a sequence is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = token_pieces(docs, ranks, pattern)
    narrow = written(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"
    )
    return packed(narrow, "doc_id")
