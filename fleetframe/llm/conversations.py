"""Conversation structure repair: cheapest edits by a bidirectional search of the edit lattice.

A node of the lattice is a number of rows passed and what the kept roles end in; an edit is an edge.
From the start a forward heap and from the accepted ends a reverse heap settle nodes by cost until
they have met and no cheaper or equal crossing is left; every equal-cost crossing gives an audit, the
forward part and the reverse part joined, and the least one wins. Its letters fix the repair: in each
state of `(s?(ua)+)?` only one role can come next.

Rows are numbered within their conversation without one task per conversation and packed into
segments of a bounded number of rows. The lattice of a segment is searched from each state to each
state; neighbouring segments are then folded, many at a time, until a conversation has one. So a
conversation that holds a third of all rows is searched by many tasks; only its audit, its hash (both
are one value) and the summaries of its segments come together. All rows count, whatever the size.

Defined results: a null role or text is one space; a null conversation is a conversation of its own;
null turns come first; rows of equal turn are ordered by role and then text, in code-point order, and
rows equal in all of that are interchangeable. A role that begins with another letter than s, u, a, or
is empty, can only be reroled or deleted. An empty table gives an empty table. Very long texts only
matter for the row that holds them. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import written
from fleetframe.operators.ordered import index_within

SEGMENT = 256  # rows of a segment
FOLD = 64  # segments folded at once
ROLES = {"u": "user", "a": "assistant"}
# What the kept roles end in: nothing yet, a system row, a user row, an assistant row.
STATES = "0sua"
KEPT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
ENDS = "0a"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

_PATHS = T.ArrayType(
    T.StructType([
        T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
        T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
    ])
)
_SPACES = " \t\n\x0b\x0c\r"


def _edges(code: str, i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
    """(rows passed, state, cost, letter) behind a node. `code` has a letter per row: the role's first
    letter, a capital where the text is truncated, `-` where the row has to go."""
    if i < len(code):
        row = code[i]
        yield i + 1, state, DELETE, "D"
        if row != "-":
            extra = TRUNCATED if row.isupper() else 0
            kept = KEPT.get((state, row.lower()))
            if kept:
                yield i + 1, kept, extra, "K"
            yield i + 1, NEXT[state], REROLE + extra, "R"
    yield i, NEXT[state], INSERT, "I"


def _back_edges(code: str, i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
    """The edges that lead to a node, each with the node it comes from."""
    for before in STATES:
        for at in (i - 1, i):
            if at >= 0:
                for j, after, cost, letter in _edges(code, at, before):
                    if (j, after) == (i, state):
                        yield at, before, cost, letter


class _Side:
    """One direction of the search: settled nodes with their cost and least audit."""

    def __init__(self, code: str, starts: list[tuple[int, str]], forward: bool):
        self.code, self.forward = code, forward
        self.label = {node: (0, "") for node in starts}
        self.settled: dict[tuple[int, str], tuple[int, str]] = {}
        self.heap = [self._entry(0, node) for node in starts]
        heapq.heapify(self.heap)

    def _entry(self, cost: int, node: tuple[int, str]) -> tuple[int, int, tuple[int, str]]:
        # Free edges pass a row, so equal costs are settled in the order of the rows.
        return cost, node[0] if self.forward else -node[0], node

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, str]:
        node = heapq.heappop(self.heap)[2]
        cost, audit = self.settled[node] = self.label[node]
        edges = _edges if self.forward else _back_edges
        for i, state, more, letter in edges(self.code, *node):
            there = (cost + more, audit + letter if self.forward else letter + audit)
            old = self.label.get((i, state))
            if (i, state) not in self.settled and (old is None or there < old):
                self.label[i, state] = there
                if old is None or there[0] < old[0]:
                    heapq.heappush(self.heap, self._entry(there[0], (i, state)))
        return node


def search(code: str, start: str, ends: str) -> tuple[int, str] | None:
    """The least cost from a state before the rows to one of the end states, with its least audit."""
    ahead = _Side(code, [(0, start)], forward=True)
    back = _Side(code, [(len(code), end) for end in ends], forward=False)
    best = float("inf")
    while True:
        tops = ahead.top(), back.top()
        if min(tops) == float("inf") or sum(tops) > best:
            break
        side, other = (ahead, back) if tops[0] <= tops[1] else (back, ahead)
        node = side.settle()
        if node in other.label:
            best = min(best, side.settled[node][0] + other.label[node][0])
    # The outer nodes are settled from the beginning: nothing comes before or behind them for free.
    left = {(0, start): (0, "")} | ahead.settled
    right = {(len(code), end): (0, "") for end in ends} | back.settled
    audits = []
    for node, (cost, audit) in left.items():
        if node in right and cost + right[node][0] == best:
            audits.append(audit + right[node][1])
        for i, state, more, letter in _edges(code, *node):
            rest = right.get((i, state))
            if rest and cost + more + rest[0] == best:
                audits.append(audit + letter + rest[1])
    return (best, min(audits)) if audits else None

@lru_cache(maxsize=1 << 14)
def _ends_of(code: str) -> dict:
    """The search of a whole conversation, in the form of a segment's paths."""
    cost, audit = search(code, "0", ENDS)
    return {"start": "0", "end": "", "cost": cost, "audit": audit}


@lru_cache(maxsize=1 << 10)
def _paths_of(code: str) -> list[dict]:
    """The search of a segment from each state to each state."""
    out = []
    for start in STATES:
        for end in STATES:
            if found := search(code, start, end):
                out.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
    return out


@F.arrow_udf(_PATHS)
def segment_paths(code: pa.Array, alone: pa.Array) -> pa.Array:
    both = zip(code.to_pylist(), alone.to_pylist())
    found = [[_ends_of(c)] if only else _paths_of(c) for c, only in both]
    return pa.array(found, _arrow(_PATHS))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _joined(left: list[dict], right: list[dict]) -> list[dict]:
    """The least path through two stretches, for each pair of outer states."""
    behind: dict[str, list[dict]] = {}
    for path in right:
        behind.setdefault(path["start"], []).append(path)
    best: dict[tuple[str, str], tuple[int, str]] = {}
    for a in left:
        for b in behind.get(a["end"], ()):
            ends = a["start"], b["end"]
            there = a["cost"] + b["cost"], a["audit"] + b["audit"]
            if ends not in best or there < best[ends]:
                best[ends] = there
    return [{"start": s, "end": e, "cost": c, "audit": x} for (s, e), (c, x) in best.items()]


@F.arrow_udf(_PATHS)
def folded(parts: pa.Array) -> pa.Array:
    out = []
    for stretches in parts.to_pylist():
        now = stretches[0]["paths"]
        for part in stretches[1:]:
            now = _joined(now, part["paths"])
        out.append(now)
    return pa.array(out, _arrow(_PATHS))


def damaged(rows: DataFrame) -> DataFrame:
    """Damage by the checksum of `conv_id:turn`: dropped, emptied, cut, repeated or wrongly named."""
    def told(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).cast("int")
    text = F.when(F.col("_kind") == 1, "").when(
        F.col("_kind") == 2, F.regexp_replace(told("text"), "[.!?]", "")
    ).otherwise(told("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(told("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    plain = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where("_kind <> 0")
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """(c, seg, rows): the rows of each conversation in their order, a bounded number in a row."""
    placed = index_within(rows, ["c"], ["t", "role", "text"], "pos")
    row = F.struct("pos", "t", "role", "text")
    parts = placed.groupBy("c", F.floor(F.col("pos") / segment).alias("seg")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    return written(parts, "segments")


def _summed(parts: DataFrame) -> DataFrame:
    """Per conversation: gaps and illegal pairs of roles, from each segment and its borders."""
    turns = F.filter("rows.t", lambda t: t.isNotNull())
    initials = F.transform("rows.role", lambda r: F.substring(r, 1, 1))
    told = parts.select("c", "seg", turns.alias("turns"), initials.alias("in"))
    pairs = F.zip_with(
        F.slice("in", 1, F.size("in") - 1), F.slice("in", 2, F.size("in") - 1), lambda x, y: F.concat(x, y)
    )

    def wrong(pair):
        return ~pair.isin("su", "ua", "au")

    own = told.select(
        "c", "seg", F.try_element_at("turns", F.lit(1)).alias("low"), F.try_element_at("turns", F.lit(-1)).alias("high"),
        F.size(F.array_distinct("turns")).alias("kinds"), F.element_at("in", 1).alias("first"),
        F.element_at("in", -1).alias("last"), F.size(F.filter(pairs, wrong)).alias("illegal"),
    )
    before = Window.partitionBy("c").orderBy("seg")
    seen = F.last("high", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    border = own.withColumn("seen", seen).withColumn("met", F.concat(F.lag("last").over(before), F.col("first")))
    split = F.when(F.col("seen") == F.col("low"), 1).otherwise(0)
    return border.groupBy("c").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("kinds") - split), F.lit(0)).alias("gaps"),
        F.sum(F.col("illegal") + F.when(wrong(F.col("met")), 1).otherwise(0)).alias("illegal"),
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the right keys go."""
    other = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, match, how).drop(*[f"_{k}" for k in keys])


def _codes(parts: DataFrame, segment: int) -> DataFrame:
    """(c, seg, code, blank, duplicate, truncated) of every segment."""
    each = parts.select("c", "seg", F.explode("rows").alias("r"))
    whole = F.sha2(F.concat(F.char_length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")), 256)
    firsts = each.groupBy("c", whole.alias("whole")).agg(F.min("r.pos").alias("pos"))
    firsts = firsts.groupBy("c", F.floor(F.col("pos") / segment).alias("seg")).agg(
        F.collect_list(F.col("pos") % segment).alias("firsts")
    )
    faults = F.transform(
        "rows",
        lambda r: F.struct(
            F.substring(r.role, 1, 1).alias("initial"), (r.pos % segment).alias("place"),
            F.substring(F.rtrim(r.text, F.lit(_SPACES)), -1, 1).alias("last"),
        ),
    )
    told = _same(parts.select("c", "seg", faults.alias("rows")), firsts, ["c", "seg"])

    def letter(r):
        open_ = ~r["last"].isin(".", "!", "?")
        known = F.when(r["initial"].isin("s", "u", "a"), r["initial"]).otherwise("x")
        return (
            F.when(r["last"] == "", "b")
            .when(~F.coalesce(F.array_contains("firsts", r["place"]), F.lit(False)), "d")
            .when(open_, F.upper(known)).otherwise(known)
        )

    code = F.array_join(F.transform("rows", letter), "")
    plain = told.select("c", "seg", code.alias("code"))

    def many(letters):
        return F.char_length(F.regexp_replace("code", f"[^{letters}]", "")).cast("long")

    return plain.select(
        "c", "seg", F.translate("code", "bd", "--").alias("code"),
        many("b").alias("blank"), many("d").alias("duplicate"), many("SUAX").alias("truncated"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation, from its segments in order and the audit with the first."""
    schema, now, out = None, None, []
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("c"), pa.field("sha", pa.string())])
        for c, seg, rows, audit in zip(*(batch.column(n).to_pylist() for n in ("c", "seg", "rows", "audit"))):
            if seg == 0:
                if now:
                    out.append((now[0], now[1].finish()))
                now = c, _Repair(audit)
            now[1].take(rows)
            if len(out) >= 10_000:
                yield _hash_batch(out, schema)
                out = []
    if now:
        out.append((now[0], now[1].finish()))
    if out:
        yield _hash_batch(out, schema)


def _hash_batch(out: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


class _Repair:
    """Applies the letters of an audit to the rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, "0"
        self.digest, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str, state: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, state

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = NEXT[self.state]
            self._put(ROLES[role], "", role)
            self.at += 1

    def take(self, rows: list[dict]) -> None:
        for row in rows:
            self._insert()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self._put(row["role"], row["text"], KEPT[self.state, row["role"][0]])
            elif letter == "R":
                role = NEXT[self.state]
                self._put(ROLES[role], row["text"], role)

    def finish(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment: int = SEGMENT, fold: int = FOLD,
) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair's cost and audit, and what it leaves."""
    def filled(c):
        return F.coalesce(F.col(f"`{c}`"), F.lit(" "))

    plain = rows.select(
        F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), filled(role).alias("role"), filled(text).alias("text")
    )
    parts = _segments(plain, segment)
    codes = written(_codes(parts, segment), "codes")
    alone = F.max("seg").over(Window.partitionBy("c")) == 0
    most = codes.agg(F.max("seg")).first()[0] or 0
    paths = codes.withColumn("alone", alone if most else F.lit(True)).select(
        "c", "seg", segment_paths("code", "alone").alias("paths")
    )
    while most:
        paths = written(paths, "paths")
        many = paths.groupBy("c", F.floor(F.col("seg") / fold).alias("seg")).agg(
            F.sort_array(F.collect_list(F.struct("seg", "paths"))).alias("parts")
        )
        paths = many.select("c", "seg", folded("parts").alias("paths"))
        most //= fold
    ended = F.filter("paths", lambda p: (p.start == "0") & p.end.isin("", *ENDS))
    least = F.array_min(F.transform(ended, lambda p: F.struct(p.cost.alias("cost"), p.audit.alias("audit"))))
    audits = written(paths.select("c", least.alias("p")).select("c", "p.cost", "p.audit"), "audits")
    first = audits.select("c", F.lit(0).cast("long").alias("seg"), "audit")
    told = _same(parts.select("c", "seg", F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("rows")), first, ["c", "seg"])
    kind = plain.schema["c"].dataType.simpleString()
    hashes = told.repartition("c").sortWithinPartitions("c", "seg").mapInArrow(_hashed, f"c {kind}, sha string")
    faults = codes.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    out = _same(_same(_same(_summed(parts), faults, ["c"]), audits, ["c"]), hashes, ["c"])
    return out.select(
        F.col("c").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha").alias("repaired_sha256"),
    )
