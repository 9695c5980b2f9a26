"""Language identification by prediction by partial matching.

Every language has a context tree over bytes, with contexts of up to three bytes: a byte that the
longest known context has not been followed by is coded by an escape and the next shorter context,
down to a uniform code. The statistics are counted over all training documents by Spark and then
frozen; a text's code length under each language is exact, over the whole text, and the language
with the shortest code wins.

No string is left out, however many there are. A byte's code length depends only on strings whose last
byte but one is the byte before it, so the trees are cut into parts by that byte, of about PART_STRINGS
strings each. One part at a time passes through the driver and is held by a task, which adds up what
the positions of its texts cost under each part.

Defined results: `und` with score 0 for a text that is null or has no letter, or if nothing could
be learned. Null texts and null languages are not learned from. Ties go to the smallest name.
Repeated rows count and are predicted each. An empty table gives an empty table. Very long texts are
scored whole, in stretches. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import written

ORDERS = 4  # of strings: a context of three bytes and the byte that follows
PART_STRINGS = 1 << 20  # wanted strings of four bytes in a part; a byte's strings stay together
CHUNK = 1 << 18  # bytes scored at once
UNKNOWN = "und"

_START = b"\xff\xff\xff"  # never part of UTF-8: stands before each text, so contexts stay inside it
_LETTER = re.compile(r"[^\W\d_]")


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The string of `order` bytes that ends at each position from the third on."""
    out = data[3:].astype(np.uint32)
    for back in range(1, order):
        out |= data[3 - back : -back].astype(np.uint32) << np.uint32(8 * back)
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, count = every[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(count, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, how often each string of four bytes occurs."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(_START + text.encode())
        for lang, texts in by_lang.items():
            grams = _grams(np.frombuffer(b"".join(texts), np.uint8), ORDERS)
            keys, counts = np.unique(grams[(grams & 0xFF) != 0xFF], return_counts=True)
            if len(keys):
                old = held.get(lang)
                held[lang] = _merged([keys, old[0]], [counts, old[1]]) if old else (keys, counts)
    for lang, (keys, counts) in held.items():
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys[part])), pa.array(keys[part].astype(np.int64)), pa.array(counts[part])],
                names=["lang", "gram", "n"],
            )


def counted(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all documents that have both."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    parts = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(
        _count, "lang string, gram long, n long"
    )
    return written(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


class _Index:
    """Positions of 32-bit keys by open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.slots = np.zeros(1 << bits, np.uint32)
        self.values = np.zeros(1 << bits, np.int32)  # 0: empty; a key's position counts from 1
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.values[at] == 0
            _, winner = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[winner]
            self.slots[at[placed]], self.values[at[placed]] = keys[left[placed]], left[placed] + 1
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + np.uint32(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = np.where(self.slots[at] == keys, self.values[at], 0)
        open_ = np.flatnonzero((out == 0) & (self.values[at] != 0))
        at = at[open_]
        while len(open_):
            at = (at + np.uint32(1)) & self.mask
            value, hit = self.values[at], self.slots[at] == keys[open_]
            out[open_] = np.where(hit, value, 0)
            more = ~hit & (value != 0)
            open_, at = open_[more], at[more]
        return out


class Model:
    """One part of the trees: code lengths in bits, a column per language.

    Row 0 of each order stands for a string, or a context, that is not known.
    """

    def __init__(self, langs: list[str], part: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        """`part` tells which bytes before a position are of this part; `grams` has for each order the
        sorted strings and their counts per language."""
        self.langs, self.part = langs, part
        self.index = {o: _Index(keys) for o, (keys, _) in grams.items()}
        self.context: dict[int, _Index] = {}
        self.cost: dict[int, np.ndarray] = {}
        self.escape: dict[int, np.ndarray] = {}
        for order in range(1, ORDERS + 1):
            keys, counts = grams[order]
            own = keys >> np.uint32(8) if order > 1 else np.zeros(len(keys), np.uint32)
            contexts, at = np.unique(own, return_inverse=True)
            total, kinds = (np.zeros((len(contexts) + 1, len(langs))) for _ in range(2))
            np.add.at(total, at + 1, counts)
            np.add.at(kinds, at + 1, counts > 0)
            seen = np.maximum(total, 1) + kinds
            self.context[order] = _Index(contexts)
            self.escape[order] = np.where(total > 0, np.log2(seen / np.maximum(kinds, 1)), 0)
            with np.errstate(divide="ignore"):
                known = np.log2(seen[at + 1] / counts)
            every = np.where(counts > 0, known, self._lower(order, keys))
            self.cost[order] = np.concatenate([np.zeros((1, len(langs))), every])

    def _lower(self, order: int, keys: np.ndarray) -> np.ndarray:
        """The code length of a string's last byte without its whole context: escape, then shorter."""
        if order == 1:
            return self.escape[1][self.context[1](np.zeros(len(keys), np.uint32))] + 8
        context = self.context[order](keys >> np.uint32(8))
        shorter = keys & np.uint32((1 << 8 * (order - 1)) - 1)
        found = self.index[order - 1](shorter)
        below = self.cost[order - 1][found]
        unknown = found == 0
        if unknown.any():
            below[unknown] = self._lower(order - 1, shorter[unknown])
        return self.escape[order][context] + below

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """What this part adds to the code length of each text under each language."""
        starts = np.cumsum([0] + [len(t) + 3 for t in texts])
        data = np.frombuffer(b"".join(_START + t for t in texts), np.uint8)
        out = np.zeros((len(texts), len(self.langs)))
        for at in range(3, len(data), CHUNK):
            piece = data[at - 3 : at + CHUNK]
            own = np.flatnonzero(self.part[piece[2:-1]] & (piece[3:] != 0xFF))
            keys = _grams(piece, ORDERS)[own]
            found = self.index[ORDERS](keys)
            cost = self.cost[ORDERS][found]
            unknown = np.flatnonzero(found == 0)
            cost[unknown] = self._lower(ORDERS, keys[unknown])
            first = np.searchsorted(starts, at, side="right") - 1
            last = np.searchsorted(starts, at + len(piece) - 3, side="left")
            # Where each text's positions begin among those of this part, for sums over stretches.
            cuts = np.searchsorted(own, np.maximum(starts[first:last] - at, 0))
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(cost, axis=0)])
            out[first:last] += sums[np.append(cuts[1:], len(own))] - sums[cuts]
        return out


def _model(langs: list[str], part: np.ndarray, code: np.ndarray, grams: np.ndarray, n: np.ndarray, single: np.ndarray) -> Model:
    """A part from its strings of four bytes; `single` counts each last byte over all parts."""
    orders = {}
    for order in range(2, ORDERS + 1):
        keys = grams & np.uint32((1 << 8 * order) - 1)
        inside = keys >> np.uint32(8 * (order - 1)) != 0xFF  # else the text's start cuts the context off
        unique, at = np.unique(keys[inside], return_inverse=True)
        counts = np.zeros((len(unique), len(langs)))
        np.add.at(counts, (at, code[inside]), n[inside])
        orders[order] = unique, counts
    last = np.flatnonzero(single.any(1)).astype(np.uint32)
    return Model(langs, part, {1: (last, single[last])} | orders)


def trained(docs: DataFrame, lang: str = "lang", text: str = "text", strings: int = PART_STRINGS) -> Iterator[Model]:
    """The parts of the model, one after another; none if nothing could be learned."""
    counts = counted(docs, lang, text)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return
    code = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int")
    before = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFF)).cast("int")
    coded = counts.select(code.alias("code"), "gram", "n", before.alias("before"))
    single = np.zeros((256, len(langs)))
    last = F.col("gram").bitwiseAND(F.lit(0xFF)).cast("int").alias("last")
    for r in coded.groupBy("code", last).agg(F.sum("n").alias("n")).collect():  # 256 bytes a language
        single[r["last"], r["code"]] = r["n"]
    many = np.zeros(256, np.int64)
    for r in coded.groupBy("before").count().collect():
        many[r["before"]] = r["count"]
    part_of = np.cumsum(many) // strings
    for number in np.unique(part_of):
        part = part_of == number
        rows = coded.where(F.col("before").isin(np.flatnonzero(part).tolist())).toPandas()
        yield _model(
            langs, part, rows["code"].to_numpy(), rows["gram"].to_numpy(np.int64).astype(np.uint32), rows["n"].to_numpy(), single
        )


def predictor(spark: SparkSession, parts: Iterator[Model]):
    """A column function from text to (lang_pred, score)."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs, sent = [], []
    for model in parts:
        langs = model.langs
        sent.append(spark.sparkContext.broadcast(model))

    def bits(texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(langs)))
        for part in sent:
            out += part.value.bits(texts)
            if len(sent) > 1:  # read again from the executor's disk, so that one is held at a time
                vars(part).pop("_value", None)
        return out

    @F.arrow_udf(kind)
    def predict(text: pa.Array) -> pa.Array:
        names, scores = [UNKNOWN] * len(text), np.zeros(len(text))
        plain = [t.as_py() for t in text]
        asked = [i for i, t in enumerate(plain) if langs and t and _LETTER.search(t)]
        if asked:
            cost = bits([plain[i].encode() for i in asked])
            best = cost.argmin(1)
            share = 1 / np.exp2(cost.min(1, keepdims=True) - cost).sum(1)
            for i, b, s in zip(asked, best.tolist(), share.tolist()):
                names[i], scores[i] = langs[b], s
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=kind.names)

    return predict


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identified(
    docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", strings: int = PART_STRINGS
) -> DataFrame:
    """(key, held_out, lang_pred, score), learned from the documents that are not held out."""
    predict = predictor(docs.sparkSession, trained(docs.where(~held_out(key)), lang, text, strings))
    return docs.select(key, held_out(key).alias("held_out"), predict(F.col(text)).alias("p")).select(
        key, "held_out", "p.lang_pred", "p.score"
    )
