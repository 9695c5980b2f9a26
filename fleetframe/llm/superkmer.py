"""Substring dedup over windows of 13 words by super-k-mer partitioning.

A window's minimiser is the least hash of the four-word strings in it. Consecutive windows that
share their minimiser travel together, as one packed string (a super-k-mer), to the bucket of the
minimiser; so equal windows meet in one bucket, and words are sent about three times instead of
thirteen. A batch of documents sends each distinct string once, with the least and the greatest
document id that hold it, however many copies it has. A bucket leaves out strings whose minimiser
no other string has, cuts the others into windows, sorts them, and answers the batches: for each
window the least document that it starts in. A batch then knows which words of each of its
documents some earlier document covers. Batches and buckets have fixed sizes, so tasks do not grow
with the corpus; sorting compares whole windows, so the result is exact.

Defined results: a null text has no words. A null id is larger than any other. Rows that repeat an
id do not count as earlier than one another. Every input row gives one row. Texts are read whole:
very long ones are cut into overlapping stretches of words, which lose no window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
PART = 4  # words of a minimiser
LONGEST = 64  # windows of a super-k-mer
BATCH_BYTES = 6 << 20  # of text in a batch
BUCKET_BYTES = 12 << 20  # of packed strings in a bucket
GROWTH = 3.2  # packed bytes for each byte of text
CHUNK_WORDS = 1 << 17  # hashed at once
HASHED = 8_000  # strings hashed at once
SLAB = 50_000  # strings that are cut into windows at once
LEVEL = 7  # of compression of what travels
NEVER = np.iinfo(np.int64).max

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Runs:
    """The super-k-mers of a chunk of documents."""

    strings: list[bytes]
    minimiser: np.ndarray
    doc: np.ndarray  # position of the document in the batch
    at: np.ndarray  # the first window's first word in the document


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of every span: differences of one running sum, turned to their place."""
    power = np.cumprod(np.full(len(data), _STEP))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power)])
    back = np.cumprod(np.full(len(data), _BACK))
    return _mixed((sums[ends] - sums[starts]) * back[starts])


def _chunks(texts: list[bytes]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Stretches (document, first word, words) of at most about CHUNK_WORDS together."""
    held, size = [], 0
    for i, text in enumerate(texts):
        words = text.split()  # bytes split at the six ASCII spaces only
        for at in range(0, max(0, len(words) - WINDOW + 1), CHUNK_WORDS):
            part = words[at : at + CHUNK_WORDS + WINDOW - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= CHUNK_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def super_kmers(texts: list[bytes]) -> Iterator[Runs]:
    for chunk in _chunks(texts):
        buffer = b" ".join(w for _, _, words in chunk for w in words)
        data = np.frombuffer(buffer, np.uint8).astype(np.uint64)
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(data)]])
        parts = _hash_spans(data, starts[: len(starts) - PART + 1], ends[PART - 1 :])
        wide, least = 1, parts  # the least of 1, 2, 4, 8 strings, then of as many as a window has
        many = WINDOW - PART + 1
        while 2 * wide <= many:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if many > wide:
            least = np.minimum(least[: len(least) - (many - wide)], least[many - wide :])
        lengths = np.array([len(words) for _, _, words in chunk])
        first = np.concatenate([[0], np.cumsum(lengths)])
        stretch = np.repeat(np.arange(len(chunk)), lengths)[: len(least)]
        inside = np.arange(len(least)) + WINDOW <= first[stretch + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (stretch[1:] != stretch[:-1])
        index = np.arange(len(least))
        begun = np.maximum.accumulate(np.where(new, index, 0))
        new |= (index - begun) % LONGEST == 0
        # Windows across two documents are not inside; they come last in a stretch.
        a = np.flatnonzero(new & inside)
        stop = np.minimum(np.append(np.flatnonzero(new)[1:], len(least)), len(least))
        stop = stop[np.searchsorted(np.flatnonzero(new), a)]
        last = np.minimum(stop, first[stretch[a] + 1] - WINDOW + 1) - 1
        lo, hi = starts[a].tolist(), ends[last + WINDOW - 1].tolist()
        docs = np.array([i for i, _, _ in chunk])
        base = np.array([at for _, at, _ in chunk])
        yield Runs(
            [buffer[x:y] for x, y in zip(lo, hi)], least[a], docs[stretch[a]],
            a - first[stretch[a]] + base[stretch[a]],
        )


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NEVER).to_numpy().astype(np.int64)


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t.as_py().encode() if t.is_valid else b"" for t in column]


def _packer(buckets: int):
    def pack(rows: pa.Table) -> pa.Table:
        import zstandard

        rows = rows.sort_by("id")
        ids, texts = _ids(rows["id"]), _texts(rows["text"])
        known: dict[bytes, int] = {}
        minimisers, low, high = [], [], []
        for runs in super_kmers(texts):
            holder = ids[runs.doc].tolist()
            for string, least, doc in zip(runs.strings, runs.minimiser.tolist(), holder):
                at = known.setdefault(string, len(low))
                if at == len(low):
                    minimisers.append(least)
                    low.append(doc)
                    high.append(doc)
                else:
                    high[at] = doc  # documents come in the order of their ids
        strings = list(known)
        least, low, high = np.array(minimisers, np.uint64), np.array(low, np.int64), np.array(high, np.int64)
        bucket = (least >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1
        press = zstandard.ZstdCompressor(level=LEVEL)
        out_bucket, out = [], []
        for part in np.split(order, cuts) if len(order) else []:
            body = [
                np.array([len(part)], np.int64).tobytes(),
                np.diff(low[part], prepend=0).tobytes(), (high[part] - low[part]).tobytes(),
                b"\n".join([strings[i] for i in part]),
            ]
            out_bucket.append(int(bucket[part[0]]))
            out.append(press.compress(b"".join(body)))
        batch = [rows["batch"][0].as_py()] * len(out)
        return pa.table(
            {"bucket": pa.array(out_bucket, pa.int64()), "sender": pa.array(batch, pa.int64()), "packed": pa.array(out, pa.binary())}
        )

    return pack


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    low = np.cumsum(np.frombuffer(body, np.int64, n, 8))
    high = low + np.frombuffer(body, np.int64, n, 8 + 8 * n)
    return low, high, body[8 + 16 * n :].split(b"\n")


def _word_bounds(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of strings joined by newlines, and each string's first word."""
    data = np.frombuffer(buffer, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    return starts, ends, np.concatenate([[0], np.flatnonzero(data[gaps] == 10) + 1])


def minimisers(strings: list[bytes]) -> np.ndarray:
    """The minimiser of each string's windows, found again from its first window."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(strings), HASHED):
        buffer = b"\n".join(strings[at : at + HASHED])
        starts, ends, first = _word_bounds(buffer)
        data = np.frombuffer(buffer, np.uint8).astype(np.uint64)
        parts = _hash_spans(data, starts[: len(starts) - PART + 1], ends[PART - 1 :])
        window = np.stack([first, first + WINDOW - PART + 1], 1).ravel()
        out.append(np.minimum.reduceat(np.append(parts, np.uint64(0)), window)[::2])
    return np.concatenate(out)


def window_firsts(strings: list[bytes], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string its least document, and where each string's windows begin."""
    buffer = b"\n".join(strings)
    starts, ends, first = _word_bounds(buffer)
    words = np.diff(np.append(first, len(starts)))
    count = words - WINDOW + 1
    begin = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(np.cumsum(words) - words - begin[:-1], count) + np.arange(begin[-1])
    spans = zip(starts[word].tolist(), ends[word + WINDOW - 1].tolist())
    windows = pa.array([buffer[a:b] for a, b in spans], pa.binary())
    same = windows.dictionary_encode().indices.to_numpy()
    # Sorted, equal windows lie side by side; the least document of each run is theirs.
    order = np.argsort(same, kind="stable")
    runs = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    least = np.minimum.reduceat(np.repeat(low, count)[order], runs)
    firsts = np.empty(len(same), np.int64)
    firsts[order] = np.repeat(least, np.diff(np.append(runs, len(order))))
    return firsts, begin


def _answer(rows: pa.Table) -> pa.Table:
    """To each sender the strings with a window that an earlier document holds, packed."""
    import zstandard

    lows, highs, senders, strings = [], [], [], []
    for sender, packed in zip(rows["sender"].to_pylist(), rows["packed"]):
        low, high, body = _unpacked(packed.as_py())
        lows.append(low)
        highs.append(high)
        senders.append(np.full(len(low), sender))
        strings += body
    low, high, sender = map(np.concatenate, (lows, highs, senders))
    tag = minimisers(strings)
    order = np.argsort(tag, kind="stable")
    sorted_ = tag[order]
    single = np.ones(len(order), bool)
    same = sorted_[1:] == sorted_[:-1]
    single[1:] &= ~same
    single[:-1] &= ~same
    order = order[~(single & (low[order] == high[order]))]
    hits: dict[int, tuple[list[bytes], list[np.ndarray]]] = {}
    at = 0
    while at < len(order):
        end = min(len(order), at + SLAB)
        while end < len(order) and tag[order[end]] == tag[order[end - 1]]:
            end += 1  # a minimiser's strings stay together
        part, at = order[at:end], end
        firsts, begin = window_firsts([strings[i] for i in part], low[part])
        useful = firsts < np.repeat(high[part], np.diff(begin))
        for i in np.flatnonzero(np.logical_or.reduceat(useful, begin[:-1])).tolist():
            told = hits.setdefault(int(sender[part[i]]), ([], []))
            told[0].append(strings[part[i]])
            told[1].append(firsts[begin[i] : begin[i + 1]])
    press = zstandard.ZstdCompressor(level=LEVEL)
    packed = [press.compress(_told(*told)) for told in hits.values()]
    return pa.table({"receiver": pa.array(list(hits), pa.int64()), "answer": pa.array(packed, pa.binary())})


def _told(strings: list[bytes], firsts: list[np.ndarray]) -> bytes:
    """The strings with the least documents of their windows, of which a string has LONGEST at most."""
    counts = np.array(list(map(len, firsts)), np.uint8)
    head = np.array([len(strings)], np.int64).tobytes()
    return b"".join([head, counts.tobytes(), np.concatenate(firsts).tobytes(), b"\n".join(strings)])


def _heard(answers: pa.Table) -> dict[bytes, list[int]]:
    import zstandard

    press, known = zstandard.ZstdDecompressor(), {}
    for answer in answers["answer"]:
        body = press.decompress(answer.as_py())
        n = int(np.frombuffer(body, np.int64, 1)[0])
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(body, np.uint8, n, 8), dtype=np.int64)])
        firsts = np.frombuffer(body, np.int64, cuts[-1], 8 + n).tolist()
        strings = body[8 + n + 8 * cuts[-1] :].split(b"\n")
        known.update((s, firsts[a:b]) for s, a, b in zip(strings, cuts.tolist(), cuts[1:].tolist()))
    return known


def _apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
    ids, texts = _ids(rows["id"]), _texts(rows["text"])
    known = _heard(answers)
    hits: dict[int, list[int]] = {}
    for runs in super_kmers(texts) if known else ():
        for string, doc, at in zip(runs.strings, runs.doc.tolist(), runs.at.tolist()):
            firsts = known.get(string)
            if firsts:
                own = ids[doc]
                hits.setdefault(doc, []).extend(at + k for k, first in enumerate(firsts) if first < own)
    n_words, n_removed, kept = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        n_words.append(len(words))
        removed = 0
        if hits.get(i):
            change = np.zeros(len(words) + WINDOW, np.int64)
            np.add.at(change, hits[i], 1)
            np.add.at(change, np.array(hits[i]) + WINDOW, -1)
            covered = np.cumsum(change)[: len(words)] > 0
            removed = int(covered.sum())
            words = [w for w, gone in zip(words, covered.tolist()) if not gone]
        n_removed.append(removed)
        kept.append(b" ".join(words).decode())
    return pa.table({
        "id": rows["id"], "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()),
    })


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(key, n_words, n_removed, kept): the words that no window of an earlier document covers."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, math.ceil(size / batch_bytes))
    buckets = max(1, math.ceil(size * GROWTH / bucket_bytes))
    # The row's number keeps repeated rows apart; a file's rows have the same numbers in every run.
    spread = F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id())
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), spread.alias("spread")).select(
        "id", "text", F.pmod("spread", F.lit(batches)).alias("batch")
    )
    packed = rows.groupBy("batch").applyInArrow(_packer(buckets), "bucket long, sender long, packed binary")
    answers = packed.groupBy("bucket").applyInArrow(
        _answer, "receiver long, answer binary"
    )
    kind = docs.schema[key].dataType.simpleString()
    done = rows.groupBy("batch").cogroup(answers.groupBy("receiver")).applyInArrow(
        _apply, f"id {kind}, n_words long, n_removed long, kept string"
    )
    return done.withColumnRenamed("id", key)
