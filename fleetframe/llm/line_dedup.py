"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines of one document, compared by 128 bits of hash. Windows that
occur more than once are found by counting all of them; every occurrence but the first, by
document id and position, is a repeat, and the lines that repeats cover are removed. Everything is
DataFrame operations: windows are counted with partial sums, so a window that a third of all
documents hold costs each task one row, and joined back, where a hot one can be split.

Lines are what newlines part, compared as they are; a window without a word is never a repeat. The
order of documents is by id, nulls last, and by text where ids are equal; repeated rows (equal id
and text) are one document and keep or lose the same lines. A null text stays null, a text of less
than three lines stays as it is. Columns of any name may stand beside the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import text_hashes, whole_row, written

SIZE = 3


def _identity(doc: DataFrame, key: str, text: str) -> DataFrame:
    h1, h2 = text_hashes(text)
    return doc.select(
        F.col(key).isNull().alias("late"), F.col(key).alias("id"), h1.alias("h1"), h2.alias("h2"),
        F.split(F.col(text), "\n", -1).alias("lines"),
    )


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(w1, w2, late, id, h1, h2, at): every window's hash, its document and its first line."""
    with_lines = _identity(docs, key, text).where(F.size("lines") >= SIZE)
    marked = with_lines.select(
        "late", "id", "h1", "h2",
        F.posexplode(
            F.expr(
                f"""transform(sequence(0, size(lines) - {SIZE}), i -> named_struct(
                    'w1', xxhash64(1, lines[i], lines[i + 1], lines[i + 2]),
                    'w2', xxhash64(lines[i], lines[i + 1], lines[i + 2], 2),
                    'blank', btrim(concat(lines[i], lines[i + 1], lines[i + 2]), ' \\t\\n\\u000b\\f\\r') = ''))"""
            )
        ).alias("at", "w"),
    ).where("not w.blank")
    return marked.select("w.w1", "w.w2", "late", "id", "h1", "h2", "at")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, h1, h2, starts): of each document the sorted first lines of its repeated windows."""
    every = windows(docs, key, text)
    place = F.struct("late", "id", "h1", "h2", "at")
    first = every.groupBy("w1", "w2").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")
    )
    again = first.where("n > 1").select(F.col("w1").alias("f1"), F.col("w2").alias("f2"), "first")
    hits = every.join(again, (F.col("w1") == F.col("f1")) & (F.col("w2") == F.col("f2"))).where(
        place != F.col("first")
    )
    return hits.groupBy("id", "h1", "h2").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def kept_lines() -> Column:
    """The lines `l_` outside what windows at `s_` cover: where runs of windows end and begin, and
    the end of the text, bound the gaps, each found in one pass."""
    pairs = "transform(s_, (x, i) -> struct(x, i))"
    ends = f"filter({pairs}, p -> p.i = size(s_) - 1 or s_[p.i + 1] - p.x > {SIZE})"
    begins = f"filter({pairs}, p -> p.i = 0 or p.x - s_[p.i - 1] > {SIZE})"
    return F.expr(
        f"""flatten(zip_with(
            concat(array(0), transform({ends}, p -> p.x + {SIZE})),
            concat(transform({begins}, p -> p.x), array(size(l_))),
            (a, b) -> slice(l_, a + 1, b - a)))"""
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines that later occurrences of a window cover, in `text`."""
    narrow = docs.select(F.col(key).alias(key), F.col(text).alias(text))
    marks = written(repeats(narrow, key, text), "repeats")
    h1, h2 = text_hashes(text)
    held = docs.select(whole_row(docs).alias("d_"), h1.alias("t1"), h2.alias("t2"))
    # The texts move at every size, rather than only once the marks are too many to broadcast.
    joined = held.join(
        marks.hint("merge"),
        F.col("d_")[key].eqNullSafe(F.col("id")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")),
        "left",
    )
    parted = joined.select("d_", F.col("starts").alias("s_"), F.split(F.col("d_")[text], "\n", -1).alias("l_"))
    cleaned = F.when(F.col("s_").isNull(), F.col("d_")[text]).otherwise(
        F.array_join(kept_lines(), "\n")
    )
    return parted.select(
        *[(cleaned if c == text else F.col("d_")[c]).alias(c) for c in docs.columns]
    )
