"""Cutting ranges of entries out of several files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.ordered import index_within, sum_before

MAX_LEVEL = 20


def cut_entries(
    entries: DataFrame, chunks: DataFrame, file: str = "file", entry: str = "entry_no"
) -> DataFrame:
    """Entries with first <= entry_no < last, for every chunk row (chunk, file, first, last).

    Ranges may overlap, nest and be of any widths. Each is laid out in cells as wide as the next
    power of two of its own width, of which it touches two at most (more only beyond the widest
    cell), and an entry is in one cell of each width in use. An equality join on file, width and
    cell pairs the two, so a wide range never makes narrow ones meet more entries. A cell holds at
    most 2**MAX_LEVEL entries of a file, so a large file spreads over many join keys.
    """
    ranges = chunks.filter(F.col("last") > F.col("first"))
    width = F.col("last") - F.col("first")
    level = F.least(F.lit(MAX_LEVEL), F.length(F.bin(width - 1)) * (width > 1).cast("int"))
    levelled = ranges.withColumn("_level", level)
    used = sorted(r[0] for r in levelled.select("_level").distinct().collect())  # MAX_LEVEL + 1 at most
    if not used:
        used = [0]

    def cell(place: str) -> str:
        return f"shiftright(cast({place} as bigint), _level)"

    laid = levelled.withColumn(
        "_cell", F.explode(F.sequence(F.expr(cell("first")), F.expr(cell("last - 1"))))
    )
    placed = entries.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in used]))).withColumn(
        "_cell", F.expr(cell(entry))
    )
    joined = placed.join(laid.withColumnRenamed("file", file), [file, "_level", "_cell"])
    inside = (F.col(entry) >= F.col("first")) & (F.col(entry) < F.col("last"))
    return joined.filter(inside).select(*entries.columns, "chunk", "first", "last")


def number_entries(
    rows: DataFrame, order: str | list[str], file: str = "file", out: str = "entry_no"
) -> DataFrame:
    """Number the entries of each file from 0."""
    return index_within(rows, [file], order, out)


def entry_chunks(
    files: DataFrame,
    n_chunks: int | None = None,
    chunk_size: int | None = None,
    file: str = "file",
    n_entries: str = "n_entries",
    order: str = "file_no",
) -> DataFrame:
    """Chunk rows (chunk, file, first, last) of balanced chunks over files laid end to end.

    Works on the file table alone: chunk bounds are the whole numbers at or above k*f, and each
    file is cut at the bounds inside it.
    """
    laid = sum_before(files, [], order, n_entries, "_start")
    total = files.agg(F.coalesce(F.sum(n_entries), F.lit(0)).alias("n")).first()["n"]
    if (n_chunks is None) == (chunk_size is None):
        raise ValueError("give either n_chunks or chunk_size")
    if chunk_size is not None:
        n_chunks = -(-total // chunk_size)
    f = float(total) / max(n_chunks, 1)
    low, high = F.col("_start"), F.col("_start") + F.col(n_entries)
    chunk_at = F.floor(low.cast("double") / f) if f else F.lit(0)
    chunk_to = F.floor((high - 1).cast("double") / f) if f else F.lit(0)
    # One chunk more on either side covers the rounding; empty cuts are dropped.
    numbers = F.sequence(F.greatest(chunk_at - 1, F.lit(0)), F.least(chunk_to + 1, F.lit(n_chunks - 1)))
    cut = laid.filter(F.col(n_entries) > 0).withColumn("chunk", F.explode(numbers))
    first = F.greatest(low, F.ceil(F.col("chunk") * F.lit(f)))
    last = F.least(high, F.ceil((F.col("chunk") + 1) * F.lit(f)))
    return (
        cut.withColumns({"first": first - low, "last": last - low})
        .filter(F.col("last") > F.col("first"))
        .select("chunk", file, "first", "last")
    )
