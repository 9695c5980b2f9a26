"""Ordered operators (prefix sums, numbering, look-back, look-ahead) that survive hot keys.

A window partitioned by a key sends all rows of the key to one task. So the sizes of the keys are
measured first. If none is larger than HOT_ROWS, the plain window is the plan. Otherwise the order
is cut into ranges of at most RANGE_ROWS rows, so that a window group is one range of one key:
however large the key, no group exceeds a range. What a range needs to know about the earlier (or
later) ranges of its key is one summary row, found by a window over the summaries, of which a key
has at most as many as there are ranges. The summary enters the range as one extra row before (or
after) its data, so the data is joined with nothing. Without a key the table is always cut. Both
plans give the same rows, columns and types.

`order` must be unique inside a key, by the first column or with the tie-breakers that follow it;
any type that sorts will do, nulls come first. Spark's range shuffle cuts on the whole order, ties
included, and the sorted rows are written with their range, so that every later use and repeated
task sees the same cut. The setting `fleetframe.ranges` makes every call cut its table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetframe.session import shuffle_partitions, work_dir

_RANGE, _VALUE, _EDGE, _ALL, _OUT = "_ff_range", "_ff_value", "_ff_edge", "_ff_all", "_ff_out"
FORCED = "fleetframe.ranges"
HOT_ROWS = 1_000_000  # the most rows of a key that one task takes
RANGE_ROWS = 1_000_000  # the most rows of a range
LEAST_ROWS = 10_000  # of a part of a small table, so that it is cut at all
MAX_PARTS = 4096  # of the range shuffle; larger parts fall into several ranges
_PLACE_BITS = 33  # of a row's number in its part


def _cut(df: DataFrame, order: list[str], count: int, parts: int | None) -> DataFrame:
    """The rows, written in their order, with the number of their range."""
    spark = df.sparkSession
    even = min(shuffle_partitions(spark), math.ceil(count / LEAST_ROWS))
    wanted = parts or min(MAX_PARTS, max(2, even, math.ceil(count / RANGE_ROWS)))
    sorted_ = df.repartitionByRange(wanted, *order).sortWithinPartitions(*order)
    numbered = sorted_.withColumn(_RANGE, F.monotonically_increasing_id())
    path = work_dir(spark, "ranges")
    numbered.write.parquet(path)
    part = F.shiftright(_RANGE, _PLACE_BITS)
    inside = F.col(_RANGE).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return spark.read.schema(numbered.schema).parquet(path).withColumn(
        _RANGE, part * F.lit(1 << 20) + F.floor(inside / RANGE_ROWS)
    )


class _Ranges:
    """A table with its keys and order, cut into order ranges where `split` says so.

    A given number of ranges is used in any case.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: str | list[str], ranges: int | None):
        self.order = [order] if isinstance(order, str) else list(order)
        self.columns = df.columns
        # Without a key the whole table is one key.
        self.keys = list(keys) or [_ALL]
        self.rows = df
        forced = df.sparkSession.conf.get(FORCED, None)
        ranges = ranges or (int(forced) if forced else None)
        sizes = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
        if ranges is None or not keys:
            row = sizes.agg(F.sum("count"), F.max("count")).first()
            self.count, most = row[0] or 0, row[1] or 0
        else:
            self.count, most = df.count(), 0
        self.split = not keys or ranges is not None or most > HOT_ROWS
        if self.split:
            self.rows = _cut(df, self.order, self.count, ranges)
            if not keys:
                self.rows = self.rows.withColumn(_ALL, F.lit(0))

    def whole(self) -> Window:
        """The window over a whole key, where no key is too large for it."""
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def summaries(self, value: Column) -> DataFrame:
        return self.rows.groupBy(*self.keys, _RANGE).agg(value.alias(_VALUE))

    def over_ranges(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(_RANGE)

    def with_edges(self, value: Column, edges: DataFrame) -> DataFrame:
        """Data rows carrying `value` together with one edge row per range."""
        rows = self.rows.withColumn(_VALUE, value).withColumn(_EDGE, F.lit(False))
        return rows.unionByName(edges.withColumn(_EDGE, F.lit(True)), allowMissingColumns=True)

    def inside(self, edge_first: bool) -> Window:
        edge = F.col(_EDGE).desc() if edge_first else F.col(_EDGE).asc()
        return Window.partitionBy(*self.keys, _RANGE).orderBy(edge, *self.order)

    def finish(self, df: DataFrame, added: Column, out: str) -> DataFrame:
        """The input's columns and `out`, which replaces a column of that name, at the end."""
        rows = df.withColumn(_OUT, added)
        if self.split:
            rows = rows.filter(~F.col(_EDGE))
        kept = [c for c in self.columns if c.lower() != out.lower()]
        return rows.select(*kept, F.col(_OUT).alias(out))


def sum_before(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    value: str,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add the sum of `value` over the earlier rows of the key, 0 for its first row."""
    cut = _Ranges(df, keys, order, ranges)
    return _sum_before(cut, F.coalesce(F.col(value), F.lit(0)), out)


def _sum_before(cut: _Ranges, value: Column, out: str) -> DataFrame:
    before = (Window.unboundedPreceding, -1)
    # A sum of sums would be of a wider decimal type.
    kind = cut.rows.select(F.sum(value).alias(_OUT)).schema[_OUT].dataType
    if not cut.split:
        total = F.sum(value).over(cut.whole().rowsBetween(*before))
        return cut.finish(cut.rows, F.coalesce(total, F.lit(0)).cast(kind), out)
    earlier = cut.over_ranges().rowsBetween(*before)
    edges = cut.summaries(F.sum(value)).withColumn(_VALUE, F.sum(_VALUE).over(earlier))
    both = cut.with_edges(value, edges.filter(F.col(_VALUE).isNotNull()))
    window = cut.inside(edge_first=True).rowsBetween(*before)
    total = F.coalesce(F.sum(_VALUE).over(window), F.lit(0)).cast(kind)
    return cut.finish(both, total, out)


def index_within(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    out: str = "index",
    ranges: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row inside its key."""
    return _sum_before(_Ranges(df, keys, order, ranges), F.lit(1).cast("bigint"), out)


def index_and_count(
    df: DataFrame, order: str | list[str], out: str = "index", ranges: int | None = None
) -> tuple[DataFrame, int]:
    """`index_within` over the whole table, and its row count."""
    cut = _Ranges(df, [], order, ranges)
    return _sum_before(cut, F.lit(1).cast("bigint"), out), cut.count


def rows_at(df: DataFrame, order: str | list[str], low: int, high: int, out: str = "index") -> DataFrame:
    """The rows whose index over the whole table lies in [low, high), with the index.

    The sizes of the ranges tell which of them can hold such rows; only these are numbered.
    """
    cut = _Ranges(df, [], order, None)
    sizes = cut.summaries(F.count(F.lit(1)))
    before = F.sum(_VALUE).over(cut.over_ranges().rowsBetween(Window.unboundedPreceding, -1))
    met = sizes.withColumn("start", F.coalesce(before, F.lit(0))).filter(
        (F.col("start") < high) & (F.col("start") + F.col(_VALUE) > low)
    )
    inside = Window.partitionBy(_RANGE).orderBy(*cut.order)
    # A row per range that is met: as a table it may be any size, and a small one is broadcast once
    # its size is known.
    numbered = cut.rows.join(met.select(_RANGE, "start"), _RANGE).withColumn(
        out, (F.col("start") + F.row_number().over(inside) - 1).cast("bigint")
    )
    return numbered.filter((F.col(out) >= low) & (F.col(out) < high)).select(*cut.columns, out)


def last_so_far(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    value: str,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add the latest non-null `value` of the key up to and including the row."""
    cut = _Ranges(df, keys, order, ranges)
    up_to_here = (Window.unboundedPreceding, 0)
    if not cut.split:
        latest = F.last(value, ignorenulls=True).over(cut.whole().rowsBetween(*up_to_here))
        return cut.finish(df, latest, out)
    place = F.when(F.col(value).isNotNull(), F.struct(*cut.order))
    # max_by is null for a range without a value, and the window looks past it.
    latest = cut.summaries(F.max_by(F.col(value), place))
    earlier = cut.over_ranges().rowsBetween(Window.unboundedPreceding, -1)
    edges = latest.withColumn(_VALUE, F.last(_VALUE, ignorenulls=True).over(earlier))
    both = cut.with_edges(F.col(value), edges.filter(F.col(_VALUE).isNotNull()))
    window = cut.inside(edge_first=True).rowsBetween(*up_to_here)
    return cut.finish(both, F.last(_VALUE, ignorenulls=True).over(window), out)


def next_value(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    value: str,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add `value` of the following row of the key, null for its last row."""
    cut = _Ranges(df, keys, order, ranges)
    if not cut.split:
        return cut.finish(df, F.lead(value).over(cut.whole()), out)
    first = cut.summaries(F.min_by(F.col(value), F.struct(*cut.order)))
    edges = first.withColumn(_VALUE, F.lead(_VALUE).over(cut.over_ranges()))
    # Without a following range there is no edge, so the last row has nothing after it; a null
    # value of the following row is the same to its reader.
    both = cut.with_edges(F.col(value), edges.filter(F.col(_VALUE).isNotNull()))
    return cut.finish(both, F.lead(_VALUE).over(cut.inside(edge_first=False)), out)
