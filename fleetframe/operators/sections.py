"""Cutting a text into the lines between and outside of markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.ordered import sum_before

# Line prefixes that open and close a section.
OPEN_MARKER = '"""# submit'
CLOSE_MARKER = '"""# endsubmit'


def mark_sections(
    lines: DataFrame,
    keys: list[str],
    order: str = "line_no",
    line: str = "line",
    open_marker: str = OPEN_MARKER,
    close_marker: str = CLOSE_MARKER,
) -> DataFrame:
    """Add `depth` before each line and its `kind`.

    Kinds: 'outside', 'inside', and for marker lines 'open', 'close', 'nested_open',
    'stray_close'. Behind the first error of a file its depth means nothing.
    """
    opens, closes = F.col(line).startswith(open_marker), F.col(line).startswith(close_marker)
    stepped = lines.withColumn("_step", F.when(opens, 1).when(closes, -1).otherwise(0))
    deep = sum_before(stepped, keys, order, "_step", "depth")
    is_open, is_close = F.col("_step") == 1, F.col("_step") == -1
    kind = (
        F.when(is_open & (F.col("depth") != 0), F.lit("nested_open"))
        .when(is_close & (F.col("depth") != 1), F.lit("stray_close"))
        .when(is_open, F.lit("open"))
        .when(is_close, F.lit("close"))
        .when(F.col("depth") == 1, F.lit("inside"))
        .otherwise(F.lit("outside"))
    )
    return deep.withColumn("kind", kind).drop("_step")


def section_lines(marked: DataFrame, inside: bool) -> DataFrame:
    """Lines inside (or outside) of sections; marker lines are dropped."""
    return marked.filter(F.col("kind") == ("inside" if inside else "outside")).drop("depth", "kind")


def section_report(marked: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Per file: line counts, the first error, and whether a section is left open.

    A file with an error is one the caller should refuse; an open section is accepted.
    """
    kind = F.col("kind")
    error = kind.isin("nested_open", "stray_close")
    opened = F.count_if(kind == "open") - F.count_if(kind == "close")
    return marked.groupBy(*keys).agg(
        F.count_if(kind == "outside").alias("n_outside"),
        F.count_if(kind == "inside").alias("n_inside"),
        F.min(F.when(error, F.col(order))).alias("first_error"),
        (opened > 0).alias("unclosed"),
    )
