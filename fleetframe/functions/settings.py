"""Maps of submit settings: right side wins, environments merge, file lists add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES_KEY = "transfer_input_files"


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps; on equal keys the right value. A null side counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    right = F.coalesce(right, empty)
    left = F.coalesce(left, empty)
    kept = F.map_filter(left, lambda key, _: ~F.map_contains_key(right, key))
    return F.map_concat(kept, right)


def concat_files(*lists: Column) -> Column:
    """Comma lists one after the other, repeats kept, null lists skipped."""
    return F.concat_ws(",", *lists)


def merge_settings(left: Column, right: Column) -> Column:
    """`merge_maps`, but input files of both sides are kept, left ones first."""
    files = concat_files(
        F.try_element_at(left, F.lit(FILES_KEY)), F.try_element_at(right, F.lit(FILES_KEY))
    )
    merged = merge_maps(left, right)
    with_files = merge_maps(merged, F.create_map(F.lit(FILES_KEY), files))
    return F.when(F.map_contains_key(merged, FILES_KEY), with_files).otherwise(merged)


def map_text(entries: Column) -> Column:
    """Map as 'k=v;k=v' in key order, for display and comparison."""
    cells = F.transform(
        F.array_sort(F.map_entries(entries)),
        lambda cell: F.concat(cell["key"], F.lit("="), F.coalesce(cell["value"], F.lit(""))),
    )
    return F.array_join(cells, ";")
