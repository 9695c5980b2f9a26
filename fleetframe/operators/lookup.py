"""Look-ups by prefix, pattern and priority, and set algebra over names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.servers import AD_COLUMNS, server_weight
from fleetframe.functions.text import (
    fragments_at, glob_fragments, glob_regex_column, marked_ends, matches_any, requirement_name,
)

BASE_VERSION = r"[A-Za-z]+_\d+_\d+_\d+"
CELLS = 1 << 20  # hash values that are broadcast at most


def prefix_index(catalogue: DataFrame, token_boundary: bool = False) -> DataFrame:
    """Greatest arch for every prefix of every release, one row per prefix.

    Turns the prefix test into an equality, so that look-ups hash on it. With `token_boundary`
    a prefix may not end inside a word or number.
    """
    n = F.length("release")
    prefixes = catalogue.filter(n > 0).select(
        "arch", "release", F.explode(F.sequence(F.lit(1), n)).alias("_n")
    )
    if token_boundary:
        cut = F.substring("release", F.col("_n"), F.lit(2))
        prefixes = prefixes.filter((F.length(cut) == 1) | ~cut.rlike("^[A-Za-z0-9]{2}$"))
    prefix = F.substring("release", F.lit(1), F.col("_n"))
    return prefixes.groupBy(prefix.alias("prefix")).agg(F.max("arch").alias("arch"))


def resolve_by_prefix(
    lookups: DataFrame,
    catalogue: DataFrame,
    version: str = "version",
    base_pattern: str = BASE_VERSION,
    token_boundary: bool = False,
) -> DataFrame:
    """Add the greatest arch that has a release starting with the wanted version.

    The version is tried with its suffix first, then without. `arch` is null where nothing fits
    or the version is malformed. Each distinct version is resolved once and then joined back.
    """
    text = F.col(version)
    base = F.regexp_extract(text, f"({base_pattern})", 1)
    full = F.regexp_extract(text, f"({base_pattern}_.*)", 1)
    wanted = lookups.select(version).distinct().withColumns({"_base": base, "_full": full})
    keys = wanted.select(
        version,
        F.explode(
            F.array(
                F.struct(F.col("_base").alias("prefix"), F.lit(False).alias("suffixed")),
                F.struct(F.col("_full").alias("prefix"), F.lit(True).alias("suffixed")),
            )
        ).alias("_key"),
    ).select(version, "_key.*")
    index = prefix_index(catalogue, token_boundary)
    hits = keys.filter(F.col("prefix") != "").join(index, "prefix")
    resolved = hits.groupBy(version).agg(
        F.coalesce(F.max(F.when(F.col("suffixed"), F.col("arch"))), F.max("arch")).alias("arch"),
        F.bool_or("suffixed").alias("by_suffix"),
    )
    return lookups.join(resolved, version, "left")


def first_available(
    wanted: DataFrame, locations: list[str], listing: DataFrame, name: str = "name"
) -> DataFrame:
    """Add the path in the first of the locations that holds the file; null if none does.

    The locations are folders in order of priority, arguments of the call: a file finds its
    priority in a literal map and joins with nothing. The listing is reduced to the best
    priority per file before the wanted rows meet it.
    """
    path = F.col("path")
    base = F.substring_index(path, "/", -1)
    folder = F.left(path, F.length(path) - F.length(base) - 1)
    ranks = F.create_map(*[F.lit(x) for i, place in enumerate(locations) for x in (place, i)])
    files = listing.select(
        base.alias(name), F.try_element_at(ranks, folder).alias("priority")
    ).filter(F.col("priority").isNotNull())
    best = files.groupBy(name).agg(F.min("priority").alias("priority"))
    places = F.array(*[F.lit(place) for place in locations])
    found = F.concat(F.get(places, F.col("priority")), F.lit("/"), F.col(name))
    return wanted.join(best, name, "left").withColumn("path", found)


def missing(expected: DataFrame, listing: DataFrame, on: str | list[str] = "path") -> DataFrame:
    """Expected rows that the listing does not hold."""
    return expected.join(listing, on, "left_anti")


def add_default_requirements(
    requirements: DataFrame, defaults: list[tuple[str, str]], keys: list[str]
) -> DataFrame:
    """Add each default (package, mode) to the groups whose packages do not name it.

    Names are compared without their version. A mode left out is 'auto'. What a group lacks is
    found by one aggregate, so nothing is joined.
    """
    name = requirement_name(F.col("package"))
    cells = []
    for package, mode in defaults:
        present = F.bool_or(name == requirement_name(F.lit(package)))
        cells.append(
            F.when(
                ~F.coalesce(present, F.lit(False)),
                F.struct(F.lit(package).alias("package"), F.lit(mode).alias("mode")),
            )
        )
    lacking = requirements.groupBy(*keys).agg(F.array_compact(F.array(*cells)).alias("_lacking"))
    added = lacking.select(*keys, F.explode("_lacking").alias("_d")).select(*keys, "_d.*")
    given = requirements.select(
        *keys, "package", F.coalesce("mode", F.lit("auto")).alias("mode")
    )
    # A group may consist of a null package only: it stands for a group without requirements.
    return given.filter(F.col("package").isNotNull()).unionByName(added)


def matching_sites(sites: DataFrame, patterns: list[str], site: str = "site") -> DataFrame:
    """Distinct sites that match at least one shell pattern."""
    return sites.filter(matches_any(F.col(site), patterns)).select(site).distinct()


def matching_any(
    names: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern", at_once: int = 1000
) -> DataFrame:
    """Distinct names that match at least one of a table of shell patterns.

    Every match of a pattern holds its literal fragments, the ends of the name included. Each
    pattern is looked up by the one of its fragments that is rarest in the names, an equality join
    with the fragments of the names, and confirmed on the names that share it. Fragments are
    compared by their hashes, and only those of the names move that fall into a hash cell of a
    pattern's. Patterns of wildcards and sets only have no fragment; they are tested in scans of
    the names, `at_once` of them in one. Nulls match nothing.
    """
    every = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    asked = patterns.filter(F.col(pattern).isNotNull()).select(F.col(pattern).alias("_pattern")).distinct()
    asked = asked.withColumn("_fragments", glob_fragments(F.col("_pattern")))
    wanted = _hashed(asked.select("_pattern", F.explode("_fragments").alias("_fragment")))
    held = _hashed(_text_fragments(every))
    many = _in_cells_of(wanted, held).groupBy("_fragment").agg(F.count(F.lit(1)).alias("_many"))
    rarest = wanted.join(many, "_fragment", "left").groupBy("_pattern").agg(
        F.min(F.struct(F.coalesce("_many", F.lit(0)).alias("_many"), "_fragment")).alias("_rarest")
    )
    # A fragment that no name holds is the rarest: nothing can match its pattern.
    rarest = rarest.filter(F.col("_rarest._many") > 0).select(
        F.col("_rarest._fragment").alias("_fragment"), glob_regex_column(F.col("_pattern")).alias("_regex")
    )
    near = _in_cells_of(rarest, held).join(rarest, "_fragment").filter(F.rlike("_name", "_regex"))
    found = near.select("_name")
    loose = [r[0] for r in asked.filter(F.size("_fragments") == 0).select("_pattern").toLocalIterator()]
    for at in range(0, len(loose), at_once):
        found = found.unionByName(every.filter(matches_any(F.col("_name"), loose[at : at + at_once])))
    return found.distinct().withColumnRenamed("_name", name)


def _text_fragments(every: DataFrame) -> DataFrame:
    """Names with their fragments, one row for each place of a fragment: `text_fragments` unfolded
    in rows, as an array of them all takes five times as long."""
    marked = every.select("_name", marked_ends(F.col("_name")).alias("_marked"))
    places = marked.select("*", F.explode(F.sequence(F.lit(1), F.length("_marked"))).alias("_at"))
    found = fragments_at(F.col("_marked"), F.col("_at"))
    return places.select("_name", F.explode(found).alias("_fragment")).filter(F.col("_fragment").isNotNull())


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_fragment", F.xxhash64("_fragment"))


def _in_cells_of(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Held fragments but those that cannot be wanted; the cells are few enough to broadcast,
    however many fragments are wanted."""
    cell = F.pmod("_fragment", F.lit(CELLS))
    cells = wanted.select(cell.alias("_cell")).distinct()
    return held.join(F.broadcast(cells), cell == F.col("_cell"), "left_semi")


def select_sites(
    sites: DataFrame, deny: list[str], allow: list[str], site: str = "site"
) -> DataFrame:
    """(all - denied) + allowed, or all sites if that leaves none, told by `fallback`.

    Allowed sites are sites of the table too, so both set operations are row tests on its
    distinct names, and an allow list alone changes nothing.
    """
    name = F.col(site)
    kept = (~matches_any(name, deny)) | matches_any(name, allow)
    marked = sites.select(site).distinct().withColumn("_kept", kept)
    none_left = ~F.coalesce(marked.agg(F.bool_or("_kept")).scalar(), F.lit(False))
    return (
        marked.withColumn("fallback", none_left)
        .filter(F.col("_kept") | F.col("fallback"))
        .drop("_kept")
    )


def first_nonempty(sources: list[DataFrame]) -> DataFrame:
    """Rows of the first source that has any, with the number of that source."""
    tagged = [df.withColumn("source_rank", F.lit(rank)) for rank, df in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    return from_first_source(rows)


def from_first_source(rows: DataFrame, rank: str = "source_rank") -> DataFrame:
    """Rows of the least rank present; the rank is one value, found by a scalar subquery."""
    return rows.filter(F.col(rank) == rows.agg(F.min(rank)).scalar())


def constrained_ads(ads: DataFrame, drain: str, kind: str, wanted: str) -> DataFrame:
    """Ads that are not draining and of the wanted type; a missing value fails the test."""
    return ads.filter(
        F.col(drain).eqNullSafe(F.lit(False)) & F.col(kind).eqNullSafe(F.lit(wanted))
    )


def ad_weight() -> Column:
    return server_weight(F.col("duty_cycle"), F.col("running"), F.col("max_jobs"), F.col("idle"))


def best_server(ads: DataFrame, arrival: str = "arrival", keys: list[str] | None = None):
    """The least loaded server; equal ones in order of arrival. A server that can run nothing
    comes last."""
    weight = F.coalesce(ad_weight(), F.lit(float("inf")))
    weighed = ads.withColumn("weight", weight)
    row = F.struct(*[c for c in AD_COLUMNS if c in ads.columns], "weight")
    best = weighed.groupBy(*(keys or [])).agg(
        F.min_by(row, F.struct("weight", arrival)).alias("_best")
    )
    return best.select(*(keys or []), "_best.*")


def concat_requirements(per_call: Column, session_wide: Column) -> Column:
    """Requirements of the call, then those of the session, repeats kept."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(per_call, none), F.coalesce(session_wide, none))
