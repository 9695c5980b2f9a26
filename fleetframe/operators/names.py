"""Unique names: the first asker keeps the name, later ones get a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.ordered import index_within, sum_before
from fleetframe.session import work_dir


def _splits(name: Column) -> Column:
    """All ways to read a name as a base followed by a canonical number of up to 18 digits."""
    digits = F.length(F.regexp_extract(name, r"(\d{0,18})\z", 1))
    lengths = F.when(digits > 0, F.sequence(F.lit(1), F.least(digits, F.length(name) - 1)))
    cuts = F.transform(
        lengths,
        lambda n: F.struct(
            F.substring(name, F.lit(1), F.length(name) - n).alias("base"),
            F.right(name, n).alias("digits"),
        ),
    )
    return F.filter(cuts, lambda c: (c["digits"] == "0") | ~c["digits"].startswith("0"))


def _read(names: DataFrame, separator: str) -> DataFrame:
    """(base, k) readings of the names that could have been made by adding a number."""
    if separator:
        pattern = "^(.+)" + "".join("\\" + c for c in separator) + r"(0|[1-9]\d{0,17})$"
        parts = names.select(
            F.regexp_extract("name", pattern, 1).alias("base"),
            F.regexp_extract("name", pattern, 2).alias("digits"),
        ).filter(F.col("base") != "")
    else:
        parts = names.filter(F.length("name") > 1).select(
            F.explode(_splits(F.col("name"))).alias("_s")
        )
        parts = parts.select("_s.base", "_s.digits")
    return parts.select("base", F.col("digits").cast("bigint").alias("k"))


def _numbered(repeats: DataFrame, blocked: DataFrame) -> DataFrame:
    """Give the j-th repeat of a base the j-th number that is not blocked for it.

    With the blocked numbers b_0 < b_1 < ... of a base, that number is j plus how many r have
    b_r - r <= j: a running count over repeats and blocked numbers laid on one axis.
    """
    ranked = index_within(blocked, ["base"], "k", "_r")
    steps = ranked.groupBy("base", (F.col("k") - F.col("_r")).alias("_pos")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    axis = repeats.withColumns(
        {"_pos": F.col("_j"), "_n": F.lit(0).cast("bigint"), "_kind": F.lit(1)}
    ).unionByName(steps.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    counted = sum_before(axis, ["base"], ["_pos", "_kind"], "_n", "_skipped")
    return (
        counted.filter(F.col("_kind") == 1)
        .withColumn("k", F.col("_j") + F.col("_skipped"))
        .drop("_pos", "_n", "_kind", "_skipped")
    )


def with_default_names(rows: DataFrame, name: str, order: str, prefix: str = "cluster") -> DataFrame:
    """Rows without a name get the prefix and their 0-based position in the whole order."""
    placed = index_within(rows, [], order, "_at")
    filled = F.coalesce(F.col(name), F.concat(F.lit(prefix), F.col("_at").cast("string")))
    return placed.withColumn(name, filled).drop("_at")


def unique_names(
    rows: DataFrame,
    name: str = "name",
    order: str = "i",
    out: str = "unique_name",
    separator: str = "",
    limit: int | None = None,
) -> DataFrame:
    """Add a name that no other row has.

    The first row of a name, by `order`, keeps it. The others get the name with the least free
    number 0, 1, 2, ... behind it. A number is not free if the result is asked for literally
    by some row, or is the numbered name of a shorter base. With `limit`, running out of numbers
    below it is an error. Rows without a name keep none: see `with_default_names`.
    """
    spark = rows.sparkSession
    indexed = index_within(rows, [name], order, "_j")
    # Read by several of the steps below, so written once.
    counts = rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("_n"))
    path = work_dir(spark, "name-counts")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    bases = counts.filter(F.col("_n") > 1).select(F.col("name").alias("base"))
    literal = _read(counts.select("name"), separator).join(bases, "base", "left_semi")

    # Only without a separator can two bases lead to the same numbered name.
    rivals = None
    if not separator:
        inner = F.transform(_splits(F.col("long")), lambda c: c["base"])
        rivals = (
            bases.filter(F.length("base") > 1)
            .select(F.col("base").alias("long"))
            .select("long", F.explode(inner).alias("base"))
            .join(bases, "base", "left_semi")
        )
        if rivals.isEmpty():
            rivals = None

    def named(number: Column) -> Column:
        made = F.concat(F.col(name), F.lit(separator), number.cast("string"))
        if limit is None:
            return made
        spent = F.raise_error(F.concat(F.lit("no free number for "), F.col(name)))
        return F.when(number < limit, made).otherwise(spent)

    if rivals is None and literal.isEmpty():
        numbered = F.when(F.col("_j") == 0, F.col(name)).otherwise(named(F.col("_j") - 1))
        return indexed.withColumn(out, numbered).drop("_j")

    # The numbering below reads the rows several times, so they are written once.
    path = work_dir(spark, "names")
    indexed.write.parquet(path)
    indexed = spark.read.schema(indexed.schema).parquet(path)
    first = indexed.filter(F.col("_j") == 0).drop("_j").withColumn(out, F.col(name))
    repeats = indexed.filter(F.col("_j") > 0).withColumns(
        {"base": F.col(name), "_j": F.col("_j") - 1}
    )
    if rivals is None:
        later = _numbered(repeats, literal)
    else:
        later = _settle(spark, repeats, literal, rivals)
    return first.unionByName(later.withColumn(out, named(F.col("k"))).drop("base", "_j", "k"))


def _settle(spark, repeats: DataFrame, literal: DataFrame, rivals: DataFrame) -> DataFrame:
    """Number the repeats where a shorter base may take names from a longer one.

    After round n all bases that are nested n deep are final, so there are at most as many rounds
    as the longest chain of rivals has bases; they end when the taken names no longer change. The
    taken names are written each round, so the plan does not grow.
    """
    short = rivals.select("base").distinct()
    long = rivals.select(F.col("long").alias("base")).distinct()
    blocked, last = literal, None
    while True:
        numbered = _numbered(repeats, blocked)
        made = (
            numbered.join(short, "base", "left_semi")
            .select(F.concat("base", F.col("k").cast("string")).alias("name"), "base")
            .withColumnRenamed("base", "_from")
        )
        readings = made.select("_from", F.explode(_splits(F.col("name"))).alias("_s")).select(
            "_from", F.col("_s.base").alias("base"), F.col("_s.digits").cast("bigint").alias("k")
        )
        taken = (
            readings.filter(F.length("base") > F.length("_from"))
            .join(long, "base", "left_semi")
            .select("base", "k")
            .unionByName(literal)
            .distinct()
        )
        path = work_dir(spark, "taken-names")
        taken.write.parquet(path)
        taken = spark.read.schema("base string, k bigint").parquet(path)
        mark = taken.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("base", "k"))).first()
        if mark == last:
            return numbered
        blocked, last = taken, mark
