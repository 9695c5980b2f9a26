"""What the operators share: reading tables, written intermediates, spread numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.session import work_dir

# A word, by the definition that all operators here share, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
# How much text goes to a Python worker at once. Only memory depends on it, never a result.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and any executor can read it."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that names an operator adds cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with as many underscores behind it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hashes(text: str) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(F.lit(1), F.col(text)), F.xxhash64(F.col(text), F.lit(2))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, salt: Column) -> DataFrame:
    """Number the rows of each key from 0, by salt and then by `order`, without one task per key.

    `salt` is a whole number from 0. A key's rows are numbered inside each salt and shifted by the
    sizes of the salts before it, so a key that holds a third of all rows is spread over as many
    groups as there are salts. Null keys form a key of their own.
    """
    salted = df.withColumn("_salt", salt.cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_salt").alias("_s"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
    )
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_in", F.row_number().over(inside) - 1)
    match = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        numbered.join(shifts, match)
        .withColumn(out, F.col("_in") + F.col("_shift"))
        .drop("_salt", "_s", "_shift", "_in", *[f"_k{i}" for i in range(len(keys))])
    )
