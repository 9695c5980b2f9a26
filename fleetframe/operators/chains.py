"""Chains of steps as pairs of input and output step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions.params import attempts_allowed
from fleetframe.operators.ordered import next_value


def chain_pairs(samples: DataFrame, chain: str = "chain") -> DataFrame:
    """One row per consecutive pair of a chain held in an array; the first step is only read."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(chain) - 2),
        lambda i: F.struct(
            i.alias("pos"),
            F.get(F.col(chain), i).alias("source"),
            F.get(F.col(chain), i + 1).alias("target"),
        ),
    )
    rows = samples.filter(F.size(chain) > 1).withColumn("_pair", F.explode(pairs))
    return rows.select(
        *[c for c in samples.columns if c != chain],
        "_pair.*",
        attempts_allowed(F.col("_pair.target")).alias("attempts"),
    )


def step_pairs(
    steps: DataFrame, keys: list[str], order: str | list[str], step: str = "step"
) -> DataFrame:
    """The same for chains that come as rows; the last step of a chain has no pair."""
    followed = next_value(steps, keys, order, step, "target")
    return followed.filter(F.col("target").isNotNull()).withColumn(
        "attempts", attempts_allowed(F.col("target"))
    )
