"""Sample parameters: defaults, number rendering and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the sample parameters.
DEFAULTS = {"mz": 150.0, "rinv": 0.3, "boost": 0.0, "mdark": 20.0, "alpha": "peak"}
ARCHIVE_STEP = "step0_GRIDPACK"


def with_defaults(params: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Fill absent parameters; a column the table lacks is added."""
    wanted = DEFAULTS if defaults is None else defaults
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in params.columns else F.lit(value)
        for name, value in wanted.items()
    }
    optional = {
        name: F.lit(None).cast("int")
        for name in ("max_events", "part")
        if name not in params.columns
    }
    return params.withColumns({**filled, **optional})


def whole_text(number: Column) -> Column:
    """Number without decimals, halves to the even neighbour."""
    return F.bround(number, 0).cast("decimal(38,0)").cast("string")


def float_text(number: Column) -> Column:
    """Shortest decimal text: plain from 1e-4 up to below 1e16, else d.dde+XX."""
    text = number.cast("string")
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), "-", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "(?<=.)0+$", "")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, "0")
    rest = F.substring(digits, exponent + 2, F.length(digits))
    large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.concat(
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"),
    )
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), power)
    return (
        F.when(~text.contains("E"), text)
        .when((exponent >= 0) & (exponent < 16), F.concat(sign, large))
        .when((exponent < 0) & (exponent >= -4), F.concat(sign, small))
        .otherwise(F.concat(sign, scientific))
    )


def sample_name(step: Column, extension: str = ".root", with_part: bool = True) -> Column:
    """File name of a step from the parameter columns of the row (see `with_defaults`)."""
    boost = F.when(F.col("boost") > 0, F.concat(F.lit("_PT"), whole_text(F.col("boost"))))
    events = F.concat(F.lit("_n-"), F.col("max_events").cast("string"))
    part = F.concat(F.lit("_part-"), F.col("part").cast("string")) if with_part else F.lit(None)
    return F.concat(
        step,
        F.lit("_s-channel_mMed-"),
        whole_text(F.col("mz")),
        F.lit("_mDark-"),
        whole_text(F.col("mdark")),
        F.lit("_rinv-"),
        float_text(F.col("rinv")),
        F.lit("_alpha-"),
        F.col("alpha"),
        F.coalesce(boost, F.lit("")),
        F.lit("_13TeV-madgraphMLM-pythia8"),
        F.coalesce(events, F.lit("")),
        F.coalesce(part, F.lit("")),
        F.lit(extension),
    )


def archive_name() -> Column:
    """Archive a sample starts from; archives carry no part tag."""
    return sample_name(F.lit(ARCHIVE_STEP), extension=".tar.xz", with_part=False)


def attempts_allowed(target: Column) -> Column:
    """Three attempts for the steps known to fail at random, one for the others."""
    return F.when(target.contains("RECO") | target.contains("DIGI"), F.lit(3)).otherwise(F.lit(1))


def parameter_grid(base: DataFrame, **axes: list) -> DataFrame:
    """Each row of the base table with every combination of the listed parameter values.

    The axes are arguments of the call. Each is unfolded in place from an array literal, so the
    grid is a chain of generators and no join.
    """
    for name, values in axes.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base
