"""Functions that Spark lacks, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions.let import let

#: Terms of the error function's series, and of its continued fraction from TURN on: both within 1e-14.
TERMS, TURN = 60, 2.5


def erf(x: Column) -> Column:
    """The error function: a series of positive terms near 0, a continued fraction of the complement beyond. Null for null, NaN for NaN."""

    def near(a: Column) -> Column:
        step = lambda acc, n: let(acc["term"] * 2 * a * a / (2 * n + 1), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))
        first = 2 / math.sqrt(math.pi) * a * F.exp(-a * a)
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])

    def far(a: Column) -> Column:
        below = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), a, lambda acc, k: a + k / 2 / acc)
        return 1 - F.exp(-a * a) / (math.sqrt(math.pi) * below)

    return let(F.abs(x.cast("double")), lambda a: F.when(a < TURN, near(a)).when(~F.isnan(a), far(a)).otherwise(a)) * F.when(x < 0, -1.0).otherwise(1.0)


def normal_cdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    """Share of a normal distribution below x."""
    return (1 + erf((x - mean) / (sd * math.sqrt(2.0)))) / 2
