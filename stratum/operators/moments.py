"""Posterior moments and correlations of samples in long form, one row for each value.

Every statistic is built from sums that Spark combines before it shuffles, so a point with very many samples costs
no more than another.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0 (or undefined)."""
    return F.when((b != 0) & ~F.isnan(b), a / b).otherwise(F.lit(float("nan")))


def reciprocal(v: Column) -> Column:
    """1 / v; infinite where v is 0."""
    return F.when(v == 0, float("inf")).otherwise(1 / v)


def squeezed(value: Column, inside: Column, reference: Column | float) -> Column:
    """value inside a field's domain, the reference value outside."""
    return F.when(inside, value).otherwise(reference)


def power_sums(samples: DataFrame, keys: list[str], value: Column, order: int = 3) -> DataFrame:
    """n and s1 .. s<order>: sums of the value's powers in each group."""
    powers, p = [], F.lit(1.0)
    for i in range(1, order + 1):
        p = p * value
        powers.append(F.sum(p).alias(f"s{i}"))
    return samples.groupBy(*keys).agg(F.count(value).alias("n"), *powers)


def finished(sums: DataFrame, keys: list[str]) -> DataFrame:
    """mean, standard deviation and skewness (both of the population) from power sums of order 3."""
    m1, m2, m3 = (F.col(f"s{i}") / F.col("n") for i in (1, 2, 3))
    sd = F.sqrt(F.greatest(F.lit(0.0), m2 - m1 * m1))
    return sums.select(*keys, "n", m1.alias("mean"), sd.alias("sd"), ratio(m3 - 3 * m1 * sd * sd - m1 * m1 * m1, sd * sd * sd).alias("skewness"))


def moments(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return finished(power_sums(samples, keys, value), keys)


def correlation(samples: DataFrame, keys: list[str], x: Column, y: Column, inside: Column | None = None) -> DataFrame:
    """Means, standard deviations and Pearson correlation of two fields; products count only inside both domains, though all samples are the denominator."""
    xy = x * y if inside is None else F.when(inside, x * y)
    g = samples.groupBy(*keys).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), (F.coalesce(F.sum(xy), F.lit(0.0)) / F.count("*")).alias("xy"))
    sd = lambda m, q: F.sqrt(F.greatest(F.lit(0.0), F.col(q) - F.col(m) * F.col(m)))
    g = g.withColumn("sd_x", sd("mean_x", "xx")).withColumn("sd_y", sd("mean_y", "yy"))
    return g.select(*keys, "mean_x", "mean_y", "sd_x", "sd_y", ratio(F.col("xy") - F.col("mean_x") * F.col("mean_y"), F.col("sd_x") * F.col("sd_y")).alias("pcc"))


def all_moments(samples: DataFrame, point: str, fields: list[str]) -> DataFrame:
    """Wide form: u1_ u2_ u3_ (mean, sd, skewness) of each field and pcc_ of each pair, one row for each point, in one aggregation."""
    aggs = [F.count("*").alias("n")]
    for f in fields:
        x = F.col(f)
        aggs += [F.sum(x).alias(f"s1_{f}"), F.sum(x * x).alias(f"s2_{f}"), F.sum(x * x * x).alias(f"s3_{f}")]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in combinations(fields, 2)]
    g = samples.groupBy(point).agg(*aggs)
    out = [F.col(point)]
    mean = lambda f: F.col(f"s1_{f}") / F.col("n")
    sd = lambda f: F.sqrt(F.greatest(F.lit(0.0), F.col(f"s2_{f}") / F.col("n") - mean(f) * mean(f)))
    for f in fields:
        m, s = mean(f), sd(f)
        out += [m.alias(f"u1_{f}"), s.alias(f"u2_{f}"), ratio(F.col(f"s3_{f}") / F.col("n") - 3 * m * s * s - m * m * m, s * s * s).alias(f"u3_{f}")]
    out += [ratio(F.col(f"p_{a}_{b}") / F.col("n") - mean(a) * mean(b), sd(a) * sd(b)).alias(f"pcc_{a}_{b}") for a, b in combinations(fields, 2)]
    return g.select(*out)


def harmonic_mean(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """1 / mean(1 / v): velocities averaged as slownesses. A velocity of 0 has infinite slowness, so its group has velocity 0."""
    return samples.groupBy(*keys).agg(reciprocal(F.avg(reciprocal(value))).alias("velocity"))


def probability(samples: DataFrame, keys: list[str], condition: Column, name: str = "probability") -> DataFrame:
    """Share of samples that meet a condition."""
    return samples.groupBy(*keys).agg(F.avg(condition.cast("double")).alias(name))
