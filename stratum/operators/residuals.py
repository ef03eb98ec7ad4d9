"""Residuals and misfits of observations, origin times, azimuthal gaps, diagnostics of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.moments import ratio


def fit_stats(residuals: DataFrame, obs: str, r: Column, sigma: Column, norm: float = 2.0) -> DataFrame:
    """(obs, total, rms, misfit): sum |r|^p, the root of its mean, and the sum scaled by sigma^p."""
    p = F.pow(F.abs(r), F.lit(norm))
    return residuals.groupBy(obs).agg(F.sum(p).alias("total"), F.sqrt(F.avg(p)).alias("rms"), F.sum(p / F.pow(sigma, F.lit(norm))).alias("misfit"))


def lp_misfit(residuals: DataFrame, obs: str, r: Column, norm: float) -> DataFrame:
    """(obs, total, rms) with the p-th root of the mean."""
    p = F.pow(F.abs(r), F.lit(norm))
    return residuals.groupBy(obs).agg(F.sum(p).alias("total"), F.pow(F.avg(p), F.lit(1 / norm)).alias("rms"))


def weighted_average(residuals: DataFrame, keys: list[str], r: Column, sigma: Column) -> DataFrame:
    """Inverse-variance weighted mean."""
    return residuals.groupBy(*keys).agg(ratio(F.sum(r / (sigma * sigma)), F.sum(1 / (sigma * sigma))).alias("shift"))


def wadati(pairs: DataFrame, event: str, p: Column, s: Column) -> DataFrame:
    """(event, slope, intercept, origin_time) of the line of S - P over P by least squares; NaN where P does not vary."""
    y = s - p
    g = pairs.groupBy(event).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.covar_pop(p, y).alias("cov"), F.var_pop(p).alias("var"))
    slope = ratio(F.col("cov"), F.col("var"))
    g = g.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mp"))
    return g.select(event, "slope", "intercept", ratio(-F.col("intercept"), F.col("slope")).alias("origin_time"))


def azimuthal_gap(arrivals: DataFrame, event: str, azimuth: Column) -> DataFrame:
    """Largest gap between neighbouring azimuths (degrees) around each event, the one across north included."""
    g = arrivals.groupBy(event).agg(F.sort_array(F.collect_set(azimuth)).alias("a"))
    a = F.col("a")
    inner = F.array_max(F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.get(a, i) - F.get(a, i - 1))))
    return g.select(event, F.greatest(inner, 360 - (F.element_at(a, -1) - F.get(a, 0))).alias("gap"))


def chain_metrics(models: DataFrame, statics: DataFrame, nuclei: DataFrame, num_saved: int) -> DataFrame:
    """One row for each saved model: iteration number, accepted, misfit, root mean square of event statics, nuclei and norm of values of each field (long in field)."""
    index = (F.row_number().over(Window.partitionBy("chain").orderBy("iteration")) - 1) * num_saved
    base = models.withColumn("step", index)
    s = statics.groupBy("chain", "iteration").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("statics_rms"))
    n = nuclei.groupBy("chain", "iteration", "field").agg(F.count("*").alias("cells"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return base.join(s, ["chain", "iteration"], "left").join(n, ["chain", "iteration"], "left")


def acceptance(accepted: Column, iteration: Column) -> Column:
    """Percent of accepted proposals; 0 at the start model."""
    return F.when(iteration > 0, 100.0 * accepted / iteration).otherwise(0.0)


def variance_reduction(metrics: DataFrame, obs: str, rms: str = "rms", step: str = "step") -> DataFrame:
    """metrics with 100 (rms^2 - ref^2) / ref^2; ref is the mean first rms of all chains, for each observable."""
    first = metrics.where(F.col(step) == 0).groupBy(obs).agg(F.avg(rms).alias("_ref"))
    return metrics.join(first, obs).withColumn("reduction", 100 * (F.col(rms) ** 2 - F.col("_ref") ** 2) / F.col("_ref") ** 2).drop("_ref")


def histogram(values: DataFrame, group: list[str], value: Column, width: float) -> DataFrame:
    """(group, bin, probability): bins aligned to multiples of width; shares of the group. Totals come from the bins, not from the rows."""
    bins = values.groupBy(*group, (F.floor(value / width) * width).alias("bin")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*group))
    return bins.select(*group, "bin", (F.col("c") / total).alias("probability"))


def swap_rates(swaps: DataFrame) -> DataFrame:
    """swaps: (t1, t2, swapped 0/1). Acceptance of each pair of temperatures, either way round; NaN for pairs never tried."""
    both = swaps.select("t1", "t2", "swapped").unionAll(swaps.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "swapped"))
    rates = both.groupBy("t1", "t2").agg(F.avg(F.col("swapped").cast("double")).alias("rate"))
    t = both.select("t1").distinct()
    pairs = t.join(t.withColumnRenamed("t1", "t2"), F.lit(True))  # the temperatures of a ladder: tens
    return pairs.join(rates, ["t1", "t2"], "left").withColumn("rate", F.coalesce("rate", F.lit(float("nan"))))


def least_misfit(scores: DataFrame, event: str, node: str, misfit: str) -> DataFrame:
    """The node of least misfit of each event; of equal ones the lowest."""
    return scores.groupBy(event).agg(F.min(F.struct(misfit, node)).alias("b")).select(event, f"b.{node}", f"b.{misfit}")


def trailing_noise(noise: DataFrame, count: int) -> DataFrame:
    """Mean noise of each observable over the last saved models of all chains."""
    from stratum.operators.select import trailing

    return trailing(noise, ["chain", "obs_name"], ["iteration"], count).groupBy("obs_name").agg(F.avg("noise").alias("noise"))


def quality_control(arrivals: DataFrame, first: Column, second: Column) -> DataFrame:
    """Arrivals with the earlier of two predicted times, which one it is, and whether both lack."""
    ok = lambda t: F.when(~(t.isNull() | F.isnan(t) | (t == float("inf"))), t)
    a, b = ok(first), ok(second)
    time = F.least(a, b)
    return arrivals.withColumns({"predicted": time, "branch": F.when(time.isNull(), 0).when(a == time, 1).otherwise(2), "bad": time.isNull()})
