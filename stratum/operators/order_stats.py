"""Order statistics of the samples of each (point, field).

One aggregation sorts a group's samples into an array (as many as chains have saved models), and higher-order
functions do the rest, so each statistic costs one shuffle whatever the number of points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.let import let
from stratum.operators.moments import ratio


def sorted_samples(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, s): ascending values, nulls and NaN left out."""
    return samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(~F.isnan(value), value))).alias("s"))


def quantile(s: Column, q: float | Column) -> Column:
    """Linear interpolation between the order statistics of a sorted array (type 7)."""
    h = (F.size(s) - 1) * (F.lit(q) if isinstance(q, float) else q)
    low = F.floor(h).cast("int")
    a = F.get(s, low)
    b = F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (h - low) * (b - a)


def median_interval(s: Column, level: float) -> tuple[Column, Column]:
    """Equal-tailed interval."""
    return quantile(s, (1 - level) / 2), quantile(s, 1 - (1 - level) / 2)


def low_high_interval(s: Column, level: float) -> tuple[Column, Column]:
    """(q(level), q(1 - level)): the larger first for a level over a half."""
    return quantile(s, level), quantile(s, 1 - level)


def densest_interval(s: Column, level: float) -> tuple[Column, Column]:
    """Narrowest window with floor(level * n) samples; of equally narrow ones the first."""
    n = F.greatest(F.lit(1), F.floor(F.lit(level) * F.size(s)).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), F.size(s) - n), lambda i: F.struct((F.get(s, i + n - 1) - F.get(s, i)).alias("width"), i.alias("i")))
    i = F.array_min(windows)["i"]
    return F.get(s, i), F.get(s, i + n - 1)


def freedman_diaconis(s: Column) -> Column:
    """Bin width 2 IQR / cbrt(n), to nine decimals: the last bits of a root must not decide between bins."""
    low, high = median_interval(s, 0.5)
    return F.round(2 * (high - low) / F.cbrt(F.size(s).cast("double")), 9)


def mode(s: Column, width: Column | None = None) -> Column:
    """binned_mode() of a sorted array in one pass: equal bins are neighbours, so a fold keeps the bin it is in and the fullest one so far."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("double").alias("bin"), zero.alias("c"), F.lit(None).cast("double").alias("top"), zero.alias("most"))

    def step(acc, b):
        c = F.when(acc["bin"] == b, acc["c"] + 1).otherwise(F.lit(1).cast("long"))
        return let(c, lambda c: F.struct(b.alias("bin"), c.alias("c"), F.when(c > acc["most"], b).otherwise(acc["top"]).alias("top"), F.greatest(c, acc["most"]).alias("most")))

    fullest = lambda w: F.aggregate(F.transform(s, lambda x: F.rint(x / w)), start, step, lambda acc: acc["top"]) * w
    return let(freedman_diaconis(s) if width is None else width, lambda w: F.when(w > 0, fullest(w)).otherwise(quantile(s, 0.5)))


def binned_mode(sorted_: DataFrame, keys: list[str], width: Column | None = None) -> DataFrame:
    """(keys, mode): centre of the fullest bin of multiples of the width (Freedman-Diaconis by default), values rounded half to even; of equally full bins the lowest. The median where the width is 0."""
    return sorted_.select(*keys, mode(F.col("s"), width).alias("mode"))


def hellinger_uniform(s: Column, low: Column | float, high: Column | float) -> Column:
    """Distance from a uniform prior on [low, high], with rint(sqrt(n)) bins closed on the right; the first holds all below it."""
    low, high = (F.lit(x) if isinstance(x, (int, float)) else x for x in (low, high))
    bins = F.rint(F.sqrt(F.size(s).cast("double")))
    dx = (high - low) / bins
    at = F.transform(s, lambda x: F.greatest(F.ceil((x - low) / dx) - 1, F.lit(0).cast("long")))
    # the array is sorted, so equal bins are neighbours: a fold adds sqrt(count) at every change
    start = F.struct(F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("sum"))
    step = lambda acc, b: F.struct(b.alias("bin"), F.when(acc["bin"] == b, acc["c"] + 1).otherwise(F.lit(1).cast("long")).alias("c"), F.when(acc["bin"] == b, acc["sum"]).otherwise(acc["sum"] + F.sqrt(acc["c"].cast("double"))).alias("sum"))
    total = F.aggregate(at, start, step, lambda acc: acc["sum"] + F.sqrt(acc["c"].cast("double")))
    overlap = F.sqrt(dx / (high - low)) * total / F.sqrt(F.size(s).cast("double"))
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - overlap)))


def hellinger(s: Column, cdf, width: Column | None = None) -> Column:
    """Distance from a prior given by its distribution function (Column to Column): bins from the smallest sample on; null without spread (a width of 0)."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("bin"), zero.alias("c"), F.lit(0.0).alias("sum"))

    def distance(low, w):
        at = F.transform(s, lambda x: F.greatest(F.ceil((x - low) / w) - 1, F.lit(0).cast("long")))
        share = lambda b: cdf(low + (b + 1) * w) - cdf(low + b * w)
        # equal bins are neighbours in a sorted array: a fold adds a bin's part when the next begins
        part = lambda acc: F.when(acc["c"] > 0, F.sqrt(F.greatest(F.lit(0.0), share(acc["bin"])) * acc["c"] / F.size(s))).otherwise(0.0)
        step = lambda acc, b: F.struct(b.alias("bin"), F.when(acc["bin"] == b, acc["c"] + 1).otherwise(F.lit(1).cast("long")).alias("c"), F.when(acc["bin"] == b, acc["sum"]).otherwise(acc["sum"] + part(acc)).alias("sum"))
        return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.aggregate(at, start, step, lambda acc: acc["sum"] + part(acc)))))

    width = freedman_diaconis(s) if width is None else width
    return let(F.struct(F.get(s, 0).alias("low"), width.alias("w")), lambda k: F.when(k["w"] > 0, distance(k["low"], k["w"])))


def hellinger_uniform_normal(low: float, high: float, sd: float) -> float:
    """Closed form between a uniform density on [low, high] and a normal one of mean 0."""
    overlap = math.sqrt(math.pi) * sd * (math.erf(high / (2 * sd)) - math.erf(low / (2 * sd)))
    return math.sqrt(max(0.0, 1 - overlap / math.sqrt(high - low) / (2 * math.pi * sd * sd) ** 0.25))


def kolmogorov_uniform(s: Column, low: Column | float, high: Column | float) -> Column:
    """Largest distance between the samples' distribution and a uniform one on [low, high]."""
    n = F.size(s)
    gaps = F.transform(s, lambda x, i: F.greatest(F.abs(i / n - (x - low) / (high - low)), F.abs((i + 1) / n - (x - low) / (high - low))))
    return F.array_max(gaps)


def statistics(s: Column, low: Column | float, high: Column | float, level: float = 0.9, quantiles: tuple[float, ...] = (0.25, 0.75)) -> list[Column]:
    """The columns of tendencies() from median to mode, of a sorted array."""
    (mi1, mi2), (lh1, lh2), (hd1, hd2) = median_interval(s, level), low_high_interval(s, level), densest_interval(s, level)
    return [quantile(s, 0.5).alias("median"), *(quantile(s, q).alias(f"q{i}") for i, q in enumerate(quantiles, 1)), mi1.alias("mi_lo"), mi2.alias("mi_hi"), lh1.alias("lhi_a"), lh2.alias("lhi_b"), hd1.alias("hdi_lo"), hd2.alias("hdi_hi"), hellinger_uniform(s, low, high).alias("hval"), mode(s).alias("mode")]


def tendencies(samples: DataFrame, keys: list[str], value: Column, low: float, high: float, level: float = 0.9, quantiles: tuple[float, ...] = (0.25, 0.75), distance: Column | None = None) -> DataFrame:
    """Mean, median, quantiles, the three intervals, Hellinger distance from a uniform prior, binned mode and mean distance to the nearest nucleus."""
    extra = [] if distance is None else [F.avg(distance).alias("ndist")]
    g = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sort_array(F.collect_list(value)).alias("s"), *extra)
    *cols, last = statistics(F.col("s"), low, high, level, quantiles)
    return g.select(*keys, "mean", *cols, *(["ndist"] if extra else []), last)


def pivoted(long: DataFrame, point: str, field: str, fields: list[str], stats: list[str]) -> DataFrame:
    """One row for each point, a column <stat>_<field> for each statistic and field."""
    aggs = [F.max(F.when(F.col(field) == f, F.col(s))).alias(f"{s}_{f}") for f in fields for s in stats]
    return long.groupBy(point).agg(*aggs)


def weighted_median(samples: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """Lowest value at which the running weight reaches half of the whole; each weight stays with its value."""
    g = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(value.alias("x"), weight.alias("w")))).alias("p"), F.sum(weight).alias("total"))
    return g.select(*keys, middle_weight(F.col("p"), F.col("total")).alias("weighted_median"))


def middle_weight(p: Column, total: Column) -> Column:
    """weighted_median() of a sorted array of structs (x, w) whose weights have this total."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("x"))
    step = lambda acc, p: F.struct((acc["w"] + p["w"]).alias("w"), F.coalesce(acc["x"], F.when(acc["w"] + p["w"] >= total / 2, p["x"])).alias("x"))
    return F.aggregate(p, start, step, lambda acc: acc["x"])


def weighted_mean(samples: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    return samples.groupBy(*keys).agg(ratio(F.sum(value * weight), F.sum(weight)).alias("weighted_mean"))
