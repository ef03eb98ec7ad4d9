"""Order statistics of groups of any size, from counts of distinct values: no array of samples and no group in one task.

runs() counts equal samples before it shuffles, sorts the distinct values by range over all groups, and gives each the position of its first sample.
A statistic then asks for the values at given positions: questions and values meet in ranges of positions, where one passes the other in order. The results equal those
of order_stats, which holds a group's samples in one array and suits groups of up to some hundred thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators import order_stats
from stratum.operators.select import fresh
from stratum.store import drop_stored, stored


def equal_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of a row for each group, null keys alike."""
    if not keys:
        return a.join(b, F.lit(True), how)
    on, names = F.lit(True), {k: f"_r_{k}" for k in keys}
    for k, name in names.items():
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`{name}`"))
    return a.join(b.withColumnsRenamed(names), on, how).drop(*names.values())


def runs(samples: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, v, c, at, n, first): each distinct value of a group with its count, the position (from 0) of its first sample in the group, the group's size, and where the group starts among all samples. Nulls and NaN are left out."""
    counts = samples.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").withColumn("v", F.col("v") + 0.0).groupBy(*keys, "v").agg(F.count("*").alias("c"))
    part, low, begin, here = (fresh(counts, x) for x in ("_part", "_low", "_begin", "_here"))
    ranged = stored(counts.repartitionByRange(*keys, "v").withColumn(part, F.spark_partition_id()))
    # of a group and a range a row: where groups start follows from these, without the values
    pieces = stored(ranged.groupBy(part, *keys).agg(F.sum("c").alias("_c")))
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low_of = F.broadcast(pieces.groupBy(part).agg(F.sum("_c").alias("_c")).select(part, before(Window.orderBy(part)).alias(low)))
    starts = pieces.withColumn(begin, before(Window.partitionBy(part).orderBy(*keys)) if keys else F.lit(0)).join(low_of, part).withColumn(begin, F.col(begin) + F.col(low))
    groups = starts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min(begin).alias("first"))
    inside = Window.partitionBy(part).orderBy(*keys, "v").rowsBetween(Window.unboundedPreceding, -1)
    at = ranged.withColumn(here, F.coalesce(F.sum("c").over(inside), F.lit(0))).join(low_of, part).withColumn(here, F.col(here) + F.col(low))
    out = stored(equal_join(at, groups, keys).select(*keys, "v", "c", (F.col(here) - F.col("first")).alias("at"), "n", "first"))
    drop_stored(ranged)
    return out


def at_positions(run: DataFrame, asked: DataFrame, position: str, name: str) -> DataFrame:
    """asked with the value at a position (among all samples: first + place in the group). Questions and values are dealt to ranges of positions, and each takes the last value that begins at or before it; the first of a range looks to the ranges before."""
    pos, kind, part, own, carry = (fresh(asked, x) for x in ("_pos", "_kind", "_part", "_own", "_carry"))
    values = run.select((F.col("first") + F.col("at")).alias(pos), F.lit(0).alias(kind), F.struct("v").alias(own), F.lit(None).cast(asked.schema.simpleString()).alias("_q"))
    questions = asked.select(F.col(position).cast("long").alias(pos), F.lit(1).alias(kind), F.lit(None).cast("struct<v:double>").alias(own), F.struct(*asked.columns).cast(asked.schema.simpleString()).alias("_q"))
    both = stored(values.unionAll(questions).repartitionByRange(pos, kind).withColumn(part, F.spark_partition_id()))
    here = Window.partitionBy(part).orderBy(pos, kind)
    tops = both.groupBy(part).agg(F.max(F.when(F.col(kind) == 0, F.struct(F.col(pos).alias("p"), F.col(own).alias("o")))).alias("_top"))
    before = tops.select(part, F.last("_top.o", True).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(carry))
    found = both.withColumn(own, F.last(own, True).over(here)).join(F.broadcast(before), part).where(F.col(kind) == 1)
    return found.select("_q.*", F.coalesce(own, carry)["v"].alias(name))


def summary(run: DataFrame, keys: list[str], levels: dict[str, float], **more: Column) -> DataFrame:
    """(keys, n, a column for each level, more): quantiles by linear interpolation between the order statistics, and further aggregates of the runs, in one pass."""
    n = F.col("n")
    h = lambda q: (n - 1) * F.lit(float(q))
    # a value answers the positions that lie in its own run: no search
    low = {name: F.floor(h(q)) for name, q in levels.items()}
    inside = lambda p: (F.col("at") <= p) & (p < F.col("at") + F.col("c"))
    aggs = []
    for name in levels:
        aggs += [F.max(F.when(inside(low[name]), F.col("v"))).alias(f"_a_{name}"), F.max(F.when(inside(F.least(low[name] + 1, n - 1)), F.col("v"))).alias(f"_b_{name}")]
    g = run.groupBy(*keys).agg(F.max("n").alias("n"), *aggs, *(c.alias(name) for name, c in more.items()))
    return g.select(*keys, "n", *((F.col(f"_a_{name}") + (h(q) - low[name]) * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).alias(name) for name, q in levels.items()), *more)


def quantiles(run: DataFrame, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """(keys, a column for each level): linear interpolation between the order statistics."""
    return summary(run, keys, levels).drop("n")


def densest_interval(run: DataFrame, keys: list[str], level: float, low: str = "hdi_lo", high: str = "hdi_hi") -> DataFrame:
    """(keys, low, high): the narrowest window with floor(level * n) samples; of equally narrow ones the first. Of windows that begin in one run of equal values the first is narrowest."""
    m = F.greatest(F.lit(1), F.floor(F.lit(level) * F.col("n")))
    starts = run.select(*keys, F.col("v").alias("_lo"), F.col("at").alias("_at"), (F.col("first") + F.col("at") + m - 1).alias("_end"), (F.col("at") + m <= F.col("n")).alias("_fits")).where("_fits").drop("_fits")
    # a window ends at place m - 1 or later: values before can't be asked for
    ends = at_positions(run.where(F.col("at") + F.col("c") >= m), starts, "_end", "_hi")
    best = F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("width"), F.col("_at"), F.col("_lo"), F.col("_hi"))).alias("_best")
    return ends.groupBy(*keys).agg(best).select(*keys, F.col("_best._lo").alias(low), F.col("_best._hi").alias(high))


def width_of(q25: Column, q75: Column, n: Column) -> Column:
    """Freedman-Diaconis width, to nine decimals."""
    return F.round(2 * (q75 - q25) / F.cbrt(n.cast("double")), 9)


def widths(run: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, w, q50): Freedman-Diaconis width and the median."""
    q = summary(run, keys, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.select(*keys, width_of(F.col("q25"), F.col("q75"), F.col("n")).alias("w"), "q50")


def binned_mode(run: DataFrame, keys: list[str], width: DataFrame | None = None) -> DataFrame:
    """(keys, mode): centre of the fullest bin; of equally full ones the lowest; the median without a width. width: widths() where they are known."""
    binned = equal_join(run, widths(run, keys) if width is None else width, keys).withColumn("_bin", F.when(F.col("w") > 0, F.rint(F.col("v") / F.when(F.col("w") > 0, F.col("w")))))
    counts = binned.groupBy(*keys, "_bin").agg(F.sum("c").alias("_c"), F.max("w").alias("w"), F.max("q50").alias("q50"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("_bin").alias("bin"))).alias("_b"), F.max("w").alias("w"), F.max("q50").alias("q50"))
    return best.select(*keys, F.coalesce(F.col("_b.bin") * F.col("w"), F.col("q50")).alias("mode"))


def hellinger_uniform(run: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, hval): distance from a uniform prior on [low, high]."""
    bins = F.rint(F.sqrt(F.col("n").cast("double")))
    place = F.greatest(F.ceil((F.col("v") - low) / ((high - low) / bins)) - 1, F.lit(0).cast("long"))
    c = run.groupBy(*keys, "n", place.alias("_bin")).agg(F.sum("c").alias("_c"))
    total = F.sqrt(1 / bins) * F.col("_s") / F.sqrt(F.col("n").cast("double"))
    return c.groupBy(*keys, "n").agg(F.sum(F.sqrt(F.col("_c").cast("double"))).alias("_s")).select(*keys, F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - total))).alias("hval"))


def uniform_gap(low: float, high: float) -> Column:
    """Largest distance of a run from a uniform distribution: of equal values only the ends count."""
    u = (F.col("v") - low) / (high - low)
    return F.greatest(F.abs(F.col("at") / F.col("n") - u), F.abs((F.col("at") + F.col("c")) / F.col("n") - u))


def kolmogorov_uniform(run: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, ks): largest distance between the samples' distribution and a uniform one."""
    return run.groupBy(*keys).agg(F.max(uniform_gap(low, high)).alias("ks"))


def tendencies(samples: DataFrame, keys: list[str], value: Column, low: float, high: float, level: float = 0.9, quantile_levels: tuple[float, ...] = (0.25, 0.75), kolmogorov: bool = False) -> DataFrame:
    """The columns of order_stats.tendencies (without distances) for groups of any size. kolmogorov: with kolmogorov_uniform() (ks) of the same runs."""
    run = runs(samples, keys, value)
    tail = (1 - level) / 2
    levels = {"median": 0.5, **{f"q{i}": q for i, q in enumerate(quantile_levels, 1)}, "mi_lo": tail, "mi_hi": 1 - tail, "lhi_a": level, "lhi_b": 1 - level}
    more = {"mean": F.sum(F.col("v") * F.col("c")) / F.sum("c")} | ({"ks": F.max(uniform_gap(low, high))} if kolmogorov else {})
    found = stored(summary(run, keys, levels | {"_q25": 0.25, "_q75": 0.75}, **more))
    width = found.select(*keys, width_of(F.col("_q25"), F.col("_q75"), F.col("n")).alias("w"), F.col("median").alias("q50"))
    out = found.select(*keys, "mean", *levels)
    for part in (densest_interval(run, keys, level), hellinger_uniform(run, keys, low, high), binned_mode(run, keys, width)):
        out = equal_join(out, part, keys)
    return equal_join(out, found.select(*keys, "ks"), keys) if kolmogorov else out


def either(samples: DataFrame, keys: list[str], value: Column, low: float, high: float, level: float = 0.9, most: int = 200_000) -> DataFrame:
    """tendencies() by arrays for groups of up to `most` samples, by counts for larger ones."""
    sizes = stored(samples.groupBy(*keys).agg(F.count("*").alias("_size")))
    large = sizes.where(F.col("_size") > most).drop("_size")
    if large.isEmpty():
        return order_stats.tendencies(samples, keys, value, low, high, level)
    small = order_stats.tendencies(equal_join(samples, large, keys, "left_anti"), keys, value, low, high, level)
    return small.unionByName(tendencies(equal_join(samples, large, keys, "left_semi"), keys, value, low, high, level))
