"""Grid-search location of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.moments import ratio


def candidates(events: DataFrame, grid: DataFrame, half_width: int) -> DataFrame:
    """(event_id, node_ix): nodes within half_width + 1 places of the event's own node (i, j, k) along every axis. Places are generated from the event and found by an equi-join, so no event meets the whole grid."""
    w = half_width + 1
    span = F.sequence(F.lit(-w), F.lit(w))
    e = events.select("event_id", "i", "j", "k").withColumn("di", F.explode(span)).withColumn("dj", F.explode(span)).withColumn("dk", F.explode(span))
    e = e.select("event_id", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("k") + F.col("dk")).alias("k"))
    return e.join(grid.select("node_ix", "i", "j", "k"), ["i", "j", "k"]).select("event_id", "node_ix")


def scored(arrivals: DataFrame, nodes: DataFrame, times: DataFrame, sigma: Column | None = None) -> DataFrame:
    """(event_id, node_ix, shift, misfit, error): arrivals (event_id, station_id, phase, observed, sigma), candidate nodes, times (station_id, phase, node_ix, time). The shift of origin time is the weighted mean residual; misfit sums squared scaled residuals after it."""
    s = F.col("sigma") if sigma is None else sigma
    a = arrivals.select("event_id", "station_id", "phase", F.col("observed").alias("o"), (1 / (s * s)).alias("w"))
    both = F.when(F.col("o").isNotNull(), F.col("w"))
    # arrivals of one event, station and phase have one time at a node: their sums meet the nodes, not they; squares are about means, so that nothing cancels
    sums = {"n": F.count("*"), "sw": F.sum("w"), "wo": F.sum(both), "swo": F.sum(F.col("w") * F.col("o")), "swoo": F.sum(F.col("w") * F.col("o") * F.col("o")), "no": F.count("o"), "so": F.sum("o"), "soo": F.sum(F.col("o") * F.col("o"))}
    a = a.groupBy("event_id", "station_id", "phase").agg(*(c.alias(name) for name, c in sums.items()))
    about = lambda square, total, number: F.greatest(F.lit(0.0), square - total * ratio(total, number))
    r = a.join(nodes, "event_id").join(times, ["station_id", "phase", "node_ix"])
    c, t = F.col, F.col("time")
    wr, mean, plain = c("swo") - t * c("wo"), ratio(c("swo"), c("wo")) - t, ratio(c("so"), c("no")) - t
    wrr = about(c("swoo"), c("swo"), c("wo")) + c("wo") * mean * mean
    rr = about(c("soo"), c("so"), c("no")) + c("no") * plain * plain
    r = r.select("event_id", "node_ix", "n", "sw", wr.alias("wr"), wrr.alias("wrr"), (c("so") - t * c("no")).alias("r"), F.when(c("no") > 0, rr).alias("rr"))
    g = r.groupBy("event_id", "node_ix").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"), F.sum("wr").alias("swr"), F.sum("wrr").alias("swrr"), F.sum("r").alias("sr"), F.sum("rr").alias("srr"))
    shift = ratio(F.col("swr"), F.col("sw"))
    g = g.withColumn("shift", shift)
    misfit = F.greatest(F.lit(0.0), F.col("swrr") - F.col("shift") * F.col("swr"))
    square = F.col("srr") - 2 * F.col("shift") * F.col("sr") + F.col("n") * F.col("shift") * F.col("shift")
    return g.select("event_id", "node_ix", "shift", misfit.alias("misfit"), F.sqrt(F.greatest(F.lit(0.0), square) / F.col("n")).alias("error"))


def located(scores: DataFrame) -> DataFrame:
    """The best node of each event; of those equal to six decimals the lowest."""
    best = F.min(F.struct(F.round("misfit", 6).alias("m"), "node_ix", "shift", "misfit", "error")).alias("b")
    return scores.groupBy("event_id").agg(best).select("event_id", "b.node_ix", "b.shift", "b.misfit", "b.error")


def relocated(events: DataFrame, arrivals: DataFrame, grid: DataFrame, times: DataFrame, half_width: int) -> tuple[DataFrame, DataFrame]:
    """Events at their best nodes with shifted origin times, and arrivals with the shift taken off."""
    best = located(scored(arrivals, candidates(events, grid, half_width), times))
    new = events.drop("i", "j", "k", "lat", "lon", "r").join(best, "event_id").join(grid.select("node_ix", "i", "j", "k", "lat", "lon", "r"), "node_ix").withColumn("t0", F.col("t0") + F.col("shift"))
    return new, arrivals.join(best.select("event_id", "shift"), "event_id").withColumn("observed", F.col("observed") - F.col("shift")).drop("shift")


def due(iteration: int, initial: bool, first: int, interval: int) -> bool:
    """Whether events are relocated at an iteration."""
    return (iteration == 0 and initial) or (iteration >= first and iteration % interval == 0)
