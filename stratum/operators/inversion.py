"""A run from parameters and tables to saved chains: the problem's assembly, the sampler, and what is kept of it.

The node table of all rays, with the observations, is what every chain needs whole: it is counted, and goes from a
table to each chain's task, not through the driver. Chains are what Spark spreads; everything saved is tables.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.anisotropy import tracing_velocity
from stratum.functions.geo import EARTH_RADIUS, to_cartesian, to_geographic
from stratum.operators import forward, graph, sampler
from stratum.operators import rays as ray_nodes
from stratum.operators.index import dimension, shuffled
from stratum.operators.interpolate import reference_values
from stratum.operators.moments import finished, reciprocal
from stratum.operators.nearest import nearest_cell_sums, nearest_cells
from stratum.operators.select import cold, drop_burn_in, in_box
from stratum.sources import chains as saved
from stratum.sources.config import Config, check, to_json
from stratum.store import stored

#: Most nodes of all rays together that a run gathers (about 100 bytes each).
MOST_NODES = 20_000_000
RAY = ["observable", "event_id", "station_id", "ray_id"]
NODE = ("vp1d", "vs1d", "azimuth", "elevation", "polarization", "seg_len", "lat", "lon", "r")


class Named:
    """A registered forward function as the sampler calls it."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, values: dict[str, np.ndarray], columns: dict[str, np.ndarray]) -> np.ndarray:
        return forward.slowness(self.name, {**columns, **values})


def ray_rows(nodes: DataFrame, observations: DataFrame, forwards: dict[str, str], references: DataFrame | None = None) -> DataFrame:
    """A row for each observed ray, with the numbers of its nodes in one array: what rays_of() takes. Arguments as for build_rays(). Neither nodes nor rays are broadcast."""
    own = observations.where(F.col("obs_name").isin(list(forwards))).withColumn("value", F.col("value").cast("double"))
    if references is not None:
        own = own.join(shuffled(references.select("ray_id", "ref_t")), "ray_id", "left").withColumn("ref_t", F.coalesce("ref_t", F.lit(0.0)))
    else:
        own = own.withColumn("ref_t", F.lit(0.0))
    n = nodes
    if "lat" not in nodes.columns:
        n = n.withColumns(dict(zip(("lat", "lon", "r"), to_geographic(F.col("x"), F.col("y"), F.col("z")), strict=True)))
    number = F.create_map(*(F.lit(x) for pair in enumerate(forwards) for x in reversed(pair)))[F.col("obs_name")]
    rows = own.withColumn("observable", number.cast("long")).join(shuffled(n.select("ray_id", "node_ix", *NODE)), "ray_id").withColumn("seg_len", F.coalesce("seg_len", F.lit(0.0)))
    numbers = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in NODE))
    rows = rows.groupBy(*RAY).agg(F.min(F.struct("value", "ref_t")).alias("_head"), F.sort_array(F.collect_list(F.struct("node_ix", numbers.alias("numbers")))).alias("_nodes"))
    rows = stored(rows.select(*RAY, "_head.*", F.flatten(F.transform("_nodes", lambda x: x["numbers"])).alias("nodes")))
    total = rows.agg(F.sum(F.size("nodes"))).first()[0] or 0
    total //= len(NODE)
    if total > MOST_NODES:
        raise ValueError(f"{total} nodes: a run takes {MOST_NODES} at most")
    return rows


def rays_of(rows: pd.DataFrame, forwards: dict[str, str]) -> sampler.Rays:
    """ray_rows() as arrays."""
    head = rows.sort_values(RAY, kind="stable")
    size = np.array([len(x) for x in head["nodes"]], np.int64) // len(NODE)
    first = np.cumsum(size) - size
    numbers = np.concatenate([np.empty(0), *head["nodes"]]).reshape(-1, len(NODE))
    timed = np.array([f.startswith("tt_") for f in forwards.values()])[head["observable"].to_numpy(np.int64)]
    observed = head["value"].to_numpy(float) + np.where(timed, head["ref_t"].to_numpy(float), 0.0)
    columns = {c: numbers[:, i].copy() for i, c in enumerate(NODE)}
    return sampler.Rays(columns, first, observed, tuple(map(Named, forwards.values())), head["observable"].to_numpy(np.int64), head["event_id"].to_numpy(), head["station_id"].to_numpy())


def build_rays(nodes: DataFrame, observations: DataFrame, forwards: dict[str, str], references: DataFrame | None = None) -> sampler.Rays:
    """Rays of observations (obs_name, ray_id, event_id, station_id, value) over a node table (ray_id, node_ix, x, y, z, columns of NODE). forwards: the forward function of each observable. references: (ray_id, ref_t), which travel times are relative to. A ray of two observables counts for each; observations without nodes are left out."""
    return rays_of(ray_rows(nodes, observations, forwards, references).toPandas(), forwards)


def build_fields(config: Config, squeeze: bool = False) -> tuple[sampler.Field, ...]:
    """Sampled fields of a configuration: angles in degrees and elevations in km become radians and radii. vlims: low and high, then mean and deviation of priors that have them."""
    out = []
    for p in config.parameters:
        low, high, *more = p.vlims
        mean, sd = (*more, 0.0, 1.0)[:2] if more else (0.0, 1.0)
        lat, lon = (tuple(map(math.radians, x)) for x in (p.theta_lims, p.phi_lims))
        out.append(sampler.Field(p.name, low, high, lat, lon, tuple(EARTH_RADIUS + x for x in p.r_lims), p.prior, mean, sd, p.extrapolation if squeeze else None))
    return tuple(out)


def build_settings(config: Config, rays: sampler.Rays | None) -> tuple[sampler.Settings, dict]:
    """Settings, and arguments of sampler.run(), from the sections of a configuration; what a section lacks keeps its default."""
    m, dr, pt, sc = (config.sections.get(k, {}) for k in ("MonteCarloSolver", "DelayedRejection", "ParallelTempering", "StaticCorrections"))
    statics = any(o.event_statics_id or o.station_statics_id for o in config.observables)
    damping = float(sc.get("static_damping", 0.0)) if any(o.station_statics_id for o in config.observables) else None
    tempered = bool(pt.get("tf_parallel_tempering", False))
    s = sampler.Settings(
        iterations=int(m.get("num_iterations", 1000)),
        save_every=int(m.get("save_interval", 100)),
        step=float(m.get("pert_size", 0.05)),
        nuclei=(int(m.get("init_dim", 5)), int(m.get("max_dim", 50))),
        log_uniform_count=m.get("dim_prior", "uniform") == "log-uniform",
        value_only=int(m.get("vpert_iterations", 0)),
        noise_guess=tuple(o.noise_guess for o in config.observables if o.forward_name) or 1.0,
        sample_noise=bool(m.get("tf_hierarchical", False)),
        norm=float(m.get("LX_norm", 2)),
        rescale=float(dr.get("rescale_value", 4)) if dr.get("tf_delayed_rejection", False) else None,
        rays=rays,
        fields=build_fields(config, bool(m.get("tf_squeeze", False))),
        hot_steps=tempered and bool(pt.get("tf_increase_pert", False)),
        statics=(int(sc.get("static_start", 1)), int(sc.get("static_interval", 1000)), damping) if statics else None,
    )
    chains = int(m.get("num_chains", 4))
    more = {"chains": chains}
    if tempered:
        more |= {"cold": int(pt.get("num_cold", 1)), "hottest": float(pt.get("max_temp", 1.0)), "swap_every": int(pt.get("swap_interval", 1000)), "swap_from": int(pt.get("swap_start", 0))}
    return s, more


def demeaned(rays: sampler.Rays, fields: tuple[sampler.Field, ...], kinds: list[int]) -> sampler.Rays:
    """Rays whose observed values of some observables are less the mean residual of their event, against the model without perturbations (each field 0, or the middle of limits that don't hold 0)."""
    values = {f.name: np.full(len(rays.ray), 0.0 if f.low <= 0 <= f.high else (f.low + f.high) / 2) for f in fields}
    residual = rays.observed - rays.integrals(rays.slow(values, np.arange(len(rays.ray))), np.arange(len(rays.first)))
    observed = rays.observed.copy()
    for k in kinds:
        own = (rays.kind == k).nonzero()[0]
        if len(own):
            _, e = np.unique(rays.event[own], return_inverse=True)
            observed[own] -= (np.bincount(e, residual[own]) / np.bincount(e))[e]
    return replace(rays, observed=observed)


def demeaned_residuals(observations: DataFrame, predictions: DataFrame, value: str = "value") -> DataFrame:
    """Observations less the mean residual of their event and observable, as a run starts with where an observable asks for it. predictions: (obs_name, ray_id, predicted)."""
    r = observations.join(predictions, ["obs_name", "ray_id"])
    means = r.groupBy("obs_name", "event_id").agg(F.avg(F.col(value) - F.col("predicted")).alias("mean_residual"))
    out = observations.join(means, ["obs_name", "event_id"], "left").withColumn(value, F.col(value) - F.coalesce("mean_residual", F.lit(0.0)))
    return out.select(*observations.columns)


def run(spark: SparkSession, config: Config, nodes: DataFrame, observations: DataFrame, references: DataFrame | None = None, path: str | None = None, chunk: int = 1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(models, nuclei) of a chunk of chains, from a configuration, the node table of its rays and the observations; saved under path with the configuration, if given. Chains of further chunks get further numbers."""
    check(config, set(forward.REGISTRY))
    forwards = {o.name: o.forward_name for o in config.observables if o.forward_name}
    rows = ray_rows(nodes, observations, forwards, references)
    wanted = [k for k, o in enumerate(o for o in config.observables if o.forward_name) if o.demean]
    s, more = build_settings(config, None)
    fields = build_fields(config)

    def made(nodes_: pd.DataFrame) -> sampler.Rays:
        rays = rays_of(nodes_, forwards)
        return demeaned(rays, fields, wanted) if wanted else rays

    def counts() -> np.ndarray:
        own = rows.groupBy("observable").count().collect()
        return np.bincount([r["observable"] for r in own], [r["count"] for r in own], len(forwards))

    models, cells = sampler.run(spark, s, seed=seed * 1000 + chunk, **more, rays=(rows, made, counts))
    number = F.col("chain") + more["chains"] * (chunk - 1)
    models, cells = models.withColumn("chain", number), cells.withColumn("chain", number)
    if path is not None:
        saved.save({"models": models, "cells": cells}, path, "append")
        if chunk == 1:  # what all chunks share
            saved.save({"nodes": nodes, "observations": observations}, path, "overwrite")
            spark.createDataFrame([(to_json(config),)], "config string").write.mode("overwrite").text(f"{path}/config")
    return models, cells


def trace(grid: DataFrame, counts: tuple[int, int, int], velocities: dict[str, str], rays: DataFrame, events: DataFrame, stations: DataFrame, from_events: bool, knots: DataFrame, reach: int = 1, carve_about: tuple[float, float] | None = None, spacing: float | None = None) -> DataFrame:
    """Node table (see rays.build) of rays (ray_id, event_id, station_id, phase) traced through a lattice. events, stations: (id, node_ix, lat, lon) with their nodes; trees grow from one kind of them. carve_about: only nodes in the hull of all events and stations, in the gnomonic plane about this place, let rays through."""
    if carve_about is not None:
        places = events.select("lat", "lon").unionByName(stations.select("lat", "lon"))
        grid = graph.carved(grid, places, *carve_about)
        grid = grid.withColumns({c: F.when(F.col("inside"), F.col(c)).otherwise(0.0) for c in set(velocities.values())})
    ends = {"event_id": events, "station_id": stations}
    own = rays.select("ray_id", "phase", "event_id", "station_id")
    for name, table in ends.items():
        own = own.join(dimension(table.select(F.col("id").alias(name), F.col("node_ix").alias(f"{name}_node"))), name)
    source, receiver = ("event_id_node", "station_id_node") if from_events else ("station_id_node", "event_id_node")
    pairs = own.select(F.col(source).cast("long").alias("source"), "phase", F.col(receiver).cast("long").alias("receiver"))
    paths = graph.traced(grid, pairs.distinct(), counts, velocities, reach)
    last = paths.groupBy("source", "phase", "receiver").agg(F.max("seq").alias("last"))
    # rays run from event to station: paths lead from a receiver back to its source
    order = F.col("last") - F.col("seq") if from_events else F.col("seq")
    keyed = own.select("ray_id", "phase", F.col(source).cast("long").alias("source"), F.col(receiver).cast("long").alias("receiver"))
    nodes = paths.join(shuffled(last), ["source", "phase", "receiver"]).withColumn("at", order).join(shuffled(keyed), ["source", "phase", "receiver"])
    nodes = nodes.join(shuffled(grid.select("node_ix", "x", "y", "z")), "node_ix").select("ray_id", F.col("at").alias("node_ix"), "x", "y", "z", F.lit(0.0).alias("t"))
    return ray_nodes.build(nodes, knots, spacing)


def ensemble_velocities(models: DataFrame, cells: DataFrame, grid: DataFrame, config: Config, knots: DataFrame, num_burn: int = 0) -> DataFrame:
    """grid with vp and vs: harmonic means over the saved models of cold chains, from the reference velocities (knots: radius, vp, vs) and the sampled fields at each node."""
    kept = drop_burn_in(cold(models).select("chain", "iteration"), ["chain"], ["iteration"], num_burn)
    c = with_places(cells.join(kept, ["chain", "iteration"], "left_semi"))
    fields = build_fields(config)
    wide = None
    for f in fields:
        coords = ["r"] if f.radial else ["x", "y", "z"]
        near = nearest_cells(grid.select("node_ix", *coords), c.where(F.col("field") == f.name), ["chain", "iteration"], coords, point="node_ix").select("node_ix", "chain", "iteration", F.col("v").alias(f.name))
        wide = near if wide is None else wide.join(near, ["node_ix", "chain", "iteration"])
    reference = reference_values(grid, knots, "r", "radius", ["vp", "vs"])
    samples = wide.join(reference.select("node_ix", "vp", "vs"), "node_ix")
    p, s = tracing_velocity({f.name for f in fields}, F.col("vp"), F.col("vs"))
    samples = samples.select("node_ix", p.alias("p"), s.alias("s"))
    means = samples.groupBy("node_ix").agg(*(reciprocal(F.avg(reciprocal(F.col(a)))).alias(b) for a, b in (("p", "vp"), ("s", "vs"))))
    return grid.join(means, "node_ix")


def retrace(models: DataFrame, cells: DataFrame, grid: DataFrame, counts: tuple[int, int, int], config: Config, knots: DataFrame, rays: DataFrame, events: DataFrame, stations: DataFrame, from_events: bool, num_burn: int = 0, **more) -> DataFrame:
    """Node table of rays traced anew in the velocities of the ensemble so far; a run goes on with it."""
    now = stored(ensemble_velocities(models, cells, grid, config, knots, num_burn))
    return trace(now, counts, {"P": "vp", "S": "vs"}, rays, events, stations, from_events, knots, **more)


def with_places(cells: DataFrame) -> DataFrame:
    """Nuclei with Cartesian coordinates."""
    return cells.withColumns(dict(zip("xyz", to_cartesian(F.col("lat"), F.col("lon"), F.col("r")), strict=True)))


def ensemble(models: DataFrame, cells: DataFrame, grid: DataFrame, config: Config, num_burn: int = 0, squeeze: bool = False) -> DataFrame:
    """(node_ix, field, n, mean, sd, skewness): moments at every node of a lattice over all saved models after burn-in. Outside a field's limits squeezed values are its extrapolation value."""
    kept = drop_burn_in(models.select("chain", "iteration"), ["chain"], ["iteration"], num_burn)
    c = with_places(cells.join(kept, ["chain", "iteration"], "left_semi"))
    out = None
    for f in build_fields(config, squeeze):
        own = c.where(F.col("field") == f.name)
        coords = ["r"] if f.radial else ["x", "y", "z"]
        sums = nearest_cell_sums(grid.select("node_ix", *coords), own, ["chain", "iteration"], coords, [], point="node_ix")
        if f.outside is not None:  # all samples of a node outside the field's limits are the same
            inside = in_box(F.col("lat"), F.col("lon"), F.col("r"), {"lat": f.lat, "lon": f.lon, "r": f.r})
            sums = sums.join(grid.select("node_ix", "lat", "lon", "r"), "node_ix").withColumns({f"s{i}": F.when(inside, F.col(f"s{i}")).otherwise(F.col("n") * float(f.outside) ** i) for i in (1, 2, 3)})
        one = finished(sums, ["node_ix"]).withColumn("field", F.lit(f.name))
        out = one if out is None else out.unionByName(one)
    return out
