"""Reversible-jump sampling of cellular models: a chain is sequential, so chains are what Spark spreads.

Each chain is one row with its state; a segment of iterations maps that row to a row for each saved model and one for
the state after it. Each segment is stored, so no row grows with the number of iterations and a lost executor costs
a segment; the driver swaps temperatures between segments from one small row a chain. A model is a set of nuclei for
each field; a point has the value of its nearest nucleus. A proposal predicts anew only the rays of those nodes whose
nucleus or value it changes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.session import ship
from stratum.store import stored

VALUE, MOVE, BIRTH, DEATH, NOISE = 1, 2, 3, 4, 5
#: Iterations after which a chain's state is stored, if nothing else asks for it.
SEGMENT = 20_000
#: Most event and station statics that one solve takes (a dense matrix of 8 n^2 bytes).
MOST_STATICS = 5_000
LOG_ROOT_2PI = math.log(math.sqrt(2 * math.pi))


@dataclass(frozen=True)
class Field:
    """A sampled field: prior uniform, normal, right-half-normal or left-half-normal; limits in radians and km."""

    name: str
    low: float
    high: float
    lat: tuple[float, float]
    lon: tuple[float, float]
    r: tuple[float, float]
    prior: str = "uniform"
    mean: float = 0.0
    sd: float = 1.0
    #: Value of nodes outside the limits; None: they take the nearest nucleus's value.
    outside: float | None = None

    @property
    def radial(self) -> bool:
        return self.lat[0] == self.lat[1] and self.lon[0] == self.lon[1]

    @property
    def fewest(self) -> int:
        return 1 if self.radial else 4


Slowness = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


@dataclass(frozen=True)
class Rays:
    """Nodes of all rays as arrays, ray after ray; first node and observed value of each ray.

    slowness maps (field values, columns) of some nodes to their slowness, each node's from its own values alone; one
    function, or one for each observable, with observable the number of each ray's. event, station: of each ray, for
    statics.
    """

    columns: dict[str, np.ndarray]
    first: np.ndarray
    observed: np.ndarray
    slowness: Slowness | tuple[Slowness, ...]
    observable: np.ndarray | None = None
    event: np.ndarray | None = None
    station: np.ndarray | None = None

    @cached_property
    def size(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.columns["seg_len"])))

    @cached_property
    def ray(self) -> np.ndarray:
        """Ray of each node."""
        return np.repeat(np.arange(len(self.first)), self.size)

    @cached_property
    def kind(self) -> np.ndarray:
        """Observable of each ray."""
        return np.zeros(len(self.first), np.int64) if self.observable is None else self.observable

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(self.kind, minlength=len(self.functions))

    @property
    def functions(self) -> tuple[Slowness, ...]:
        return self.slowness if isinstance(self.slowness, tuple) else (self.slowness,)

    @cached_property
    def places(self) -> np.ndarray:
        return np.stack([self.columns[c] for c in ("lat", "lon", "r")], 1)

    @cached_property
    def points(self) -> np.ndarray:
        return cartesian(self.places)

    def inside(self, f: Field) -> np.ndarray:
        """Whether each node is within the field's limits (equal limits hold everything)."""
        low, high = box(f)
        return ((self.places >= low) & (self.places <= high) | (low == high)).all(1)

    def slow(self, values: dict[str, np.ndarray], nodes: np.ndarray) -> np.ndarray:
        """Slowness of some nodes from the fields' values there."""
        out, kind = np.empty(len(nodes)), self.kind[self.ray[nodes]]
        for k, function in enumerate(self.functions):
            own = kind == k
            if own.any():
                out[own] = function({n: v[own] for n, v in values.items()}, {n: c[nodes[own]] for n, c in self.columns.items()})
        return out

    def integrals(self, u: np.ndarray, rays: np.ndarray) -> np.ndarray:
        """Sums over the segments of some rays; a segment's slowness is the mean of its ends."""
        size = self.size[rays]
        ends = np.cumsum(size)
        start = ends - size
        nodes = np.arange(ends[-1]) + np.repeat(self.first[rays] - start, size)
        mean = (u[nodes] + u[np.minimum(nodes + 1, len(u) - 1)]) / 2 * self.columns["seg_len"][nodes]
        mean[ends - 1] = 0.0
        return np.add.reduceat(mean, start)


@dataclass(frozen=True)
class Settings:
    iterations: int
    save_every: int
    step: float = 0.1
    nuclei: tuple[int, int] = (5, 50)
    log_uniform_count: bool = False
    value_only: int = 0
    noise_guess: float | tuple[float, ...] = 1.0
    sample_noise: bool = False
    norm: float = 2.0
    rescale: float | None = None
    rays: Rays | None = None
    fields: tuple[Field, ...] = field(default_factory=tuple)
    #: Steps of hotter chains grow with the root of their temperature.
    hot_steps: bool = False
    #: (first iteration, interval, damping of station statics or None for event statics alone).
    statics: tuple[int, int, float | None] | None = None

    @property
    def guesses(self) -> np.ndarray:
        n = len(self.rays.functions) if self.rays else 1
        return np.broadcast_to(np.asarray(self.noise_guess, float), n).copy()


def cartesian(place: np.ndarray) -> np.ndarray:
    """x, y, z of rows (lat, lon, r)."""
    lat, lon, r = place.T
    return np.stack([r * np.cos(lat) * np.cos(lon), r * np.cos(lat) * np.sin(lon), r * np.sin(lat)], 1)


def draw(f: Field, n: int, rng: np.random.Generator) -> np.ndarray:
    if f.prior == "uniform":
        return rng.uniform(f.low, f.high, n)
    v = rng.normal(0, f.sd, n)
    return f.mean + (v if f.prior == "normal" else np.abs(v) if f.prior == "right-half-normal" else -np.abs(v))


def box(f: Field) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([x[k] for x in (f.lat, f.lon, f.r)]) for k in (0, 1))


def allowed(f: Field, v: float) -> bool:
    """A normal prior has no limits, a half-normal one its half-line, a uniform one its range."""
    return {"uniform": f.low <= v <= f.high, "normal": True, "right-half-normal": v >= f.mean, "left-half-normal": v <= f.mean}[f.prior]


def log_density(f: Field, v: float) -> float:
    """Log of the prior of a value, times the range (so a uniform one is 0)."""
    if f.prior == "uniform":
        return 0.0
    return math.log(f.high - f.low) - LOG_ROOT_2PI - math.log(f.sd) - (v - f.mean) ** 2 / (2 * f.sd**2) + (math.log(2) if f.prior != "normal" else 0.0)


class Chain:
    """State of a chain: nuclei (lat, lon, r) and values of each field, noise of each observable, statics, temperature, counters and random generator; and for every node its nucleus, that one's squared distance, value and slowness, for every ray its prediction."""

    def __init__(self, number: int, s: Settings, temperature: float, seed: int):
        self.rng = np.random.default_rng([seed, number])
        self.number, self.temperature, self.iteration, self.accepted = number, temperature, 0, 0
        self.noise = s.guesses
        self.places, self.values, self.undo = [], [], []
        for f in s.fields:
            n = max(f.fewest, s.nuclei[0])
            low, high = box(f)
            self.places.append(self.rng.uniform(low, high, (n, 3)))
            self.values.append(draw(f, n, self.rng))
        self.misfit = 0.0
        if s.rays is not None:
            self.static = np.zeros(len(s.rays.first))
            self.resume(s)
            self.misfit = self.scored(s, self.predicted)

    def without_nodes(self) -> Chain:
        """The chain without what resume() makes anew, so a state doesn't grow with the nodes."""
        out = copy(self)
        out.near = out.far = out.at = out.u = out.predicted = None
        return out

    def resume(self, s: Settings) -> None:
        if s.rays is not None:
            self.near, self.far, self.at, self.u, self.predicted = self.whole(s)

    def distances(self, f: Field, place: np.ndarray, nuclei: np.ndarray, points: np.ndarray | None = None) -> np.ndarray:
        """Squared distances (of radial fields: distances) of places from nuclei. points: the places' Cartesian coordinates, if they are known."""
        if f.radial:
            return np.abs(place[:, None, 2] - nuclei[None, :, 2])
        a, b = cartesian(place) if points is None else points, cartesian(nuclei)
        x, y, z = (a[:, None, i] - b[None, :, i] for i in range(3))
        return x * x + y * y + z * z

    def nearest(self, f: Field, k: int, place: np.ndarray, points: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest nucleus of each place, the lowest of equally near ones, and its distance. Places are taken in parts, so no large matrix is held."""
        near, far, step = np.empty(len(place), np.int64), np.empty(len(place)), max(1, (1 << 20) // len(self.values[k]))
        for i in range(0, len(place), step):
            d = self.distances(f, place[i : i + step], self.places[k], None if points is None else points[i : i + step])
            near[i : i + step] = own = d.argmin(1)
            far[i : i + step] = d[np.arange(len(d)), own]
        return near, far

    def whole(self, s: Settings) -> tuple:
        """Nuclei, distances and values of all nodes for each field, slowness of all nodes, predictions of all rays: from nothing."""
        near, far, at = [], [], []
        for k, f in enumerate(s.fields):
            n, d = self.nearest(f, k, s.rays.places, s.rays.points)
            v = self.values[k][n]
            if f.outside is not None:
                v = np.where(s.rays.inside(f), v, f.outside)
            near.append(n)
            far.append(d)
            at.append(v)
        u = s.rays.slow({f.name: v for f, v in zip(s.fields, at, strict=True)}, np.arange(len(s.rays.ray)))
        return near, far, at, u, s.rays.integrals(u, np.arange(len(s.rays.first)))

    def scored(self, s: Settings, predicted: np.ndarray) -> float:
        """Sum of scaled absolute residuals to the power of the norm; 0 without rays (the prior is sampled)."""
        if s.rays is None:
            return 0.0
        return float((np.abs((s.rays.observed - self.static - predicted) / self.noise[s.rays.kind]) ** s.norm).sum())

    def misfit_of(self, s: Settings) -> float:
        """The misfit with everything predicted anew; what local updates must come to."""
        return self.scored(s, self.whole(s)[4]) if s.rays is not None else 0.0

    def put(self, array: np.ndarray, at, new) -> None:
        """Change part of an array, and remember what was there."""
        self.undo.append((array, at, array[at].copy()))
        array[at] = new

    def influenced(self, s: Settings, action: int, k: int, i: int) -> np.ndarray:
        """Nodes whose nucleus or value a proposal changes, after their nuclei are set. i: the nucleus."""
        f, near, far, place = s.fields[k], self.near[k], self.far[k], s.rays.places
        own = (near == i).nonzero()[0] if action != BIRTH else np.empty(0, np.int64)
        if action == VALUE:
            return own
        if action == DEATH:
            self.put(near, slice(None), near - (near > i))
            won = np.empty(0, np.int64)
        else:
            d = self.distances(f, place, self.places[k][i][None], s.rays.points)[:, 0]
            won = ((d < far) | (d == far) & (i < near)).nonzero()[0]
            self.put(near, won, i)
            self.put(far, won, d[won])
        if len(own):
            n, d = self.nearest(f, k, place[own], s.rays.points[own])
            self.put(near, own, n)
            self.put(far, own, d)
        return np.union1d(own, won)

    def predict(self, s: Settings, action: int, k: int, i: int) -> None:
        """Predictions after a proposal, of influenced rays only."""
        nodes = self.influenced(s, action, k, i)
        f = s.fields[k]
        if f.outside is not None:
            if not hasattr(self, "held"):
                self.held = [s.rays.inside(g) for g in s.fields]
            nodes = nodes[self.held[k][nodes]]
        if not len(nodes):
            return
        self.put(self.at[k], nodes, self.values[k][self.near[k][nodes]])
        self.put(self.u, nodes, s.rays.slow({g.name: v[nodes] for g, v in zip(s.fields, self.at, strict=True)}, nodes))
        rays = s.rays.ray[nodes]  # in order, as nodes are
        rays = rays[np.r_[True, rays[1:] != rays[:-1]]]
        self.put(self.predicted, rays, s.rays.integrals(self.u, rays))

    def solve_statics(self, s: Settings) -> None:
        """Event statics (mean residuals), or event and damped station statics together, of each observable by least squares."""
        r, damping = s.rays, s.statics[2]
        for k in range(len(r.functions)):
            own = (r.kind == k).nonzero()[0]
            if not len(own):
                continue
            residual = r.observed[own] - self.predicted[own]
            _, e = np.unique(r.event[own], return_inverse=True)
            if damping is None:
                self.static[own] = (np.bincount(e, residual) / np.bincount(e))[e]
                continue
            _, t = np.unique(r.station[own], return_inverse=True)
            n, m = e.max() + 1, t.max() + 1
            if n + m > MOST_STATICS:
                raise ValueError(f"more than {MOST_STATICS} statics: solve for event statics alone (damping None)")
            g = np.diag(np.concatenate([np.bincount(e), np.bincount(t) + damping**-2]).astype(float))
            np.add.at(g, (e, n + t), 1.0)
            np.add.at(g, (n + t, e), 1.0)
            x = np.linalg.lstsq(g, np.concatenate([np.bincount(e, residual), np.bincount(t, residual)]), rcond=None)[0]
            self.static[own] = x[e] + x[n + t]

    def dimension(self, s: Settings, before: int, after: int) -> float:
        return math.log(before) - math.log(after) if s.log_uniform_count else 0.0

    def propose(self, s: Settings, action: int, k: int, step: float, again: int | None = None) -> float:
        """Change nuclei, values or noise; the log term of the acceptance, or -inf for a change that can't be. again: the nucleus that a value or move takes. last: that nucleus and the normal draws; changed: the nucleus."""
        f, rng = s.fields[k], self.rng
        spread = step * (f.high - f.low)
        n = len(self.values[k])
        if action == NOISE:
            o = int(rng.integers(len(self.noise)))
            new = self.noise[o] + step * s.guesses[o] * rng.normal()
            if new <= 0:
                return -math.inf
            term = int(s.rays.counts[o]) * (math.log(self.noise[o]) - math.log(new)) / self.temperature if s.rays else 0.0
            self.noise = self.noise.copy()
            self.noise[o] = new
            return term
        if action == VALUE:
            i, z = rng.integers(n) if again is None else again, rng.normal(size=1)
            self.last, self.changed = (i, z), int(i)
            old, new = self.values[k][i], self.values[k][i] + spread * z[0]
            self.values[k] = self.values[k].copy()
            self.values[k][i] = new
            return log_density(f, new) - log_density(f, old) if allowed(f, new) else -math.inf
        if action == MOVE:
            i, z = rng.integers(n) if again is None else again, rng.normal(size=3)
            self.last, self.changed = (i, z), int(i)
            low, high = box(f)
            new = self.places[k][i] + step * (high - low) * z
            self.places[k] = self.places[k].copy()
            self.places[k][i] = new
            return 0.0 if ((new >= low) & (new <= high) | (low == high)).all() else -math.inf
        proposal = lambda d: LOG_ROOT_2PI + math.log(step) + d * d / (2 * spread * spread)
        if action == BIRTH:
            if n >= s.nuclei[1]:
                return -math.inf
            place = rng.uniform(*box(f))
            old = self.values[k][self.nearest(f, k, place[None])[0][0]]
            self.changed = n
            new = old + spread * rng.normal()
            self.places[k], self.values[k] = np.vstack([self.places[k], place]), np.append(self.values[k], new)
            return self.dimension(s, n, n + 1) + log_density(f, new) + proposal(new - old) if allowed(f, new) else -math.inf
        if n <= f.fewest:
            return -math.inf
        self.changed = i = int(rng.integers(n))
        place, old = self.places[k][i], self.values[k][i]
        self.places[k], self.values[k] = np.delete(self.places[k], i, 0), np.delete(self.values[k], i)
        new = self.values[k][self.nearest(f, k, place[None])[0][0]]
        return self.dimension(s, n, n - 1) - log_density(f, old) - proposal(old - new)

    def keep(self) -> tuple:
        self.undo = []
        return list(self.places), list(self.values), self.noise, self.misfit

    def restore(self, kept: tuple) -> None:
        self.places, self.values, self.noise, self.misfit = list(kept[0]), list(kept[1]), kept[2], kept[3]
        for array, at, old in reversed(self.undo):
            array[at] = old
        self.undo = []

    def score(self, s: Settings, action: int, k: int) -> None:
        if s.rays is not None:
            if action != NOISE:
                self.predict(s, action, k, self.changed)
            self.misfit = self.scored(s, self.predicted)

    def iterate(self, s: Settings) -> None:
        """One iteration: a proposal, and after a rejected value or move one of smaller steps, if settings ask for it; or statics, where they are due."""
        self.iteration += 1
        if s.statics and s.rays and self.iteration >= s.statics[0] and (self.iteration == s.statics[0] or self.iteration % s.statics[1] == 0):
            self.solve_statics(s)
            self.misfit = self.scored(s, self.predicted)
            return
        k = int(self.rng.integers(len(s.fields)))
        action = VALUE if self.iteration <= s.value_only else int(self.rng.integers(1, 5 + s.sample_noise))
        step = s.step * math.sqrt(self.temperature) if s.hot_steps else s.step
        kept, before = self.keep(), self.misfit
        term = self.propose(s, action, k, step)
        first = -math.inf
        if term > -math.inf:
            self.score(s, action, k)
            first = (before - self.misfit) / s.norm / self.temperature + term
            if math.log(self.rng.random()) <= first:
                self.accepted += 1
                return
        tried = self.misfit
        self.restore(kept)
        if s.rescale is None or action > MOVE or term == -math.inf:
            return
        nucleus, one = self.last
        term = self.propose(s, action, k, step / s.rescale, nucleus)
        if term > -math.inf:
            self.score(s, action, k)
            two = self.last[1] / s.rescale
            # chances that the first trial is rejected: from the second one (the way back), and from the state before
            back = -math.expm1(min(0.0, (self.misfit - tried) / s.norm / self.temperature))
            ahead = -math.expm1(min(0.0, first))
            ratio = ((one**2).sum() - ((one - two) ** 2).sum()) / 2
            if back > 0 and math.log(self.rng.random()) <= (before - self.misfit) / s.norm / self.temperature + term + ratio + math.log(back / ahead):
                self.accepted += 1
                return
        self.restore(kept)


def saved(c: Chain, s: Settings) -> tuple[dict, list[dict]]:
    model = {"iteration": c.iteration, "misfit": c.misfit, "temperature": c.temperature, "accepted": c.accepted, "noise": c.noise.tolist()}
    cells = [{"iteration": c.iteration, "field": f.name, "nucleus_ix": i + 1, "lat": p[0], "lon": p[1], "r": p[2], "v": v} for k, f in enumerate(s.fields) for i, (p, v) in enumerate(zip(c.places[k].tolist(), c.values[k].tolist(), strict=True))]
    return model, cells


MODEL = "iteration: long, misfit: double, temperature: double, accepted: long, noise: array<double>"
CELL = "iteration: long, field: string, nucleus_ix: int, lat: double, lon: double, r: double, v: double"
#: A row for each saved model (state null), and one for the state after a segment (model and cells null).
STATE = f"chain int, state binary, misfit double, temperature double, noise array<double>, model struct<{MODEL}>, cells array<struct<{CELL}>>"
COLUMNS = ["chain", "state", "misfit", "temperature", "noise", "model", "cells"]


def model_row(c: Chain, s: Settings) -> tuple:
    return c.number, None, None, None, None, *saved(c, s)


def state_row(c: Chain) -> tuple:
    c.undo = []
    return c.number, pickle.dumps(c.without_nodes()), c.misfit, c.temperature, c.noise.tolist(), None, None


def ladder(chains: int, cold: int, hottest: float) -> list[float]:
    """Temperatures: 1 for the first `cold` chains, then a geometric ladder up to the hottest."""
    return [1.0 if i <= cold else hottest ** ((i - cold) / (chains - cold)) for i in range(1, chains + 1)]


def swap_accepted(misfit1, misfit2, temperature1, temperature2, log_u, noise=0.0):
    """The rule of a swap, for numbers or Columns. noise: sum over observables of count times the log ratio of the noises."""
    return log_u < (1 / temperature1 - 1 / temperature2) * ((misfit1 - misfit2) / 2 + noise)


def swapped(a: dict, b: dict, count, log_u: float) -> bool:
    """Whether two chains trade temperatures. count: observations of each observable (a number, if there is one)."""
    noise = np.sum(np.asarray(count) * (np.log(np.asarray(a["noise"], float)) - np.log(np.asarray(b["noise"], float))))
    return bool(swap_accepted(a["misfit"], b["misfit"], a["temperature"], b["temperature"], log_u, noise))


def run(spark: SparkSession, s: Settings, chains: int, seed: int = 1, cold: int | None = None, hottest: float = 1.0, swap_every: int | None = None, swap_from: int = 0, rays: tuple[DataFrame, Callable[[pd.DataFrame], Rays], Callable[[], np.ndarray]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, nuclei) of all chains. With swap_every, chains trade temperatures (in random disjoint pairs) after every so many iterations from swap_from on.

    rays: a table that goes to every chain's task, what makes it Rays there, and their counts; so the driver holds none. Without it the settings' own rays travel with them.
    """
    ship(spark)
    temperatures = ladder(chains, chains if cold is None else cold, hottest)
    length = swap_every or SEGMENT
    problem = spark.sparkContext.broadcast(cloudpickle.dumps(s))  # rays of settings travel once to each executor

    def start(batches, held=None):
        s = held or pickle.loads(problem.value)
        for pdf in batches:
            for n, t in zip(pdf["chain"], pdf["temperature"], strict=True):
                c = Chain(int(n), s, float(t), seed)
                yield pd.DataFrame([model_row(c, s), state_row(c)], columns=COLUMNS)

    def segment(batches, held=None):
        s = held or pickle.loads(problem.value)
        for pdf in batches:
            for state, t in zip(pdf["state"], pdf["temperature"], strict=True):
                c: Chain = pickle.loads(bytes(state))
                c.resume(s)
                c.temperature = float(t)
                for _ in range(min(length, s.iterations - c.iteration)):
                    c.iterate(s)
                    if c.iteration % s.save_every == 0:
                        yield pd.DataFrame([model_row(c, s)], columns=COLUMNS)
                yield pd.DataFrame([state_row(c)], columns=COLUMNS)

    def each(table: DataFrame, step: Callable) -> DataFrame:
        if rays is None:
            return stored(table.repartition(chains, "chain").mapInPandas(step, STATE))
        rows, made, _ = rays
        own = rows.withColumn("_chain", F.explode(F.sequence(F.lit(1), F.lit(chains))))

        def whole(chain: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            parts = list(step([chain], replace(pickle.loads(problem.value), rays=made(nodes.drop(columns="_chain")))))
            return pd.DataFrame([r for p in parts for r in p.astype(object).itertuples(index=False, name=None)], columns=COLUMNS)

        return stored(table.groupBy("chain").cogroup(own.groupBy("_chain")).applyInPandas(whole, STATE))

    names = "chain int, temperature double"
    state = each(spark.createDataFrame(list(enumerate(temperatures, 1)), names), start)
    counts = None
    parts, rng = [state], np.random.default_rng(seed)
    now = state.where("state IS NOT NULL").select("chain", "state", "temperature")
    for at in range(0, s.iterations, length):
        state = each(now, segment)
        parts.append(state)
        now = state.where("state IS NOT NULL").select("chain", "state", "temperature")
        if swap_every and swap_from <= at + length < s.iterations:
            rows = {r["chain"]: r.asDict() for r in state.where("state IS NOT NULL").select("chain", "misfit", "temperature", "noise").collect()}
            if counts is None:
                counts = rays[2]() if rays else s.rays.counts if s.rays else 0
            order = rng.permutation(sorted(rows)).tolist()
            for a, b in zip(order[0::2], order[1::2], strict=False):
                if swapped(rows[a], rows[b], counts, math.log(rng.random())):
                    rows[a]["temperature"], rows[b]["temperature"] = rows[b]["temperature"], rows[a]["temperature"]
            given = spark.createDataFrame([(n, r["temperature"]) for n, r in rows.items()], names)
            now = now.drop("temperature").join(F.broadcast(given), "chain")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("state IS NULL")
    return every.select("chain", "model.*"), every.select("chain", F.explode("cells").alias("m")).select("chain", "m.*")
