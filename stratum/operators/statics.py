"""Static corrections by damped least squares.

Stations meet only events, so they are eliminated, and conjugate gradients solve for events alone. A block holds all entries of a range of stations as arrays, a chunk the vectors of some events; in a
step a block gets the numbers of the events that it has, and gives back their sums. A task holds a block or a chunk.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.session import ship
from stratum.store import drop_stored, stored

#: Weight of the rows that hold shared statics equal: 1 / 0.001^2.
TIE = 1e6
#: Most steps of the solver, and the share of the first residual at which it ends.
STEPS, TOLERANCE = 200, 1e-10
#: About how many residuals a block takes, and how many unknowns of events a chunk.
BLOCK, CHUNK = 2_000_000, 32_768
#: A row of blocks and chunks: arrays of a block (chunk null), of a chunk (block null), or of the events that a block has of a chunk.
PIECE = "block long, chunk long, data binary"


def event_statics(residuals: DataFrame) -> DataFrame:
    """(obs_name, event_id, value) where only events have statics: the normal matrix is diagonal, so each is a mean residual."""
    return residuals.groupBy("obs_name", "event_id").agg(F.avg("r").alias("value"))


def block_of(rows: pd.DataFrame, block: int, chunks: int, damped: np.ndarray) -> pd.DataFrame:
    """PIECE rows of a block and of its events. rows: (event, station, obs, w, wr), an entry each."""
    rows = rows.sort_values(["station", "obs", "event"])
    event, station, obs = (rows[c].to_numpy(np.int64) for c in ("event", "station", "obs"))
    w, wr = rows["w"].to_numpy(float), rows["wr"].to_numpy(float)
    start = np.flatnonzero(np.r_[True, (np.diff(station) != 0) | (np.diff(obs) != 0)])
    order = np.lexsort((obs, event))
    new = np.r_[True, (np.diff(event[order]) != 0) | (np.diff(obs[order]) != 0)]
    at = np.empty(len(rows), np.int32)
    at[order] = np.cumsum(new) - 1
    known = order[new]
    kind = obs[start]
    data = {"at": at, "w": w, "start": start, "plain": np.add.reduceat(w, start) + damped[kind], "b": np.add.reduceat(wr, start), "station": station[start], "obs": kind, "events": len(known)}
    out = [(block, None, pickle.dumps(data))]
    ids, own, plain, b = event[known], obs[known], np.bincount(at, w), np.bincount(at, wr)
    chunk = ids % chunks
    for c in np.unique(chunk):
        some = np.flatnonzero(chunk == c)
        out.append((block, int(c), pickle.dumps({"at": some.astype(np.int32), "id": ids[some], "obs": own[some], "plain": plain[some], "b": b[some]})))
    return pd.DataFrame(out, columns=["block", "chunk", "data"])


def preconditioned(c: dict) -> np.ndarray:
    """The common value of the tied group of each event, and its departure from that, for the residual r: so stiff ties cost no steps."""
    n = len(c["r"])
    common = (np.bincount(c["group"], c["r"], n) / np.maximum(np.bincount(c["group"], c["plain"], n), np.finfo(float).tiny))[c["group"]]
    return np.where(c["group"] == np.arange(n), common, common + c["r"] / (c["plain"] + c["tied"]))


def chunk_of(lists: pd.DataFrame, ties: pd.DataFrame, kinds: int) -> pd.DataFrame:
    """PIECE rows of a chunk (vectors at the start) and of the events that blocks have of it, now by their places in the chunk. ties: (id, a, b), observables by number."""
    if not len(lists):
        return pd.DataFrame({"block": [], "chunk": [], "data": []})
    parts, chunk = [pickle.loads(d) for d in lists["data"]], int(lists["chunk"].iloc[0])
    ids, obs = (np.concatenate([p[k] for p in parts]) for k in ("id", "obs"))
    names, number = np.unique(ids, return_inverse=True)
    keys, place = np.unique(number * kinds + obs, return_inverse=True)
    n = len(keys)
    plain, b = (np.bincount(place, np.concatenate([p[k] for p in parts]), n) for k in ("plain", "b"))
    # a tie of an event that one of the observables lacks holds nothing
    t = ties[ties["id"].isin(names)]
    ends = [np.searchsorted(names, t["id"].to_numpy(np.int64)) * kinds + t[k].to_numpy(np.int64) for k in "ab"]
    held = np.isin(ends[0], keys) & np.isin(ends[1], keys)
    ta, tb = (np.searchsorted(keys, e[held]) for e in ends)
    group, before = np.arange(n), None
    while before is None or (group != before).any():
        before = group.copy()
        np.minimum.at(group, ta, before[tb])
        np.minimum.at(group, tb, before[ta])
    tied = TIE * (np.bincount(ta, minlength=n) + np.bincount(tb, minlength=n))
    zero = np.zeros(n)
    state = {"id": names[keys // kinds], "obs": keys % kinds, "plain": plain, "tied": tied, "group": group, "ta": ta, "tb": tb, "x": zero, "r": b, "p": zero, "ap": zero, "z": zero, "az": zero}
    out, k = [(None, chunk, pickle.dumps(state))], 0
    for block, p in zip(lists["block"], parts, strict=True):
        out.append((block, chunk, pickle.dumps({"at": p["at"], "place": place[k : k + len(p["at"])].astype(np.int32)})))
        k += len(p["at"])
    return pd.DataFrame(out, columns=["block", "chunk", "data"])


def moved(c: dict, alpha: float | None, beta: float) -> dict:
    """A chunk after a step of lengths alpha and beta; without alpha as it is. z: what the matrix is multiplied with next."""
    if alpha is not None:
        p, ap = c["z"] + beta * c["p"], c["az"] + beta * c["ap"]
        c = c | {"p": p, "ap": ap, "x": c["x"] + alpha * p, "r": c["r"] - alpha * ap}
    return c | {"z": preconditioned(c)}


def sent(chunks: pd.DataFrame, lists: pd.DataFrame, vector: str, alpha: float | None, beta: float) -> pd.DataFrame:
    """For each block, the numbers of a chunk's vector that it needs."""
    if not len(chunks) or not len(lists):
        return pd.DataFrame({"block": [], "chunk": [], "data": []})
    c = pickle.loads(chunks["data"].iloc[0])
    v = (moved(c, alpha, beta) if vector == "z" else c)[vector]
    data = [pickle.dumps(p | {"v": v[p["place"]]}) for p in map(pickle.loads, lists["list"])]
    return pd.DataFrame({"block": lists["block"].to_numpy(), "chunk": lists["of"].to_numpy(), "data": data})


def met(blocks: pd.DataFrame, numbers: pd.DataFrame) -> tuple[dict, list[dict], np.ndarray]:
    """A block, the numbers that it got, and the sum over each of its stations."""
    b, got = pickle.loads(blocks["data"].iloc[0]), [pickle.loads(d) for d in numbers["data"]]
    v = np.empty(b["events"])
    for g in got:
        v[g["at"]] = g["v"]
    return b, got, np.add.reduceat(b["w"] * v[b["at"]], b["start"])


def given_back(blocks: pd.DataFrame, numbers: pd.DataFrame, own: bool) -> pd.DataFrame:
    """What elimination of a block's stations adds to its events, by chunks. own: of the right side, not of the numbers sent."""
    if not len(blocks):
        return pd.DataFrame({"block": [], "chunk": [], "data": []})
    b, got, sums = met(blocks, numbers)
    each = (b["b"] if own else sums) / b["plain"]
    q = np.bincount(b["at"], b["w"] * np.repeat(each, np.diff(np.r_[b["start"], len(b["at"])])), b["events"])
    return pd.DataFrame({"block": numbers["block"].to_numpy(), "chunk": numbers["chunk"].to_numpy(), "data": [pickle.dumps({"place": g["place"], "q": q[g["at"]]}) for g in got]})


def stepped(chunks: pd.DataFrame, back: pd.DataFrame, own: bool, alpha: float | None, beta: float) -> pd.DataFrame:
    """A chunk after a step with az, the matrix times z, and its shares of r z and z az. own: at the start, where the right side loses what stations take."""
    if not len(chunks):
        return pd.DataFrame({"chunk": [], "data": [], "rz": [], "zaz": []})
    c = pickle.loads(chunks["data"].iloc[0])
    q = np.zeros(len(c["x"]))
    for g in map(pickle.loads, back["data"]):
        q[g["place"]] += g["q"]
    if own:
        c = c | {"r": c["r"] - q}
    else:
        c = moved(c, alpha, beta)
        az = (c["plain"] + c["tied"]) * c["z"] - q
        np.subtract.at(az, c["ta"], TIE * c["z"][c["tb"]])
        np.subtract.at(az, c["tb"], TIE * c["z"][c["ta"]])
        c = c | {"az": az}
    return pd.DataFrame({"chunk": chunks["chunk"], "data": [pickle.dumps(c)], "rz": [float(c["r"] @ c["z"])], "zaz": [float(c["z"] @ c["az"])]})


def stations_of(blocks: pd.DataFrame, numbers: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Statics of a block's stations, from those of its events."""
    if not len(blocks):
        return pd.DataFrame({"obs_name": [], "kind": [], "id": [], "value": []})
    b, _, sums = met(blocks, numbers)
    return pd.DataFrame({"obs_name": np.array(names, object)[b["obs"]], "kind": "station", "id": b["station"], "value": (b["b"] - sums) / b["plain"]})


VALUE = "obs_name string, kind string, id long, value double"


def assembled(residuals: DataFrame, sigma: dict[str, float], damping: float, ties: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, chunks, lists): PIECE rows of stations, of events, and of which events a block has."""
    names = sorted(sigma)
    code = lambda c: F.create_map(*(F.lit(x) for pair in enumerate(names) for x in reversed(pair)))[F.col(c)].cast("long")
    weight = F.create_map(*(F.lit(x) for k, s in sigma.items() for x in (k, 1 / s**2)))[F.col("obs_name")]
    r = residuals.where("r IS NOT NULL AND NOT isnan(r) AND event_id IS NOT NULL AND station_id IS NOT NULL").where(F.col("obs_name").isin(names))
    r = r.select(F.col("event_id").cast("long").alias("event"), F.col("station_id").cast("long").alias("station"), code("obs_name").alias("obs"), weight.alias("w"), F.col("r").cast("double").alias("r"))
    k = r.agg(F.count("*").alias("n"), F.approx_count_distinct("event").alias("events")).first()
    blocks, chunks = max(1, -(-k["n"] // BLOCK)), -(-k["events"] * len(names) // CHUNK) | 1
    damped = np.array([(sigma[n] / damping) ** 2 for n in names])
    # rows of one event and station are summed before they are shuffled, so a hot pair is a row a task
    entries = r.groupBy("station", "obs", "event").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("r")).alias("wr"))

    def packed(batches):
        rows = list(batches)
        if sum(map(len, rows)):
            yield block_of(pd.concat(rows), TaskContext.get().partitionId(), chunks, damped)

    pieces = stored(entries.repartitionByRange(blocks, "station").mapInPandas(packed, PIECE))
    spark = residuals.sparkSession
    if ties is None:
        ties = spark.createDataFrame([], "id long, obs_a string, obs_b string")
    t = ties.select(F.col("id").cast("long").alias("id"), code("obs_a").alias("a"), code("obs_b").alias("b")).where("a <> b").withColumn("of", F.pmod("id", F.lit(chunks)))
    own = stored(pieces.where("chunk IS NOT NULL").groupBy("chunk").cogroup(t.groupBy("of")).applyInPandas(lambda x, y: chunk_of(x, y, len(names)), PIECE))
    return pieces.where("chunk IS NULL").select("block", "data"), own.where("block IS NULL").select("chunk", "data"), own.where("block IS NOT NULL").select("block", F.col("chunk").alias("of"), F.col("data").alias("list"))


def joint_statics(residuals: DataFrame, sigma: dict[str, float], damping: float, ties: DataFrame | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """residuals: (obs_name, event_id, station_id, r). (obs_name, kind, id, value): event and station statics of all observables at once, however many.

    Station statics are damped by (sigma / damping)^2. ties: (id, obs_a, obs_b): event statics to be held equal. Null and NaN residuals, and those of no event, station or sigma, are left out.
    Preconditioned conjugate gradients, after elimination of the stations; the driver sees two numbers a step. They end after `steps`, or when the residual's size is `tolerance` of the first one's.
    """
    ship(residuals.sparkSession)
    names = sorted(sigma)
    blocks, start, lists = assembled(residuals, sigma, damping, ties)

    def numbers(chunks: DataFrame, vector: str, alpha: float | None, beta: float) -> DataFrame:
        return chunks.select("chunk", "data").groupBy("chunk").cogroup(lists.groupBy("of")).applyInPandas(lambda c, x: sent(c, x, vector, alpha, beta), PIECE)

    def step(chunks: DataFrame, own: bool, alpha: float | None = None, beta: float = 0.0) -> DataFrame:
        back = blocks.groupBy("block").cogroup(numbers(chunks, "z", alpha, beta).groupBy("block")).applyInPandas(lambda b, x: given_back(b, x, own), PIECE)
        out = chunks.select("chunk", "data").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(lambda c, x: stepped(c, x, own, alpha, beta), "chunk long, data binary, rz double, zaz double")
        return stored(out)

    now = step(start, True)
    before, alpha, beta, first = None, None, 0.0, None
    for _ in range(steps):
        later = step(now, False, alpha, beta)
        drop_stored(now)
        now = later
        k = now.agg(F.sum("rz").alias("rz"), F.sum("zaz").alias("zaz")).first()
        rz, zaz = k["rz"] or 0.0, k["zaz"] or 0.0
        first = rz if first is None else first
        if rz <= 0 or rz <= tolerance**2 * first:
            break
        beta = 0.0 if before is None else rz / before
        alpha = rz / (zaz - (beta * rz / alpha if before is not None else 0.0))
        before = rz
    events = now.select("data").mapInPandas(lambda batches: (pd.DataFrame({"obs_name": np.array(names, object)[c["obs"]], "kind": "event", "id": c["id"], "value": c["x"]}) for pdf in batches for c in map(pickle.loads, pdf["data"])), VALUE)
    stations = blocks.groupBy("block").cogroup(numbers(now, "x", None, 0.0).groupBy("block")).applyInPandas(lambda b, x: stations_of(b, x, names), VALUE)
    value = stored(events.unionAll(stations))
    drop_stored(now)
    return centred(value, {k: (v / damping) ** 2 for k, v in sigma.items()}, ties)


def centred(value: DataFrame, damped: dict[str, float], ties: DataFrame | None) -> DataFrame:
    """Statics with the best common shift between events and stations of each set of tied observables: only damping tells it, so weakly that steps on residuals may end before it is found. At the solution the damped mean of a set's stations is 0."""
    sets = {name: name for name in damped}
    pairs = ties.select("obs_a", "obs_b").distinct().collect() if ties is not None else ()  # of observables, few
    for a, b in pairs:
        if a in sets and b in sets:
            old, new = sets[a], sets[b]
            sets = {k: new if v == old else v for k, v in sets.items()}
    sums = {r["obs_name"]: (r["x"], r["n"]) for r in value.where("kind = 'station'").groupBy("obs_name").agg(F.sum("value").alias("x"), F.count("*").alias("n")).collect()}
    shift = {}
    for name in sums:
        own = [k for k in sums if sets[k] == sets[name]]
        shift[name] = sum(damped[k] * sums[k][0] for k in own) / sum(damped[k] * sums[k][1] for k in own)
    if not shift:
        return value
    c = F.create_map(*(F.lit(x) for pair in shift.items() for x in pair))[F.col("obs_name")]
    return value.withColumn("value", F.col("value") + F.when(F.col("kind") == "event", c).otherwise(-c))
