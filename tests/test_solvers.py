import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratum.functions import special
from stratum.operators import counted, directional, graph, grid, interpolate, layers, locate, moments, nearest, order_stats, statics, tempering


def dense_statics(rows, sigma, damping, ties):
    keys = sorted({(o, "event", e) for o, e, _, _ in rows} | {(o, "station", s) for o, _, s, _ in rows})
    at = {k: i for i, k in enumerate(keys)}
    g, b = np.zeros((len(keys), len(keys))), np.zeros(len(keys))
    for o, e, s, r in rows:
        i, j, w = at[o, "event", e], at[o, "station", s], 1 / sigma[o] ** 2
        for x in (i, j):
            b[x] += w * r
            for y in (i, j):
                g[x, y] += w
    for k, i in at.items():
        g[i, i] += (sigma[k[0]] / damping) ** 2 if k[1] == "station" else 0
    for key, a, c in ties:
        i, j = at.get((a, "event", key)), at.get((c, "event", key))
        if i is not None and j is not None:
            for x, y, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
                g[x, y] += s * statics.TIE
    return dict(zip(keys, np.linalg.solve(g, b)))


@pytest.mark.parametrize("damping", [0.1, 5.0])
def test_statics_equal_the_dense_solution(spark, damping):
    rng = np.random.default_rng(1)
    rows = [(o, int(e), int(s), float(rng.normal())) for o in "ABC" for e in range(9) for s in range(14) if rng.random() < 0.5 and (o, e) != ("B", 3)]
    rows += rows[:20] * 30  # a hot pair
    ties = [(e, "A", "B") for e in range(9)] + [(e, "B", "C") for e in range(4)] + [(99, "A", "B")]
    sigma = {"A": 0.5, "B": 0.4, "C": 0.3}
    df = spark.createDataFrame([*rows, ("A", 1, 1, None), ("A", 1, 1, math.nan), ("A", None, 1, 1.0)], "obs_name string, event_id long, station_id long, r double")
    got = statics.joint_statics(df, sigma, damping, spark.createDataFrame(ties, "id long, obs_a string, obs_b string")).collect()
    want = dense_statics(rows, sigma, damping, ties)
    assert len(got) == len(want)
    assert max(abs(r["value"] - want[r["obs_name"], r["kind"], r["id"]]) for r in got) < 1e-6


def test_statics_of_many_blocks_are_no_rows(spark, monkeypatch):
    """Entries of the matrix are arrays of blocks: no table between steps has a row for each. Blocks and chunks don't change the solution."""
    tables, write = [], statics.stored
    monkeypatch.setattr(statics, "stored", lambda df, *more: tables.append(write(df, *more)) or tables[-1])
    monkeypatch.setattr(statics, "drop_stored", lambda df: None)
    monkeypatch.setattr(statics, "BLOCK", 100, raising=False)
    monkeypatch.setattr(statics, "CHUNK", 12, raising=False)
    rng = np.random.default_rng(4)
    rows = [(o, int(e), int(s), float(rng.normal())) for o in "AB" for e in range(-9, 9) for s in range(30) if rng.random() < 0.5]
    ties = [(e, "B", "A") for e in range(-9, 6)]
    sigma = {"A": 0.5, "B": 0.4}
    got = statics.joint_statics(spark.createDataFrame(rows, "obs_name string, event_id long, station_id long, r double"), sigma, 0.1, spark.createDataFrame(ties, "id long, obs_a string, obs_b string")).collect()
    want = dense_statics(rows, sigma, 0.1, ties)
    assert len(got) == len(want) and max(abs(r["value"] - want[r["obs_name"], r["kind"], r["id"]]) for r in got) < 1e-6
    assert max(t.count() for t in tables) <= len(want) < len(rows) / 4 and tables[0].where("chunk IS NULL").count() > 2


def test_statics_of_nothing(spark):
    assert statics.joint_statics(spark.createDataFrame([], "obs_name string, event_id long, station_id long, r double"), {"A": 1.0}, 1.0).count() == 0


def test_principal_axes_equal_a_solver(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(60, 3, 3))
    m = m + m.transpose(0, 2, 1)
    m[:4] = [np.eye(3), np.zeros((3, 3)), np.diag([1.0, -3.0, 2.0]), np.outer([1, 2, 3], [1, 2, 3])]
    rows = [(i, *(float(a[p, q]) for p, q in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for i, a in enumerate(m)]
    df = spark.createDataFrame([*rows, (98, None, 0.0, 0.0, 1.0, 0.0, 1.0), (99, math.nan, 0.0, 0.0, 1.0, 0.0, 1.0)], "k long, t11 double, t12 double, t13 double, t22 double, t23 double, t33 double")
    for r in directional.with_axes(df).collect():
        if r["k"] >= 98:
            assert r["lambda1"] is None
            continue
        a = m[r["k"]]
        values = np.array([r[f"lambda{k}"] for k in (1, 2, 3)])
        vectors = np.array([[r[f"{c}{k}"] for c in "xyz"] for k in (1, 2, 3)])
        assert np.allclose(sorted(values), np.linalg.eigvalsh(a), atol=1e-12) and (np.diff(np.abs(values)) >= -1e-12).all()
        assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-12) and np.allclose(vectors.T @ np.diag(values) @ vectors, a, atol=1e-12)
        assert all(v[np.abs(v).argmax()] > 0 for v in vectors)


def test_error_function(spark):
    x = [0.0, -0.0, 1e-9, 0.3, -1.7, 2.4999999, 2.5, -2.5, 3.3, 6.0, -40.0, math.inf, -math.inf]
    rows = spark.createDataFrame([(v,) for v in [*x, math.nan, None]], "x double").select("x", special.erf(F.col("x")).alias("y"), special.normal_cdf(F.col("x"), 1.0, 2.0).alias("p")).collect()
    for r in rows[: len(x)]:
        assert abs(r["y"] - math.erf(r["x"])) < 1e-12 and abs(r["p"] - (1 + math.erf((r["x"] - 1) / (2 * math.sqrt(2)))) / 2) < 1e-12
    assert math.isnan(rows[-2]["y"]) and rows[-1]["y"] is None


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_counted_statistics_equal_those_of_arrays(spark, keys):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.round(rng.normal(size=900), 1), rng.random(300) * 4, np.full(400, 0.5)])
    rows = [(None if i % 3 == 2 else i % 3, float(v)) for i, v in enumerate(values)] + [(0, None), (0, math.nan)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    x = F.when(~F.isnan("x"), F.col("x"))
    clean = df.where("x IS NOT NULL AND NOT isnan(x)")
    got = counted.tendencies(df, keys, F.col("x"), -5.0, 5.0)
    want = order_stats.tendencies(clean, keys, F.col("x"), -5.0, 5.0)
    by = lambda frame: {tuple(r[k] for k in keys): r.asDict() for r in frame.collect()}
    a, b = by(got), by(want)
    assert a.keys() == b.keys() and len(a) == (3 if keys else 1)
    for k, w in b.items():
        assert {c: v for c, v in a[k].items() if c not in ("mean", "hval")} == {c: v for c, v in w.items() if c not in ("mean", "hval")}
        assert abs(a[k]["mean"] - w["mean"]) < 1e-12 and abs(a[k]["hval"] - w["hval"]) < 1e-12
    ks = by(counted.kolmogorov_uniform(counted.runs(df, keys, x), keys, -5.0, 5.0))
    s = order_stats.sorted_samples(clean, keys, F.col("x"))
    assert all(abs(ks[k]["ks"] - w["ks"]) < 1e-12 for k, w in by(s.select(*keys, order_stats.kolmogorov_uniform(F.col("s"), -5.0, 5.0).alias("ks"))).items())


def test_large_groups_go_by_counts(spark):
    df = spark.createDataFrame([("big", float(i % 50)) for i in range(500)] + [("small", float(i)) for i in range(9)], "k string, x double")
    by = lambda frame: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select(*sorted(frame.columns)).collect())
    assert by(counted.either(df, ["k"], F.col("x"), 0.0, 60.0, most=100)) == by(order_stats.tendencies(df, ["k"], F.col("x"), 0.0, 60.0))


def not_a_knot(x, y, at):
    """The same spline by a dense system over all coefficients."""
    n = len(x) - 1
    if n == 1:
        return y[0] + (y[1] - y[0]) * (at - x[0]) / (x[1] - x[0])
    if n == 2:
        return np.polyval(np.polyfit(x, y, 2), at)
    rows, right = [], []

    def row(parts, value):
        r = np.zeros(4 * n)
        for piece, coefficients in parts:
            r[4 * piece : 4 * piece + 4] += coefficients
        rows.append(r)
        right.append(value)

    for i in range(n):
        h = x[i + 1] - x[i]
        row([(i, [1, 0, 0, 0])], y[i])
        row([(i, [1, h, h**2, h**3])], y[i + 1])
        if i < n - 1:
            row([(i, [0, 1, 2 * h, 3 * h * h]), (i + 1, [0, -1, 0, 0])], 0)
            row([(i, [0, 0, 2, 6 * h]), (i + 1, [0, 0, -2, 0])], 0)
    row([(0, [0, 0, 0, 1]), (1, [0, 0, 0, -1])], 0)
    row([(n - 2, [0, 0, 0, 1]), (n - 1, [0, 0, 0, -1])], 0)
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    t = at - x[i]
    return (c[i] * np.stack([np.ones_like(t), t, t**2, t**3], -1)).sum(-1)


def test_splines_equal_a_dense_solution(spark):
    rng = np.random.default_rng(8)
    lines = {n: rng.normal(size=(n, 2)).cumsum(0) for n in (1, 2, 3, 4, 5, 30)}
    lines[50] = np.repeat(rng.normal(size=(6, 2)), 2, axis=0)  # repeated nodes
    rows = [(ray, i, *map(float, p)) for ray, line in lines.items() for i, p in enumerate(line)]
    df = spark.createDataFrame(rows, "ray long, step long, x double, along double").withColumnRenamed("step", "n")
    got = interpolate.splined(df.withColumnsRenamed({"along": "y"}), "ray", "n", ["x", "y"], 0.4).toPandas()
    for ray, line in lines.items():
        own = got[got["ray"] == ray].sort_values("seq")
        keep = np.r_[True, np.abs(np.diff(line, axis=0)).sum(1) > 0]
        knots = line[keep]
        s = np.r_[0, np.sqrt((np.diff(knots, axis=0) ** 2).sum(1)).cumsum()]
        n = int(s[-1] / 0.4)
        assert len(own) == (n + 1 if n else len(line))
        if n:
            at = np.linspace(0, s[-1], n + 1)
            for k, c in enumerate("xy"):
                assert np.allclose(own[c], not_a_knot(s, knots[:, k], at), atol=1e-8), ray


def test_harmonic_mean_of_zero_velocity(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, 2.0), (2, 4.0), (3, None)], "k long, v double")
    got = {r["k"]: r["velocity"] for r in moments.harmonic_mean(df, ["k"], F.col("v")).collect()}
    assert got[1] == 0.0 and abs(got[2] - 8 / 3) < 1e-12 and got[3] is None


SPEC = (-0.05, 0.05, 6), (0.0, 0.08, 5), (6300.0, 6371.0, 4)


def nodes(spark):
    return grid.lattice(spark, *SPEC).withColumn("v", 5 + F.col("node_ix") % 4)


@pytest.mark.parametrize("mean", [True, False])
def test_blocks_give_the_times_of_edge_by_edge_relaxation(spark, mean):
    g = nodes(spark)
    e = graph.edges(g, grid.neighbours(g, 6, 5, 4), slowness_mean=mean)
    sources = spark.createDataFrame([(7, 1), (8, 120), (8, 60), (7, 1)], "source long, node long")
    want = {(r["source"], r["node"]): r["time"] for r in graph.shortest_times(e, sources.distinct()).collect()}
    for side in (2, 16):
        rows = graph.relaxed(e, grid.blocks_of(g, (6, 5, 4), side), sources).collect()
        assert {(r["source"], r["node"]): r["time"] for r in rows} == want and len(rows) == len(want) == 240
    assert graph.relaxed(e, grid.blocks_of(g, (6, 5, 4), 2), sources.limit(0)).count() == 0


LONG = (-0.05, 0.05, 3), (0.0, 0.08, 2), (6300.0, 6371.0, 60)


def test_layers_give_the_times_and_trees_of_blocks(spark, monkeypatch):
    """A long lattice with nodes and whole layers left out, over slabs of 4 layers in groups of 3 and passes of 2 sources: trees of relaxed() and predecessors(), in jobs that don't follow its length."""
    monkeypatch.setattr(layers, "LAYERS", 4)
    monkeypatch.setattr(layers, "GROUP", 3)
    monkeypatch.setattr(layers, "SOURCES", 2)
    counts = 3, 2, 60
    g = grid.lattice(spark, *LONG).withColumn("v", 5 + F.pmod(F.col("node_ix") * 7, F.lit(11)) / 3).where("node_ix % 13 <> 5 AND NOT k BETWEEN 45 AND 49")
    pairs = grid.neighbours(g, *counts).join(g.select(F.col("node_ix").alias("neighbour_ix")), "neighbour_ix", "left_semi")
    sources = spark.createDataFrame([(7, 1), (8, 120), (8, 60), (9, 355), (11, 217)], "source long, node long")
    e = graph.edges(g, pairs)
    want = graph.predecessors(graph.relaxed(e, grid.blocks_of(g, counts, 16), sources), e).collect()
    want = {(r["source"], r["node_ix"]): (r["prev"], r["time"]) for r in want}
    with_jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("layers", "layers")
    rows = graph.lattice_trees(g, pairs, sources, counts).collect()
    jobs = len(with_jobs.getJobIdsForGroup("layers"))
    spark.sparkContext.setJobGroup("other", "other")
    got = {(r["source"], r["node"]): (r["prev"], r["time"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert {k[0] for k in got if k[1] > 300} == {9} and jobs < 120


@pytest.mark.parametrize("wide", [0, 400])
def test_paths_by_blocks_are_paths_by_nodes(spark, monkeypatch, wide):
    monkeypatch.setattr(layers, "WIDE", wide)
    monkeypatch.setattr(layers, "LAYERS", 4)
    g = grid.lattice(spark, *LONG).withColumn("v", 5 + F.pmod(F.col("node_ix") * 7, F.lit(11)) / 3)
    tree = graph.trees(g, spark.createDataFrame([(1,), (200,)], "source long"), (3, 2, 60), {"P": "v"})
    receivers = spark.createDataFrame([(s, "P", n) for s in (1, 200) for n in (1, 2, 77, 200, 300, 360)], "source long, phase string, receiver long")
    one = sorted(map(tuple, graph.paths(tree, receivers).collect()))
    assert one == sorted(map(tuple, graph.paths(tree, receivers, counts=(3, 2, 60)).collect())) and len(one) > 300
    with pytest.raises(ValueError):
        graph.paths(tree, receivers, most=20, counts=(3, 2, 60))


def recorded(monkeypatch, *modules):
    """Plans of all tables that modules store from now on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "stored", lambda df, *more, write=module.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *more))
    return plans


def test_no_table_of_a_lattice_passes_through_the_driver(spark, monkeypatch, tmp_path):
    """However small Spark takes a table for, nothing of a lattice or its paths is broadcast."""
    plans = recorded(monkeypatch, graph, layers)
    spark.range(1, 361).select(F.col("id").alias("node_ix"), (5 + F.col("id") % 3).cast("double").alias("v")).write.parquet(str(tmp_path / "nodes"))
    g = grid.placed(spark.read.parquet(str(tmp_path / "nodes")), *LONG)
    receivers = spark.createDataFrame([(1, "P", 360), (200, "P", 2)], "source long, phase string, receiver long")
    plans.append(graph.traced(g, receivers, (3, 2, 60), {"P": "v"})._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("BroadcastExchange" in p for p in plans)
    want, got = grid.lattice(spark, *LONG), g.drop("v")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_scores_of_summed_arrivals(spark):
    """Arrivals of one event, station and phase are summed before they meet the nodes; the misfit is that of each arrival."""
    rng = np.random.default_rng(3)
    rows = [(int(e), int(s), "P", float(o), float(w)) for e, s, o, w in zip(rng.integers(0, 2, 80), rng.integers(0, 3, 80), rng.uniform(1, 50, 80), rng.uniform(1, 2, 80))]
    arrivals = spark.createDataFrame([*rows, (0, 1, "P", None, 1.0)], "event_id long, station_id long, phase string, observed double, sigma double")
    nodes = spark.createDataFrame([(e, n) for e in (0, 1) for n in (1, 2)], "event_id long, node_ix long")
    times = {(s, n): float(10 * s + n) for s in range(3) for n in (1, 2)}
    t = spark.createDataFrame([(s, "P", n, x) for (s, n), x in times.items()], "station_id long, phase string, node_ix long, time double")
    scored = locate.scored(arrivals, nodes, t)
    for r in scored.where("event_id = 1").collect():
        own = [(o - times[s, r["node_ix"]], 1 / w**2) for e, s, _, o, w in rows if e == 1]
        x, w = map(np.array, zip(*own))
        shift = (w * x).sum() / w.sum()
        assert abs(r["shift"] - shift) < 1e-9 and abs(r["misfit"] - (w * (x - shift) ** 2).sum()) < 1e-6 and abs(r["error"] - np.sqrt(((x - shift) ** 2).mean())) < 1e-9
    assert scored.where("event_id = 0 AND misfit IS NOT NULL").count() == 2


def test_rays_of_a_run_do_not_pass_through_the_driver(spark, monkeypatch):
    from stratum.plans import solve

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    nodes_, observations, references = solve.supplier_rays(spark, sf)
    whole = type(nodes_)

    def refused(*_):
        raise AssertionError("a table gathered on the driver")

    monkeypatch.setattr(whole, "toPandas", refused)
    assert solve.rjmcmc_rays(spark, sf).count() == 44


def test_rays_of_a_run_are_not_broadcast(spark, monkeypatch):
    """Spark takes the nodes of rays, made from a small table, for few. They come as one row a ray, in order."""
    from stratum.operators import inversion
    from stratum.plans import solve

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plans = recorded(monkeypatch, inversion)
    tables = solve.supplier_rays(spark, sf)
    rows = inversion.ray_rows(tables[0], tables[1], {"delays": "tt_P_dlnVp"}, tables[2])
    assert len(plans) == 1 and "BroadcastExchange" not in plans[0]
    n = tables[1].count()
    rays = inversion.rays_of(rows.toPandas(), {"delays": "tt_P_dlnVp"})
    assert rows.count() == n == len(rays.first) and (np.diff(rays.first) == 20).all()
    assert np.array_equal(rays.columns["r"], np.tile(6071 + 15.0 * np.arange(1, 21), n))


def test_a_state_does_not_grow_with_nodes(spark):
    import pickle

    from stratum.operators import inversion, sampler
    from stratum.plans import solve
    from stratum.sources import config

    rng = np.random.default_rng(6)
    n = 2000
    columns = {c: np.ones(20 * n) for c in ("vp1d", "vs1d", "azimuth", "elevation", "polarization", "seg_len")} | {"lat": rng.uniform(-1, 1, 20 * n), "lon": rng.uniform(-3, 3, 20 * n), "r": rng.uniform(6071, 6371, 20 * n)}
    rays = sampler.Rays(columns, 20 * np.arange(n), rng.normal(size=n), (inversion.Named("tt_P_dlnVp"),), np.zeros(n, np.int64), np.arange(n), np.arange(n))
    s, _ = inversion.build_settings(config.parse(solve.RUN), rays)
    one = sampler.Chain(1, s, 1.0, 1)
    for _ in range(30):
        one.iterate(s)
    state = sampler.state_row(one)[1]
    other = pickle.loads(state)
    other.resume(s)
    assert len(state) < 16 * n  # a number for each ray, none for nodes
    for _ in range(30):
        one.iterate(s)
        other.iterate(s)
    assert one.misfit == other.misfit and np.array_equal(one.near[0], other.near[0])


def test_trees_leave_out_nodes_without_velocity(spark):
    g = nodes(spark).withColumn("v", F.when(F.col("k") == 3, 0.0).otherwise(F.col("v")))
    t = graph.trees(g, spark.createDataFrame([(1,)], "source long"), (6, 5, 4), {"P": "v"}, side=2).collect()
    assert {r["node_ix"] for r in t} == set(range(1, 61)) and sum(r["prev"] == 0 for r in t) == 1
    with pytest.raises(ValueError):
        graph.trees(g, spark.createDataFrame([(1,)], "source long"), (6, 5, 3), {"P": "v"})


def test_isotropic_directed_edges_are_plain_edges(spark):
    g = nodes(spark).withColumns({"n1": F.lit(1.0), "n2": F.lit(0.0), "n3": F.lit(0.0), "epsilon": F.lit(0.0), "delta": F.lit(0.0)})
    pairs = grid.neighbours(g, 6, 5, 4)
    rows = lambda df: {(r["a"], r["b"]): r["time"] for r in df.collect()}
    plain, directed = rows(graph.edges(g, pairs)), rows(graph.directed_edges(g, pairs))
    assert plain.keys() == directed.keys() and max(abs(plain[k] - directed[k]) for k in plain) < 1e-9
    fast = rows(graph.directed_edges(g.withColumn("epsilon", F.lit(0.1)), pairs))
    assert any(abs(fast[k] - plain[k]) > 1e-3 for k in plain)


def test_tracing_anisotropy(spark):
    rows = [(1, 0.1, 0.2, 0.3), (1, 0.1, 0.2, 0.3), (2, 0.1, 0.0, 0.0), (2, 0.1, math.pi / 2, 0.0), (2, 0.1, 0.0, math.pi / 2)]
    df = spark.createDataFrame(rows, "k long, e double, az double, el double")
    got = {r["k"]: r for r in directional.tracing_anisotropy(df, ["k"], F.col("e"), F.col("e"), F.col("az"), F.col("el")).collect()}
    n = (math.cos(0.3) * math.cos(0.2), math.cos(0.3) * math.sin(0.2), math.sin(0.3))
    assert np.allclose([got[1][c] for c in ("n1", "n2", "n3")], n) and abs(got[1]["epsilon"] - 0.1) < 1e-12 and got[1]["delta"] != 0
    assert got[2]["epsilon"] == got[2]["delta"] == 0.0


def test_places_off_the_lattice(spark):
    g = nodes(spark)
    places = spark.createDataFrame([(1001, -0.04, 0.011, 6310.0), (1002, 0.05, 0.08, 6371.0), (1003, 9.0, 9.0, 9999.0)], "node_ix long, lat double, lon double, r double")
    links = grid.place_links(places, *SPEC).collect()
    count = lambda n: sum(r["node_ix"] == n for r in links)
    assert count(1002) == count(1003) == 8 and count(1001) in (12, 18, 27) and len(links) == 2 * (count(1001) + 16)
    whole = grid.with_places(g, places, *SPEC, ["v"])
    assert whole.count() == 123 and whole.where("node_ix = 1002").first()["v"] == g.where("node_ix = 120").first()["v"]
    e = graph.edges(whole, grid.neighbours(g, 6, 5, 4).unionByName(grid.place_links(places, *SPEC)))
    blocks = grid.blocks_of(g, (6, 5, 4), 3).unionByName(grid.blocks_of(grid.nearest_node(places, *SPEC), (6, 5, 4), 3))
    source = spark.createDataFrame([(1, 1001)], "source long, node long")
    a = {r["node"]: r["time"] for r in graph.relaxed(e, blocks, source).collect()}
    assert a == {r["node"]: r["time"] for r in graph.shortest_times(e, source).collect()} and 1003 in a


def test_cell_neighbours(spark):
    g = grid.lattice(spark, (0.0, 1.0, 4), (0.0, 1.0, 4), (0.0, 1.0, 2))
    labels = g.select("node_ix", F.when(F.col("i") <= 2, 1).when(F.col("j") <= 2, 2).otherwise(3).alias("nucleus_ix"))
    rows = {(r["a"], r["b"]): r["faces"] for r in nearest.cell_neighbours(labels, grid.neighbours(g, 4, 4, 2)).collect()}
    lab = {r["node_ix"]: r["nucleus_ix"] for r in labels.collect()}
    want = {}
    for r in grid.neighbours(g, 4, 4, 2).collect():
        a, b = lab[r["node_ix"]], lab[r["neighbour_ix"]]
        if a < b:
            want[a, b] = want.get((a, b), 0) + 1
    assert rows == want and set(rows) == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("most", [nearest.AT_ONCE, 1])
def test_borders_of_a_lattice_by_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "AT_ONCE", most)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 3)), 1)
    x[50:] = x[:10]  # at one place the lowest counts
    x[0] = 40.0  # most of the lattice is far from all but one
    nuclei = spark.createDataFrame([(100 - i, *map(float, p)) for i, p in enumerate(x)], "id long, c1 double, c2 double, c3 double")
    counts, low, high = (30, 7, 26), x.min(0), x.max(0)
    for share in (1.0, 0.1):
        axes = [(float(a), float(a + (b - a) * share), n) for a, b, n in zip(low, high, counts, strict=True)]
        g = grid.lattice(spark, *axes).select("node_ix", F.col("lat").alias("c1"), F.col("lon").alias("c2"), F.col("r").alias("c3"))
        at = g.orderBy("node_ix").toPandas()[["c1", "c2", "c3"]].to_numpy()
        d2 = sum((at[:, None, k] - x[None, ::-1, k]) ** 2 for k in range(3))
        label = (d2.argmin(1) + 41).reshape(counts[::-1])
        want = {}
        for k, j, i in np.ndindex(label.shape):
            for near in label[max(0, k - 1) : k + 2, max(0, j - 1) : j + 2, max(0, i - 1) : i + 2].ravel():
                if label[k, j, i] < near:
                    want[label[k, j, i], near] = want.get((label[k, j, i], near), 0) + 1
        got = nearest.lattice_borders(nuclei, ["c1", "c2", "c3"], axes, "id").collect()
        assert len(want) > 20 and {(r["a"], r["b"]): r["faces"] for r in got} == want and len(got) == len(want)


def test_pairs_of_nodes_are_no_rows(spark, monkeypatch, tmp_path):
    """Pairs of neighbouring nodes grow with the cube of the vectors: no table holds them or the nodes."""
    from stratum.plans import solve

    spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (k + 1) * 1.7).cast("float") for k in range(4))).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = solve.cell_neighbours(spark, str(tmp_path)).collect()

    def refused(*_):
        raise AssertionError("rows for each node")

    monkeypatch.setattr(grid, "lattice", refused)
    monkeypatch.setattr(grid, "neighbours", refused)
    assert sorted(solve.cell_neighbours(spark, str(tmp_path)).collect()) == sorted(want) and want
    spark.range(0).select(F.col("id").alias("vec_id"), F.array().cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert solve.cell_neighbours(spark, f"{tmp_path}/none").count() == 0


def test_directional_tendencies_deal_samples_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(k), *map(float, v)) for k, v in zip(rng.integers(0, 12, 900), rng.normal(size=(900, 3)), strict=True)]
    df = spark.createDataFrame([*rows, (12, 1.0, 0.5, 0.5), (13, 0.0, 0.0, 0.0), (None, 1.0, 1.0, 1.0)], "k int, f double, az double, el double")
    columns, limits = [F.col(c) for c in ("f", "az", "el")], {"strength": (0.0, 4.0), "prj": (0.0, 4.0), "angle": (0.0, math.pi / 2)}
    monkeypatch.setattr(directional, "TOGETHER", 60)
    got = directional.directional_tendencies(df, ["k"], *columns, limits)
    assert got.rdd.getNumPartitions() >= len(rows) // 60  # was a fixed number, so a task's samples grew with the table
    d = directional.deviations(df, directional.with_axes(directional.mean_tensor(df, ["k"], *columns)), ["k"], *columns)
    text = lambda df: sorted(str([c if not isinstance(c, float) else f"{c:.9g}" for c in r]) for r in df.collect())
    for name, (low, high) in limits.items():
        assert text(got.where(F.col("field") == name).drop("field", "weighted_mean", "weighted_median")) == text(order_stats.tendencies(d, ["k"], F.col(name), low, high))
    weighted = order_stats.weighted_mean(d, ["k"], F.col("angle"), F.col("strength")).join(order_stats.weighted_median(d, ["k"], F.col("angle"), F.col("strength")), "k")
    assert text(got.where("field = 'angle'").select("k", "weighted_mean", "weighted_median")) == text(weighted)
    assert got.count() == 3 * 14 and got.where("field <> 'angle' AND weighted_mean IS NOT NULL").count() == 0


def test_runs_of_a_statistic_are_made_once(spark, monkeypatch):
    """The distance from a uniform distribution comes with the other statistics, and only values at which a window can end are searched."""
    rng = np.random.default_rng(8)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 600), rng.normal(2.0, 1.0, 600), strict=True)] + [(None, 1.0), (None, 2.0), (4, 3.0), (5, None), (5, float("nan"))]
    df = spark.createDataFrame(rows, "k int, x double")
    made, asked = [], []
    whole, search = counted.runs, counted.at_positions
    monkeypatch.setattr(counted, "runs", lambda *a: made.append(whole(*a)) or made[-1])
    monkeypatch.setattr(counted, "at_positions", lambda run, *a: asked.append(run) or search(run, *a))
    got = {r["k"]: r.asDict() for r in counted.tendencies(df, ["k"], F.col("x"), -5.0, 9.0, kolmogorov=True).collect()}
    assert len(made) == 1 and asked[0].count() < 0.2 * made[0].count()
    assert set(got) == {0, 1, 2, 4, None}
    for k, r in got.items():
        x = np.sort([x for g, x in rows if g == k])
        u, n = (x + 5) / 14, len(x)
        m = max(1, int(0.9 * n))
        at = np.argmin(x[m - 1 :] - x[: n - m + 1])
        assert r["mean"] == pytest.approx(x.mean()) and r["median"] == pytest.approx(np.median(x)) and r["q1"] == pytest.approx(np.quantile(x, 0.25))
        assert (r["hdi_lo"], r["hdi_hi"]) == (x[at], x[at + m - 1])
        assert r["ks"] == pytest.approx(max(np.abs(np.arange(n) / n - u).max(), np.abs(np.arange(1, n + 1) / n - u).max()))


def test_temperatures(spark):
    t = [r[0] for r in spark.range(1, 9).select(tempering.temperature(F.col("id"), 8, 2, 20.0)).collect()]
    assert t[:2] == [1.0, 1.0] and abs(t[-1] - 20) < 1e-12 and np.allclose(np.diff(np.log(t[1:])), np.log(20) / 6)
    assert pd.notna(t).all()


@pytest.mark.parametrize("low,high,sd", [(-1.0, 1.0, 0.3), (0.0, 2.0, 1.0), (-3.0, 0.5, 2.0)])
def test_distance_of_uniform_and_normal(low, high, sd):
    x = np.linspace(low, high, 200_001)
    normal = np.exp(-(x**2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))
    overlap = np.trapezoid(np.sqrt(normal / (high - low)), x)
    assert abs(order_stats.hellinger_uniform_normal(low, high, sd) - math.sqrt(1 - overlap)) < 1e-8
