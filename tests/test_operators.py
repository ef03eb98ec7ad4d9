"""Hand-computable cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.functions import geo
from stratum.operators import directional, forward, graph, grid, index, interpolate, locate, moments, nearest, order_stats, residuals, sampler, select, statics
from stratum.sources import chains, config, text, vtk


def frame(spark, values, name="x"):
    return spark.createDataFrame([(1, float(v)) for v in values], f"k int, {name} double")


def stat(spark, values, expr):
    return order_stats.sorted_samples(frame(spark, values), ["k"], F.col("x")).select(expr).first()[0]


def test_moments(spark):
    r = moments.moments(frame(spark, [1, 2, 2, 7, 11]), ["k"], F.col("x")).first()
    assert r["mean"] == pytest.approx(4.6)
    assert r["sd"] == pytest.approx(3.826225, abs=1e-6)
    assert r["skewness"] == pytest.approx(0.693232, abs=1e-6)


def test_moments_of_a_constant(spark):
    r = moments.moments(frame(spark, [3, 3]), ["k"], F.col("x")).first()
    assert r["sd"] == 0 and math.isnan(r["skewness"])


def test_intervals(spark):
    s = F.col("s")
    assert stat(spark, [1, 2, 2, 7, 11], order_stats.quantile(s, 0.25)) == 2
    lo, hi = order_stats.densest_interval(s, 0.8)
    assert (stat(spark, [0, 1, 2, 3, 10], lo), stat(spark, [0, 1, 2, 3, 10], hi)) == (0, 3)
    assert (stat(spark, [0, 1, 2, 3, 4], lo), stat(spark, [0, 1, 2, 3, 4], hi)) == (0, 3)
    a, b = order_stats.median_interval(s, 0.8)
    assert (stat(spark, range(11), a), stat(spark, range(11), b)) == pytest.approx((1, 9))
    a, b = order_stats.low_high_interval(s, 0.8)
    assert (stat(spark, range(11), a), stat(spark, range(11), b)) == pytest.approx((8, 2))


def test_distances_to_uniform(spark):
    s = F.col("s")
    assert stat(spark, [0.5, 1.5, 2.5, 3.5], order_stats.hellinger_uniform(s, 0.0, 4.0)) == pytest.approx(0)
    assert stat(spark, [0.25, 0.5, 0.75, 1.0], order_stats.kolmogorov_uniform(s, 0.0, 1.0)) == pytest.approx(0.25)
    cdf = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 4))
    assert 0 <= stat(spark, [0.1, 0.9, 1.7, 3.9], order_stats.hellinger(s, cdf)) <= 1
    assert 0 < order_stats.hellinger_uniform_normal(-1.0, 1.0, 0.1) < 1


def test_mode_ties_take_the_lowest_bin(spark):
    s = order_stats.sorted_samples(frame(spark, [1, 1, 5, 5, 9]), ["k"], F.col("x"))
    assert order_stats.binned_mode(s, ["k"], F.lit(1.0)).first()["mode"] == 1
    same = order_stats.sorted_samples(frame(spark, [4, 4, 4]), ["k"], F.col("x"))
    assert order_stats.binned_mode(same, ["k"]).first()["mode"] == 4


def test_rint_is_half_even(spark):
    assert [r[0] for r in frame(spark, [2.5, 3.5, -0.5]).select(F.rint("x")).collect()] == [2, 4, 0]


def test_residuals(spark):
    r = spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 2.0)], "k int, r double, s double")
    assert residuals.weighted_average(r, ["k"], F.col("r"), F.col("s")).first()["shift"] == pytest.approx(1.4)
    w = spark.createDataFrame([(1, p, p + d) for p, d in ((1.0, 3.0), (2.0, 5.0), (4.0, 9.0))], "e int, p double, s double")
    row = residuals.wadati(w, "e", F.col("p"), F.col("s")).first()
    assert (row["slope"], row["intercept"], row["origin_time"]) == pytest.approx((2, 1, -0.5))
    a = frame(spark, [10, 100, 190])
    assert residuals.azimuthal_gap(a, "k", F.col("x")).first()["gap"] == 180
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "e string, v double")
    assert sorted(x["demeaned"] for x in interpolate.demeaned(d, ["e"], "v").collect()) == [-1, 0, 1]


def test_group_means_skip_nan(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("nan"))], "e string, v double")
    got = {r["e"]: (r["mean"], r["n"]) for r in interpolate.group_means(d, ["e"], "v").collect()}
    assert got["a"] == (1.0, 1) and math.isnan(got["b"][0]) and got["b"][1] == 0


def test_reference_values(spark):
    k = spark.createDataFrame([(10.0, 1.0), (0.0, 3.0)], "r double, v double")
    q = spark.createDataFrame([(5.0,), (12.0,), (-1.0,), (10.0,), (0.0,)], "at double")
    got = {r["at"]: r["v"] for r in interpolate.reference_values(q, k, "at", "r", ["v"]).collect()}
    assert got == {5.0: 2.0, 12.0: 1.0, -1.0: 3.0, 10.0: 1.0, 0.0: 3.0}


def test_nearest_takes_the_lowest_index(spark):
    p = spark.createDataFrame([(1, 0.0)], "point_ix int, x double")
    n = spark.createDataFrame([(1, -1.0, 10.0), (2, 1.0, 20.0)], "nucleus_ix int, x double, v double")
    assert nearest.nearest_cells(p, n, [], ["x"]).first()["nucleus_ix"] == 1


@pytest.mark.parametrize("models,points", [(200_000, 200_000), (30, 17)])
def test_nearest_equals_all_pairs(spark, monkeypatch, models, points):
    monkeypatch.setattr(nearest, "MODELS", models)
    monkeypatch.setattr(nearest, "POINTS", points)
    rng = np.random.default_rng(0)
    at = np.round(rng.random((60, 3)), 1)  # places that are equally near, and equal ones
    cells = np.round(rng.random((300, 3)), 1)
    p = spark.createDataFrame([(i, *map(float, x), "mine") for i, x in enumerate(at)] + [(99, None, 0.0, 0.0, "mine")], "point_ix int, x double, y double, z double, model string")
    n = spark.createDataFrame([("ab"[i % 2], i % 3, i, *map(float, x), f"v{i}") for i, x in enumerate(cells)], "chain string, iteration int, nucleus_ix int, x double, y double, z double, v string")
    got = {(r["point_ix"], r["chain"], r["iteration"]): r for r in nearest.nearest_cells(p, n, ["chain", "iteration"], ["x", "y", "z"]).collect()}
    assert len(got) == 60 * 6
    for (i, chain, iteration), r in got.items():
        own = [k for k in range(300) if "ab"[k % 2] == chain and k % 3 == iteration]
        d2 = [float((at[i, 0] - c[0]) * (at[i, 0] - c[0]) + (at[i, 1] - c[1]) * (at[i, 1] - c[1]) + (at[i, 2] - c[2]) * (at[i, 2] - c[2])) for c in cells[own]]
        k = own[int(np.argmin(d2))]
        assert (r["nucleus_ix"], r["v"], r["d2"]) == (k, f"v{k}", min(d2))
    assert nearest.nearest_cells(p.limit(0), n, ["chain"], ["x"]).count() == nearest.nearest_cells(p, n.limit(0), ["chain"], ["x"]).count() == 0


def test_geodesics(spark):
    one = spark.range(1)
    d, a = one.select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2)), geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2))).first()
    assert (d, a) == pytest.approx((math.pi / 2, math.pi / 2))
    lat, lon = one.select(*geo.destination(F.lit(-math.pi / 2), F.lit(0.0), F.lit(0.3), F.lit(1.0))).first()
    assert (lat, lon) == pytest.approx((-math.pi / 2 + 0.3, 1.0))


def test_lattice_index_there_and_back(spark):
    ix = geo.linear_index(F.lit(2), F.lit(3), F.lit(2), 2, 3)
    assert spark.range(1).select(ix).first()[0] == 12
    assert tuple(spark.range(1).select(*geo.lattice_index(F.lit(12), 2, 3)).first()) == (2, 3, 2)


def test_path_integral(spark):
    n = spark.createDataFrame([(1, i, 1 / u, s) for i, (u, s) in enumerate(((1.0, 2.0), (2.0, 3.0), (4.0, None)), 1)], "ray_id int, node_ix int, Vp double, seg_len double")
    assert forward.predicted(n, "tt_P_Vp").first()["predicted"] == pytest.approx(12)
    with pytest.raises(ValueError):
        forward.predicted(n, "tt_P_nothing")
    with pytest.raises(ValueError):
        forward.predicted(n, "tt_S_Vs")


def test_directional_tensor(spark):
    s = spark.createDataFrame([(1, 1.0, 0.0, 0.0)] * 3, "k int, f double, az double, el double")
    t = directional.mean_tensor(s, ["k"], F.col("f"), F.col("az"), F.col("el"))
    r = directional.with_axes(t).first()
    assert (r["t11"], r["t22"], r["t33"], r["bias"]) == pytest.approx((1, 0, 0, 1))
    assert (abs(r["x3"]), r["lambda3"]) == pytest.approx((1, 1))
    even = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 1.0, math.pi / 2, 0.0), (1, 1.0, 0.0, math.pi / 2)], "k int, f double, az double, el double")
    t = directional.mean_tensor(even, ["k"], F.col("f"), F.col("az"), F.col("el"))
    assert t.select(directional.bias()).first()[0] == pytest.approx(0, abs=1e-7)


def test_axes_diagonalise(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 3, 3))
    m = m + m.transpose(0, 2, 1)
    rows = [(i, *map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2]))) for i, a in enumerate(m)]
    t = spark.createDataFrame(rows, "k int, " + ", ".join(f"{p} double" for p in directional.PARTS))
    for r in directional.with_axes(t).collect():
        for j in (1, 2, 3):
            v = np.array([r[f"{c}{j}"] for c in "xyz"])
            assert np.allclose(m[r["k"]] @ v, r[f"lambda{j}"] * v)
        assert abs(r["lambda1"]) <= abs(r["lambda2"]) <= abs(r["lambda3"])


def test_selections(spark):
    m = spark.createDataFrame([(1, i) for i in range(11)], "chain int, iteration int")
    assert select.drop_burn_in(m, ["chain"], ["iteration"], 6).count() == 5
    assert spark.range(1).select(select.within(F.lit(7.0), 0.0, 0.0)).first()[0] is True
    p = select.positioned(spark.createDataFrame([(3,), (1,), (2,)], "v int"), ["v"])
    assert {(r["v"], r["position"]) for r in p.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_last_duplicate(spark):
    o = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "event int, n int, v double")
    assert index.last_of_duplicates(o, ["event"], ["n"]).first()["v"] == 6


def test_ladder_and_swap():
    assert sampler.ladder(3, 1, 10.0) == pytest.approx([1, math.sqrt(10), 10])
    cold, hot = {"misfit": 10.0, "temperature": 1.0, "noise": 1.0}, {"misfit": 2.0, "temperature": 5.0, "noise": 1.0}
    assert sampler.swapped(cold, hot, 10, math.log(0.99)) and not sampler.swapped(hot, cold, 10, math.log(0.99)) is False


def test_flat_likelihood_samples_the_prior(spark):
    f = sampler.Field("v", -1.0, 1.0, (-0.1, 0.1), (0.0, 0.2), (6000.0, 6371.0))
    s = sampler.Settings(iterations=3000, save_every=20, step=0.5, nuclei=(5, 10), fields=(f,))
    models, cells = sampler.run(spark, s, chains=4, seed=3)
    assert models.count() == 4 * 151
    r = cells.agg(F.avg("v"), F.min("v"), F.max("v"), F.stddev_pop("v")).first()
    assert abs(r[0]) < 0.15 and r[1] >= -1 and r[2] <= 1 and abs(r[3] - 1 / math.sqrt(3)) < 0.1
    n = cells.where("iteration > 500").groupBy("chain", "iteration").count().agg(F.avg("count")).first()[0]
    assert 5.5 < n < 9.5


def test_rays_are_fitted(spark):
    cols = {"lat": np.zeros(4), "lon": np.zeros(4), "r": np.array([6100.0, 6200.0, 6250.0, 6300.0]), "seg_len": np.array([100.0, 0.0, 50.0, 0.0]), "vp1d": np.full(4, 5.0)}
    rays = sampler.Rays(cols, np.array([0, 2]), np.array([100 / 5.5, 50 / 5.5]), lambda v, c: 1 / ((1 + v["dlnVp"]) * c["vp1d"]))
    f = sampler.Field("dlnVp", -0.2, 0.2, (0.0, 0.0), (0.0, 0.0), (6000.0, 6371.0))
    s = sampler.Settings(iterations=1500, save_every=100, nuclei=(2, 6), noise_guess=0.05, rays=rays, fields=(f,), rescale=4.0)
    models, _ = sampler.run(spark, s, chains=2, seed=4)
    assert models.where("iteration >= 1000").agg(F.avg("misfit")).first()[0] < 20


def test_local_updates_equal_whole_predictions():
    rng = np.random.default_rng(2)
    n_rays, size = 60, rng.integers(2, 30, 60)
    n = int(size.sum())
    cols = {"lat": rng.uniform(-0.3, 0.3, n), "lon": rng.uniform(0, 0.5, n), "r": rng.uniform(5900, 6371, n), "seg_len": rng.uniform(1, 50, n), "vp1d": np.full(n, 6.0)}
    p, d = (lambda v, c: 1 / ((1 + v["a"]) * c["vp1d"])), (lambda v, c: 1 / ((1 + v["a"] * 0.5 + v["b"]) * c["vp1d"]))
    rays = sampler.Rays(cols, np.cumsum(size) - size, rng.uniform(10, 100, n_rays), (p, d), rng.integers(0, 2, n_rays), rng.integers(0, 7, n_rays), rng.integers(0, 5, n_rays))
    fields = (sampler.Field("a", -0.1, 0.1, (-0.2, 0.2), (0.1, 0.4), (6000.0, 6371.0), outside=0.0), sampler.Field("b", -0.1, 0.1, (0.0, 0.0), (0.0, 0.0), (5900.0, 6371.0)))
    for damping, rescale in ((None, None), (2.0, 4.0)):
        s = sampler.Settings(iterations=1000, save_every=100, step=0.3, nuclei=(4, 30), noise_guess=(8.0, 9.0), sample_noise=True, rays=rays, fields=fields, rescale=rescale, statics=(200, 150, damping), hot_steps=True)
        c = sampler.Chain(1, s, 1.5, 3)
        actions = set()
        for _ in range(1000):
            before = c.accepted
            c.iterate(s)
            actions.add(len(c.values[0]) - len(c.values[1]))
            if c.accepted > before or c.iteration % 100 == 0:
                assert c.misfit == pytest.approx(c.misfit_of(s), rel=1e-12)
        near, far, at, u, predicted = c.whole(s)
        assert all(np.array_equal(x, y) for x, y in zip(near + far + at, c.near + c.far + c.at)) and np.allclose(u, c.u) and np.allclose(predicted, c.predicted)
        assert c.accepted > 50 and len(actions) > 2 and c.static.any() and len(c.noise) == 2


def test_influenced_nodes_only(monkeypatch):
    """A proposal asks for the slowness of nodes whose nucleus or value changes, and of no others."""
    asked = []
    cols = {"lat": np.zeros(100), "lon": np.zeros(100), "r": np.linspace(6000, 6371, 100), "seg_len": np.ones(100), "vp1d": np.full(100, 5.0)}
    rays = sampler.Rays(cols, np.arange(0, 100, 10), np.ones(10), lambda v, c: asked.append(len(v["a"])) or 1 / c["vp1d"] / (1 + v["a"]))
    s = sampler.Settings(iterations=50, save_every=10, nuclei=(10, 12), rays=rays, fields=(sampler.Field("a", -0.1, 0.1, (0.0, 0.0), (0.0, 0.0), (6000.0, 6371.0)),))
    c = sampler.Chain(1, s, 1.0, 1)
    asked.clear()
    for _ in range(50):
        c.iterate(s)
    assert asked and np.mean(asked) < 40 and max(asked) < 100


def test_forward_functions_of_arrays_equal_plans(spark):
    rng = np.random.default_rng(4)
    names = sorted({f for x in forward.REGISTRY.values() for f in x.fields} - {"r"}) + ["azimuth", "elevation", "polarization"]
    rows = [{c: float(v) for c, v in zip(names, rng.uniform(0.01, 0.2, len(names)))} | {"Vp": 6.0 + i, "Vs": 3.0, "Vp2Vs": 1.7, "vp1d": 6.5, "vs1d": 3.6, "r": 6300.0, "n": i} for i in range(6)]
    df = spark.createDataFrame(rows).orderBy("n")
    cols = {c: np.array([r[c] for r in rows]) for c in rows[0]}
    got = df.select(*(x.slowness().cast("double").alias(name) for name, x in forward.REGISTRY.items())).toPandas()
    assert len(got.columns) == 29
    for name in forward.REGISTRY:
        assert np.allclose(got[name], forward.slowness(name, cols), rtol=1e-12), name


def test_whole_run(spark, tmp_path):
    from stratum.operators import inversion
    from stratum.plans import solve

    sf = "/root/testdata/sf0.001"
    nodes, observations, references = solve.supplier_rays(spark, sf)
    text = solve.RUN.replace('name = "delays"', 'type = "delays"').replace("forward_name", "forward_function").replace("noise_guess", "tf_event_demean = true\ntf_event_statics = true\ndata_uncertainty").replace('name = "dlnVp"', 'field = "dlnVp"')
    for a, b in (("vlims", "pdf_parameters"), ("theta_lims", "lat_lims"), ("phi_lims", "lon_lims"), ("r_lims", "elv_lims"), ("num_iterations = 1000", "num_iterations = 200\ntf_squeeze = true"), ("save_interval = 100", "save_interval = 50"), ("num_chains = 4", "num_chains = 2")):
        text = text.replace(a, b)
    text += "[StaticCorrections]\nstatic_start = 50\nstatic_interval = 50\n[ParallelTempering]\ntf_parallel_tempering = true\nnum_cold = 1\nmax_temp = 3.0\nswap_interval = 100\n[DelayedRejection]\ntf_delayed_rejection = true\n"
    c = config.parse(text)
    path = str(tmp_path / "run")
    for chunk in (1, 2):
        models, cells = inversion.run(spark, c, nodes, observations, references, path, chunk)
    saved = chains.load(spark, path, "models")
    assert saved.groupBy("chain").count().orderBy("chain").collect() == [(i, 5) for i in (1, 2, 3, 4)]
    metrics = chains.load_metrics(spark, path, 1).collect()
    assert len(metrics) == 16 and all(m["nuclei"] >= 4 for m in metrics)
    g = grid.lattice(spark, (-0.2, 0.2, 3), (0.0, 0.3, 2), (5900.0, 6371.0, 2))
    e = inversion.ensemble(saved, chains.load(spark, path, "cells"), g, c, 1, squeeze=True).collect()
    assert len(e) == 12 and all(r["n"] == 16 and -0.05 <= r["mean"] <= 0.05 for r in e) and all(r["mean"] == r["sd"] == 0 for r in e if r["node_ix"] <= 6)
    chains.save_model_grid(g, path, 100)
    assert spark.read.parquet(f"{path}/grid").count() == 12 and "tt_P_dlnVp" in "".join(r["value"] for r in spark.read.text(f"{path}/config").collect())
    full = inversion.build_rays(nodes, observations, {"delays": "tt_P_dlnVp"}, references)
    less = inversion.demeaned(full, inversion.build_fields(c), [0])
    assert len(full.first) == observations.count()
    predicted = observations.select("obs_name", "ray_id").withColumn("predicted", F.lit(0.0))
    by_plan = inversion.demeaned_residuals(observations, predicted).orderBy("event_id", "station_id").toPandas()["value"]
    shift = full.observed - observations.orderBy("event_id", "station_id").toPandas()["value"]
    assert np.allclose(less.observed - shift, by_plan)


def test_long_paths_double(spark):
    n = 200
    tree = spark.createDataFrame([(s, "P", i, i - 1) for s in (1, 2) for i in range(1, n + 1)], "source long, phase string, node_ix long, prev long")
    receivers = spark.createDataFrame([(1, "P", n), (2, "P", n), (2, "P", 77), (2, "P", 1)], "source long, phase string, receiver long")
    got = {}
    for r in graph.paths(tree, receivers).collect():
        got.setdefault((r["source"], r["receiver"]), {})[r["seq"]] = r["node_ix"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {(s, r): list(range(r, 0, -1)) for s, r in ((1, n), (2, n), (2, 77), (2, 1))}


def test_traced_paths_equal_those_of_trees(spark):
    g = grid.lattice(spark, (-0.02, 0.02, 4), (0.0, 0.03, 3), (6300.0, 6371.0, 3)).withColumn("v", 5 + F.col("node_ix") % 4)
    receivers = spark.createDataFrame([(s, "P", r) for s in (1, 30) for r in range(1, 37)], "source long, phase string, receiver long")
    t = graph.trees(g, spark.createDataFrame([(1,), (30,)], "source long"), (4, 3, 3), {"P": "v"})
    want = sorted(tuple(r) for r in graph.paths(t, receivers).collect())
    assert sorted(tuple(r) for r in graph.traced(g, receivers, (4, 3, 3), {"P": "v"}, side=2).collect()) == want


def test_columns_of_any_name_stay(spark):
    m = spark.createDataFrame([(1, i, 10 * i, "x", 2.5) for i in range(5)], "chain int, iteration int, _n int, _part string, _m double")
    assert sorted(r["_n"] for r in select.drop_burn_in(m, ["chain"], ["iteration"], 2).collect()) == [20, 30, 40]
    assert sorted(r["_n"] for r in select.trailing(m, ["chain"], ["iteration"], 2).collect()) == [30, 40]
    p = select.positioned(m, ["iteration"]).orderBy("position").collect()
    assert [(r["_n"], r["_part"], r["position"]) for r in p] == [(10 * i, "x", i + 1) for i in range(5)]
    assert all(r["_m"] == 2.5 for r in interpolate.demeaned(m, ["chain"], "_n").collect())


def test_short_tables_are_checked(spark, monkeypatch):
    monkeypatch.setattr(select, "SHORT", 3)
    with pytest.raises(ValueError):
        select.short(spark.range(4))
    assert select.short(spark.range(3)).count() == 3


def test_readers_of_stations_and_observations(spark, tmp_path):
    (tmp_path / "sta").write_text("7 45.0 -120.0 1.5\n\n 8  46.0 -121.0 0.0\n9 1.0\n")
    (tmp_path / "obs").write_text("1 7 0.25 P\n2 8 -0.5 S\n")
    s = text.read_stations(spark, str(tmp_path / "sta")).orderBy("station_id").collect()
    assert [(r["station_id"], r["elevation"]) for r in s] == [(7, 1.5), (8, 0.0)] and s[0]["latitude"] == pytest.approx(math.pi / 4)
    o = text.read_observations(spark, {"a": str(tmp_path / "obs"), "b": str(tmp_path / "obs")}).orderBy("obs_name", "event_id").collect()
    assert [tuple(r) for r in o] == [(n, *x) for n in "ab" for x in ((1, 7, 0.25, "P"), (2, 8, -0.5, "S"))]


def test_small_selections(spark):
    m = spark.createDataFrame([(1, 1.0), (2, 3.0)], "chain int, temperature double")
    assert [r["chain"] for r in select.cold(m).collect()] == [1]
    assert select.is_radial({"lat": (0, 0), "lon": (1, 1)}) and not select.is_radial({"lat": (0, 1), "lon": (1, 1)})
    v = spark.createDataFrame([(1, 8.0), (2, 0.0)], "node_ix int, vp double")
    assert [r["node_ix"] for r in select.without_air(v).collect()] == [1]
    xyz = spark.createDataFrame([(6371.0, 0.0, 0.0), (0.0, 6371.0, 0.0)], "x double, y double, z double")
    limits = {"lat": (-0.1, 0.1), "lon": (-0.1, 0.1), "r": (6000.0, 6400.0)}
    assert [r["x"] for r in xyz.where(select.in_cartesian_box(F.col("x"), F.col("y"), F.col("z"), limits)).collect()] == [6371.0]
    plain = {"lat": (0.0, 7000.0), "lon": (0.0, 0.0), "r": (-1.0, 1.0)}
    assert xyz.where(select.in_cartesian_box(F.col("x"), F.col("y"), F.col("z"), plain, geographic=False)).count() == 2
    assert grid.upscaled((3, 4, 1), 2) == (5, 7, 1)
    assert [locate.due(i, True, 10, 5) for i in (0, 5, 10, 12, 15)] == [True, False, True, False, True] and not locate.due(0, False, 10, 5)
    events = spark.createDataFrame([(1, 5.0), (2, -3.0)], "event_id int, t0 double")
    assert grid.time_limits(events) == (-3.0, 5.0)


def test_tracing_grid(spark):
    places = spark.createDataFrame([(0.0, 0.1, 6371.0), (0.0, 0.1, 6371.0), (0.01, 0.1, 6300.0)], "lat double, lon double, r double")
    plain = grid.lattice(spark, (-0.1, 0.1, 4), (0.0, 0.2, 4), (6000.0, 6371.0, 4)).orderBy("node_ix").collect()
    made = grid.tracing_grid(spark, (-0.1, 0.1, 4), (0.0, 0.2, 4), (6000.0, 6371.0, 4), places, jitter=0.5).orderBy("node_ix").collect()
    assert len(made) == 66 and [r["node_ix"] for r in made] == list(range(1, 67)) and all(r["i"] == r["j"] == r["k"] == 0 for r in made[64:])
    moved = [abs(a["lat"] - b["lat"]) for a, b in zip(plain, made)]
    assert max(moved) <= 0.25 * 0.2 / 3 + 1e-12 and any(moved) and all(m == 0 for m, a in zip(moved, plain) if a["i"] in (1, 4))


def test_which_ends_are_sources():
    assert index.sources_are_events(3, 5, False, False) and not index.sources_are_events(5, 3, False, False)
    assert not index.sources_are_events(3, 5, True, False) and index.sources_are_events(5, 3, True, True)


def test_shortest_times_agree(spark):
    g = grid.lattice(spark, (-0.02, 0.02, 4), (0.0, 0.03, 3), (6300.0, 6371.0, 3)).withColumn("v", 5 + F.col("node_ix") % 4)
    e = graph.edges(g, grid.neighbours(g, 4, 3, 3))
    source = spark.createDataFrame([(1, 1)], "source long, node long")
    a = {r["node"]: r["time"] for r in graph.shortest_times(e, source).collect()}
    tree = graph.trees(g, spark.createDataFrame([(1,)], "source long"), (4, 3, 3), {"P": "v"})
    b = {r["node_ix"]: r["time"] for r in tree.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    p = graph.paths(tree, spark.createDataFrame([(1, "P", 36)], "source long, phase string, receiver long")).orderBy("seq").collect()
    assert p[0]["node_ix"] == 36 and p[-1]["node_ix"] == 1


def test_hull():
    assert len(graph.hull(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)], float))) == 4


def test_location(spark):
    g = grid.lattice(spark, (-0.02, 0.02, 4), (0.0, 0.03, 3), (6300.0, 6371.0, 3))
    events = spark.createDataFrame([(1, 2, 2, 2, 0.0, 0.0, 0.0, 5.0)], "event_id int, i long, j long, k long, lat double, lon double, r double, t0 double")
    times = spark.createDataFrame([(s, "P", n, float((s * s * 7 + n * n * 5 + s * n) % 23)) for s in range(6) for n in range(1, 37)], "station_id int, phase string, node_ix long, time double")
    arrivals = times.where("node_ix = 20").select(F.lit(1).alias("event_id"), "station_id", "phase", (F.col("time") + 3).alias("observed"), F.lit(0.5).alias("sigma"))
    new, shifted = locate.relocated(events, arrivals, g, times, 2)
    row = new.first()
    assert (row["node_ix"], row["shift"], row["t0"]) == (20, pytest.approx(3), pytest.approx(8))
    assert shifted.agg(F.max(F.abs(F.col("observed")))).first()[0] <= 23


def test_long_paths_are_an_error(spark):
    tree = spark.createDataFrame([(1, "P", i, i - 1) for i in range(1, 6)], "source long, phase string, node_ix long, prev long")
    receiver = spark.createDataFrame([(1, "P", 5)], "source long, phase string, receiver long")
    assert [r["node_ix"] for r in graph.paths(tree, receiver, most=4).orderBy("seq").collect()] == [5, 4, 3, 2, 1]
    with pytest.raises(ValueError):
        graph.paths(tree, receiver, most=3)


def test_followed_over_gaps_and_ranges(spark):
    ids = [0, 1, 5, 9_998, 9_999, 10_000, 30_500, 30_501, 89_999, 90_000]
    rows = [(i, None if i == 30_501 else float(i)) for i in ids]
    got = index.followed(spark.createDataFrame(rows, "id long, v double"), "id", "v", "after").orderBy("id").collect()
    assert [(r["id"], r["v"], r["after"]) for r in got] == [(*a, b[1]) for a, b in zip(rows, rows[1:])]


def test_joint_statics_recover(spark):
    rng = np.random.default_rng(2)
    ev, st = rng.normal(size=8), rng.normal(size=6)
    st -= st.mean()
    rows = [("P", i, j, float(ev[i] + st[j])) for i in range(8) for j in range(6)]
    r = spark.createDataFrame(rows, "obs_name string, event_id long, station_id long, r double")
    got = {(x["kind"], x["id"]): x["value"] for x in statics.joint_statics(r, {"P": 0.1}, 1e3).collect()}
    assert all(abs(got["station", j] - st[j]) < 1e-3 for j in range(6)) and all(abs(got["event", i] - ev[i]) < 1e-3 for i in range(8))


def test_text_round_trip(spark, tmp_path):
    p = tmp_path / "evt.dat"
    p.write_text("  1   10.0  20.0  5.0\n2 11.0 21.0 6.0\n3 12\n")
    got = text.read_events(spark, str(p)).collect()
    assert len(got) == 2 and got[0]["elevation"] == -5 and got[0]["latitude"] == pytest.approx(math.radians(10))
    good, short = text.read_acquisition(spark, str(p), "long", depth=True)
    assert good.count() == 2 and short.first()["line"] == "3 12"
    v = tmp_path / "vel.dat"
    v.write_text("6371 5.0 3.0\n6300 6.0 3.5")
    assert text.read_reference(spark, str(v)).count() == 2
    seven = tmp_path / "seven.csv"
    seven.write_text("1.0,0.1,10,P,e1,s1,BHZ\n1,2,3\n")
    good, short = text.read_seven_columns(spark, str(seven))
    assert good.count() == 1 and short.count() == 1
    out = str(tmp_path / "out")
    text.write_lines(text.observation_lines(spark.createDataFrame([("a", "b", 1.5, "P")], "event_id string, station_id string, observation double, phase string")), out)
    assert text.read_arrivals(spark, out)[0].first()["observation"] == 1.5


def test_config():
    c = config.parse('out_directory="o"\nrun_id="r"\n[[DataFields]]\nname="a"\nfile="f"\nforward_name="tt_P_dlnVp"\n[[ParameterFields]]\nname="dlnVp"\nprior="uniform"\nvlims=[-0.1,0.1]\n[MonteCarloSolver]\nn=3\n')
    config.check(c, set(forward.REGISTRY))
    assert c.sections["MonteCarloSolver"]["n"] == 3 and '"run_id": "r"' in config.to_json(c)
    with pytest.raises(ValueError):
        config.parse('run_id="r"')
    with pytest.raises(ValueError):
        config.check(config.parse('out_directory="o"\nrun_id="r"\n[[DataFields]]\nname="a"\nfile="f"\nforward_name="tt_P_Vp"'), set(forward.REGISTRY))


def test_registry_names_its_fields():
    for name, f in forward.REGISTRY.items():
        assert set(config.required_fields(name)) == set(f.fields), name


def test_chains_and_vtk(spark, tmp_path):
    m = spark.createDataFrame([(c, i, float(i)) for c in (1, 2) for i in range(5)], "chain int, iteration long, misfit double")
    chains.save({"models": m}, str(tmp_path / "c"))
    assert chains.load(spark, str(tmp_path / "c"), "models", num_burn=2).count() == 6
    assert chains.chain_number(4, 2, 1) == 5
    g = grid.lattice(spark, (0.0, 1.0, 2), (0.0, 1.0, 2), (1.0, 2.0, 2)).select("node_ix", "x", "y", "z", F.col("r").alias("mean_v"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(3.0).alias("c"))
    path = str(tmp_path / "g.vts")
    vtk.write(g, path, (2, 2, 2), "node_ix", vectors={"axis": ["a", "b", "c"]})
    back, dims = vtk.read(spark, path, ["mean_v", "axis"])
    assert dims == (2, 2, 2) and back.count() == 8 and {"mean_v", "axis_1", "axis_3"} <= set(back.columns)
    assert abs(back.agg(F.sum("mean_v")).first()[0] - 12) < 1e-9
    with pytest.raises(FileExistsError):
        vtk.write(g, path, (2, 2, 2), "node_ix")


def test_stream_of_samples(spark, tmp_path):
    from stratum.streaming import chains as streams

    d = spark.createDataFrame([(1, float(x)) for x in (1, 2, 2, 7, 11)], "point int, v double")
    d.repartition(3).write.parquet(str(tmp_path / "s"))
    q = streams.started(streams.running_moments(streams.growing(spark, str(tmp_path / "s"), d.schema, 1), ["point"], "v"), "running")
    q.processAllAvailable()
    assert spark.table("running").first()["mean"] == pytest.approx(4.6)
    q.stop()


def test_rays_are_built(spark):
    from stratum.operators import rays

    paths = spark.createDataFrame([(1, i, 6000.0 + 53 * i, 0.0, 0.0, float(i)) for i in range(8)] + [(2, 1, 6300.0, 0.0, 0.0, 0.0), (2, 2, 6300.0, 10.0, 0.0, 1.0)], "ray_id int, node_ix int, x double, y double, z double, t double")
    knots = spark.createDataFrame([(6371.0, 5.0, 3.0), (6000.0, 8.71, 4.0)], "radius double, vp double, vs double")
    n = rays.build(paths, knots, spacing=100.0, polarization=spark.createDataFrame([(1, 0.5)], "ray_id int, zeta double"))
    one = n.where("ray_id = 1").orderBy("node_ix").collect()
    assert len(one) == 4 and one[0]["seg_len"] == pytest.approx(371 / 3) and one[3]["seg_len"] is None
    assert all(r["elevation"] == pytest.approx(math.pi / 2) and r["polarization"] == 0.5 for r in one)
    assert one[1]["vp1d"] == pytest.approx(8.71 - 3.71 / 3)
    two = n.where("ray_id = 2").orderBy("node_ix").collect()
    assert len(two) == 2 and two[0]["azimuth"] == pytest.approx(0, abs=1e-2) and two[0]["polarization"] == 0
    trimmed = rays.build(paths, knots, inside=F.col("x") > 6200)
    assert trimmed.where("ray_id = 1").agg(F.min("x")).first()[0] == 6212.0


def test_neighbours_in_radius(spark):
    from stratum.operators import rays

    c = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 9.0)], "nucleus_ix int, r double").withColumn("m", F.lit(1))
    got = {r["nucleus_ix"]: (r["below"], r["above"]) for r in rays.radial_neighbours(c, ["m"]).collect()}
    assert got == {2: (None, 1), 1: (2, 3), 3: (1, None)}


def lattice_with_places(spark):
    g = grid.lattice(spark, (-0.05, 0.05, 5), (0.0, 0.1, 5), (6171.0, 6371.0, 5))
    rows = {r["node_ix"]: r for r in g.collect()}
    spots = lambda nodes: spark.createDataFrame([(i, n, rows[n]["lat"], rows[n]["lon"]) for i, n in enumerate(nodes, 1)], "id long, node_ix long, lat double, lon double")
    return g, rows, spots


def test_rays_are_traced_and_traced_again(spark):
    from stratum.operators import inversion

    g, rows, spots = lattice_with_places(spark)
    events, stations = spots([1, 13]), spots([101, 125, 113])
    knots = spark.createDataFrame([(6371.0, 6.0, 3.5), (6000.0, 8.0, 4.5)], "radius double, vp double, vs double")
    rays = spark.createDataFrame([(i + 1, 1 + i % 2, 1 + i % 3, "PS"[i // 6]) for i in range(12)], "ray_id long, event_id long, station_id long, phase string")
    flat = g.withColumns({"vp": F.lit(7.0), "vs": F.lit(4.0)})
    for from_events in (True, False):
        n = inversion.trace(flat, (5, 5, 5), {"P": "vp", "S": "vs"}, rays, events, stations, from_events, knots).toPandas().sort_values(["ray_id", "node_ix"])
        assert n["ray_id"].nunique() == 12
        for ray, own in n.groupby("ray_id"):
            first, last = (np.array([rows[k][c] for c in "xyz"]) for k in ([1, 13][(ray - 1) % 2], [101, 125, 113][(ray - 1) % 3]))
            assert np.allclose(own[["x", "y", "z"]].iloc[0], first) and np.allclose(own[["x", "y", "z"]].iloc[-1], last)
    c = config.parse('out_directory="o"\nrun_id="r"\n[[DataFields]]\nname="a"\nfile="f"\nforward_name="tt_P_dlnVp"\n[[ParameterFields]]\nname="dlnVp"\nprior="uniform"\nvlims=[-0.1,0.1]\nr_lims=[-200.0,0.0]\n')
    models = spark.createDataFrame([(1, i, t) for i in (1, 2) for t in (1.0,)] + [(2, 1, 3.0)], "chain int, iteration int, temperature double")
    cells = spark.createDataFrame([(1, i, "dlnVp", k, 0.0, 0.02 * k, 6300.0, v) for i, v in ((1, 0.1), (2, -0.1)) for k in (1, 2)] + [(2, 1, "dlnVp", 1, 0.0, 0.0, 6300.0, 99.0)], "chain int, iteration int, field string, nucleus_ix int, lat double, lon double, r double, v double")
    v = inversion.ensemble_velocities(models, cells, g, c, knots).orderBy("node_ix").collect()
    reference = interpolate.reference_values(g, knots, "r", "radius", ["vp"]).orderBy("node_ix").collect()
    assert len(v) == 125 and all(a["vp"] == pytest.approx(b["vp"] / ((1 / 1.1 + 1 / 0.9) / 2)) for a, b in zip(v, reference))
    again = inversion.retrace(models, cells, g, (5, 5, 5), c, knots, rays, events, stations, True, carve_about=(0.0, 0.05))
    assert again.select("ray_id").distinct().count() == 12 and {"vp1d", "seg_len", "azimuth"} <= set(again.columns)


def test_prior_and_directional_file(spark, tmp_path):
    p = directional.prior_moments(spark, (0.0, 0.1), (0.0, math.pi), (-1.0, 1.0), 20_000, sine=True).first()
    assert p["bias"] < 0.1 and 0.045 < p["strength_mean"] < 0.055
    g = grid.lattice(spark, (-0.1, 0.1, 2), (0.0, 0.1, 2), (6300.0, 6371.0, 2))
    t = g.select("node_ix", *(F.lit(x).alias(n) for n, x in zip(directional.PARTS, (4.0, 0.0, 0.0, 1.0, 0.0, 0.25))))
    directional.write_directional(directional.with_axes(t), g, str(tmp_path / "a.vts"), (2, 2, 2))
    back, dims = vtk.read(spark, str(tmp_path / "a.vts"))
    r = back.first()
    assert dims == (2, 2, 2) and r["symmetry_axis_1"] == pytest.approx(2.0) and r["lambda3"] == pytest.approx(4.0) and r["directional_bias"] > 0


def test_velocity_view(spark):
    nodes = spark.createDataFrame([(1, 0.1, 0.0, 0.0), (2, 1.9, 0.0, 0.0)], "n int, x double, y double, z double")
    values = spark.createDataFrame([(i, f, 10.0 * f + i) for i in (1, 2, 3) for f in (1, 2)], "node_ix long, frame int, v double")
    frames = spark.createDataFrame([(1, 0.0), (2, 5.0)], "frame int, t double")
    got = nearest.velocity_view(nodes, values, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [3, 1, 1], ["x", "y", "z"], 4.0, frames, ["v"])
    assert sorted((r["n"], r["v"]) for r in got.collect()) == [(1, 21.0), (2, 23.0)]
