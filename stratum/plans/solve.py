"""Misfits, diagnostics, origin times, statics, graphs and samplers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.operators import forward, graph, grid, index, inversion, locate, nearest, residuals, sampler, statics, tempering
from stratum.operators.select import positioned
from stratum.plans.registry import query, r6, rounded, table
from stratum.sources import config


@query("SELECT l_returnflag AS obs, round(sum((l_quantity - 25) ^ 2), 6) AS total, round(sqrt(avg((l_quantity - 25) ^ 2)), 6) AS rms, round(sum((l_quantity - 25) ^ 2 / (1 + l_linenumber) ^ 2), 6) AS misfit FROM lineitem GROUP BY ALL")
def fit_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "obs")
    return rounded(residuals.fit_stats(li, "obs", F.col("l_quantity") - 25, (1 + F.col("l_linenumber")).cast("double")), [])


@query("SELECT l_returnflag AS obs, round(sum(abs(l_quantity - 25) ^ 3), 6) AS total, round(avg(abs(l_quantity - 25) ^ 3) ^ (1 / 3), 6) AS rms FROM lineitem GROUP BY ALL")
def lp_misfit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "obs")
    return rounded(residuals.lp_misfit(li, "obs", F.col("l_quantity") - 25, 3.0), [])


@query("SELECT l_suppkey, round(sum(l_quantity / l_linenumber ^ 2) / sum(1 / l_linenumber ^ 2), 6) AS shift FROM lineitem GROUP BY ALL")
def weighted_origin_shift(spark, sf_dir):
    return rounded(residuals.weighted_average(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_linenumber").cast("double")), [])


@query("WITH p AS (SELECT o_custkey % 25 AS event_id, o_totalprice / 10000 AS p, o_totalprice / 10000 * 1.8 + o_orderkey % 17 / 10 AS s FROM orders), g AS (SELECT event_id, regr_slope(s - p, p) AS a, regr_intercept(s - p, p) AS b FROM p GROUP BY ALL) SELECT event_id, round(a, 6) AS slope, round(b, 6) AS intercept, round(-b / a, 6) AS origin_time FROM g")
def wadati_origin(spark, sf_dir):
    p = F.col("o_totalprice") / 10000
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("event_id"), p.alias("p"), (p * 1.8 + F.col("o_orderkey") % 17 / 10).alias("s"))
    return rounded(residuals.wadati(o, "event_id", F.col("p"), F.col("s")), [])


@query("""WITH a AS (SELECT DISTINCT user_id, value % 360 AS a FROM events), d AS (SELECT user_id, a, a - lag(a) OVER (PARTITION BY user_id ORDER BY a) AS gap FROM a)
SELECT user_id, round(greatest(coalesce(max(gap), 0), 360 - (max(a) - min(a))), 6) AS gap FROM d GROUP BY ALL""")
def azimuthal_gap(spark, sf_dir):
    return rounded(residuals.azimuthal_gap(table(spark, sf_dir, "events"), "user_id", F.expr("value % 360")), [])


MODELS = "m AS (SELECT user_id % 8 AS chain, event_id AS iteration, value AS misfit, (event_id % 90)::DOUBLE AS accepted, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events)"


def models(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("chain"), F.col("event_id").alias("iteration"), F.col("value").alias("misfit"), (F.col("event_id") % 90).cast("double").alias("accepted"))


@query(f"""WITH {MODELS}, s AS (SELECT user_id % 8 AS chain, event_id AS iteration, sqrt(value * value) AS statics_rms FROM events), c AS (SELECT chain, iteration, 'vp' AS field, 3 AS cells, sqrt(3 * (iteration % 10) ^ 2) AS norm FROM m)
SELECT m.chain, iteration, (n - 1) * 100 AS step, misfit, round(statics_rms, 6) AS statics_rms, field, cells::BIGINT AS cells, round(norm, 6) AS norm FROM m JOIN s USING (chain, iteration) JOIN c USING (chain, iteration)""")
def chain_metrics(spark, sf_dir):
    m = models(spark, sf_dir)
    st = m.select("chain", "iteration", F.col("misfit").alias("value"))
    n = m.select("chain", "iteration", F.lit("vp").alias("field"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))), (F.col("iteration") % 10).cast("double").alias("v")).drop("col")
    out = residuals.chain_metrics(m, st, n, 100).select("chain", "iteration", F.col("step").cast("long").alias("step"), "misfit", "statics_rms", "field", "cells", "norm")
    return rounded(out, ["misfit"])


@query(f"WITH {MODELS} SELECT chain, iteration, round(CASE WHEN n > 1 THEN accepted / (n - 1) ELSE 0 END, 6) AS ratio FROM m")
def acceptance_ratio(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("chain").orderBy("iteration")) - 1
    m = models(spark, sf_dir).withColumn("n", n * 100)
    return m.select("chain", "iteration", r6(residuals.acceptance(F.col("accepted"), F.col("n"))).alias("ratio"))


@query(f"WITH {MODELS}, r AS (SELECT avg(misfit) AS ref FROM m WHERE n = 1) SELECT chain, iteration, round(100 * (misfit ^ 2 - ref ^ 2) / ref ^ 2, 6) AS reduction FROM m, r")
def variance_reduction(spark, sf_dir):
    m = models(spark, sf_dir).withColumn("step", F.row_number().over(Window.partitionBy("chain").orderBy("iteration")) - 1).withColumn("obs", F.lit("p"))
    return rounded(residuals.variance_reduction(m, "obs", "misfit").select("chain", "iteration", "reduction"), [])


@query("SELECT event_type, floor(value / 25) * 25 AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS probability FROM events GROUP BY event_type, floor(value / 25) * 25")
def residual_histogram(spark, sf_dir):
    h = residuals.histogram(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), 25.0)
    return h.select("event_type", F.col("bin").cast("double").alias("bin"), r6(F.col("probability")).alias("probability"))


@query("SELECT floor(n / 5) * 5 AS bin, round(count(*) / sum(count(*)) OVER (), 6) AS probability FROM (SELECT user_id, count(*)::DOUBLE AS n FROM events GROUP BY ALL) GROUP BY floor(n / 5) * 5")
def dimension_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    h = residuals.histogram(n, ["all"], F.col("n"), 5.0)
    return h.select(F.col("bin").cast("double").alias("bin"), r6(F.col("probability")).alias("probability"))


@query("""WITH s AS (SELECT user_id % 5 AS t1, user_id % 3 AS t2, event_id % 4 = 0 AS ok FROM events WHERE user_id % 5 <> user_id % 3), b AS (SELECT t1, t2, ok FROM s UNION ALL SELECT t2, t1, ok FROM s), t AS (SELECT DISTINCT t1 FROM b)
SELECT x.t1, y.t1 AS t2, round(coalesce(avg(ok::INT), 'nan'), 6) AS rate FROM t x CROSS JOIN t y LEFT JOIN b ON b.t1 = x.t1 AND b.t2 = y.t1 GROUP BY ALL""")
def swap_rates(spark, sf_dir):
    s = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("t1"), (F.col("user_id") % 3).alias("t2"), (F.col("event_id") % 4 == 0).cast("int").alias("swapped")).where("t1 <> t2")
    return rounded(residuals.swap_rates(s), [])


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY ALL")
def least_misfit(spark, sf_dir):
    return residuals.least_misfit(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("SELECT l_returnflag AS obs_name, l_suppkey AS event_id, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def event_statics(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("obs_name"), F.col("l_suppkey").alias("event_id"), F.col("l_quantity").alias("r"))
    return rounded(statics.event_statics(r), [])


#: Conjugate gradients with the same preconditioner, by recursion; a fixed number of steps, far more than the solver needs.
STATICS = """WITH RECURSIVE g(obs, sigma) AS (VALUES ('A', 0.5), ('N', 0.4), ('R', 0.3)),
p AS (SELECT obs, sigma, l_suppkey AS e, l_partkey AS s, sum(1 / sigma ^ 2) AS w, sum((l_quantity / 25 - 1) / sigma ^ 2) AS wr FROM lineitem JOIN g ON obs = l_returnflag GROUP BY ALL),
a AS (SELECT obs, 'event' AS kind, e AS id, sum(w) AS plain, sum(wr) AS b FROM p GROUP BY ALL UNION ALL SELECT obs, 'station', s, sum(w) + any_value((sigma / 0.1) ^ 2), sum(wr) FROM p GROUP BY obs, s),
tie AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT e FROM p WHERE obs = 'A') AND s_suppkey IN (SELECT e FROM p WHERE obs = 'N')),
d AS (SELECT obs, kind, id, kind || obs || id AS u, CASE WHEN kind = 'event' AND obs = 'N' AND id IN (FROM tie) THEN 'eventA' || id ELSE kind || obs || id END AS grp, CASE WHEN kind = 'event' AND obs <> 'R' AND id IN (FROM tie) THEN 1e6 ELSE 0 END::DOUBLE AS tied, plain, b FROM a),
o AS (SELECT 'event' || obs || e AS u, 'station' || obs || s AS t, w FROM p UNION ALL SELECT 'station' || obs || s, 'event' || obs || e, w FROM p UNION ALL SELECT 'eventA' || id, 'eventN' || id, -1e6 FROM tie UNION ALL SELECT 'eventN' || id, 'eventA' || id, -1e6 FROM tie),
c AS (SELECT 0 AS step, u, grp, plain, tied, 0.0::DOUBLE AS x, b AS r, z, z AS p FROM (SELECT *, cm + CASE WHEN u = grp THEN 0 ELSE b / (plain + tied) END AS z FROM (SELECT *, sum(b) OVER q / sum(plain) OVER q AS cm FROM d WINDOW q AS (PARTITION BY grp)))
  UNION ALL SELECT step + 1, u, grp, plain, tied, x2, r2, z2, z2 + p * (sum(r2 * z2) OVER () / rz) FROM (SELECT *, cm + CASE WHEN u = grp THEN 0 ELSE r2 / (plain + tied) END AS z2 FROM (SELECT *, sum(r2) OVER q / sum(plain) OVER q AS cm
    FROM (SELECT *, x + alpha * p AS x2, r - alpha * ap AS r2 FROM (SELECT *, rz / sum(p * ap) OVER () AS alpha FROM (SELECT c.*, sum(r * z) OVER () AS rz, (plain + tied) * p + coalesce(sum, 0) AS ap FROM c LEFT JOIN (SELECT o.u, sum(o.w * c.p) AS sum FROM o JOIN c ON c.u = o.t GROUP BY o.u) m USING (u) WHERE step < 40))) WINDOW q AS (PARTITION BY grp))))
SELECT obs AS obs_name, kind, id, round(x, 6) AS value FROM c JOIN d USING (u) WHERE step = 40"""


@query(STATICS)
def joint_statics(spark, sf_dir):
    """Every supplier is an event and every part a station; the events of two observables are held equal."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("obs_name"), F.col("l_suppkey").alias("event_id"), F.col("l_partkey").alias("station_id"), (F.col("l_quantity") / 25 - 1).alias("r"))
    ties = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("A").alias("obs_a"), F.lit("N").alias("obs_b"))
    return rounded(statics.joint_statics(r, {"A": 0.5, "N": 0.4, "R": 0.3}, 0.1, ties), [])


@query("WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey, round(CASE WHEN i <= 20 THEN 1 ELSE 20 ^ ((i - 20) / (n - 20)) END, 6) AS temperature FROM c")
def tempering_ladder(spark, sf_dir):
    """A chain for each customer, twenty of them cold."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    t = tempering.temperature(F.col("position"), c.count(), 20, 20.0)
    return rounded(positioned(c, ["c_custkey"]).select("c_custkey", t.alias("temperature")), [])


@query("""WITH c AS (SELECT event_id, value AS m1, lead(value) OVER (ORDER BY event_id) AS m2, 1 + event_id % 3 AS t1, 1 + event_id % 4 AS t2, (event_id % 10 + 1) / 12 AS u FROM events)
SELECT event_id, ln(u) < (1 / t1 - 1 / t2) * (m1 - m2) / 2 AS swapped FROM c WHERE m2 IS NOT NULL""")
def tempering_swap_all(spark, sf_dir):
    c = index.followed(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", "m2").where("m2 IS NOT NULL")
    t1, t2, u = 1 + F.col("event_id") % 3, 1 + F.col("event_id") % 4, (F.col("event_id") % 10 + 1) / 12
    return c.select("event_id", sampler.swap_accepted(F.col("value"), F.col("m2"), t1, t2, F.log(u)).alias("swapped"))


def part_lattice(spark, sf_dir):
    """A lattice with a node for each part: ten by ten places, as many layers as there are hundreds of parts. Its limits are those of suppliers and part sizes, its velocities come from part sizes."""
    p = table(spark, sf_dir, "part")
    k = p.agg(F.count("*").alias("n"), F.max("p_size").alias("deep"), F.min("p_size").alias("shallow")).first()
    s = table(spark, sf_dir, "supplier").agg((F.count("*") / 1000).alias("top"), (F.max("s_nationkey") / 100).alias("side")).first()
    spec = (0.0, s["top"], 10), (0.0, s["side"], 10), (6371.0 - k["deep"], 6371.0 - k["shallow"], k["n"] // 100)
    own = p.select((F.col("p_partkey") + 1).alias("node_ix"), (5 + F.col("p_size") / 25).alias("v"), "p_size")
    return grid.placed(own, *spec), spec


def nation_sources(spark, sf_dir, n):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source"), (1 + F.col("n_nationkey") * 37 % n).cast("long").alias("node"))


LATTICE = """WITH RECURSIVE dims AS (SELECT count(*) AS n, count(*) // 100 AS nz, max(p_size)::DOUBLE AS deep, min(p_size)::DOUBLE AS shallow FROM part), sup AS (SELECT count(*) / 1000 AS top, max(s_nationkey) / 100 AS side FROM supplier),
g AS (SELECT p_partkey + 1 AS node_ix, p_partkey % 10 + 1 AS i, p_partkey // 10 % 10 + 1 AS j, p_partkey // 100 + 1 AS k, 5 + p_size / 25 AS v, p_size FROM part),
q AS (SELECT g.*, top * (i - 1) / 9 AS lat, side * (j - 1) / 9 AS lon, 6371 - deep + (deep - shallow) * (k - 1) / greatest(1, nz - 1) AS r FROM g, dims, sup),
p AS (SELECT *, r * cos(lat) * cos(lon) AS x, r * cos(lat) * sin(lon) AS y, r * sin(lat) AS z FROM q),
pairs AS (SELECT a.node_ix AS a, b.node_ix AS b FROM g a JOIN g b ON b.k BETWEEN a.k - 1 AND a.k + 1 AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND a.node_ix <> b.node_ix)"""
LENGTH = "sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2)"
SLOW, FAST = f"{LENGTH} * 0.5 * (1 / a.v + 1 / b.v)", f"2 * {LENGTH} / (a.v + b.v)"
SOURCES = "SELECT n_nationkey::BIGINT AS source, 1 + n_nationkey * 37 % n AS node FROM nation, dims"


def travel_sql(weight: str = SLOW, sources: str = SOURCES, more: str = "") -> str:
    """Table best (source, node, time). Rounds: two for every layer and place, more than any path here has nodes."""
    return LATTICE + f""",{more}
e AS MATERIALIZED (SELECT pairs.a, pairs.b, {weight} AS w FROM pairs JOIN {"p" if not more else "nodes"} a ON a.node_ix = pairs.a JOIN {"p" if not more else "nodes"} b ON b.node_ix = pairs.b),
t AS (SELECT 0 AS n, source, node, 0.0::DOUBLE AS time FROM ({sources})
  UNION ALL SELECT n + 1, source, node, min(time) FROM (SELECT t.n, source, e.b AS node, time + e.w AS time FROM t JOIN e ON e.a = t.node UNION ALL SELECT n, source, node, time FROM t) WHERE n < (SELECT 40 + 2 * nz FROM dims) GROUP BY n, source, node),
best AS MATERIALIZED (SELECT source, node, min(time) AS time FROM t GROUP BY source, node)"""


@query(travel_sql() + " SELECT source, node, round(time, 6) AS time FROM best")
def shortest_time_grid(spark, sf_dir):
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    counts = lat[2], lon[2], r[2]
    sources = nation_sources(spark, sf_dir, counts[0] * counts[1] * counts[2])
    return rounded(graph.lattice_trees(g, grid.neighbours(g, *counts), sources, counts).drop("prev"), [])


@query(travel_sql(FAST) + " SELECT source, node, round(time, 6) AS time FROM best")
def shortest_time_mean_velocity(spark, sf_dir):
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    counts = lat[2], lon[2], r[2]
    sources = nation_sources(spark, sf_dir, counts[0] * counts[1] * counts[2])
    return rounded(graph.lattice_trees(g, grid.neighbours(g, *counts), sources, counts, slowness_mean=False).drop("prev"), [])


BACK = """,
back AS MATERIALIZED (SELECT x.source, e.b AS node, arg_min(e.a, (round(x.time + e.w, 9), e.a)) AS prev FROM best x JOIN e ON e.a = x.node JOIN best y ON y.source = x.source AND y.node = e.b WHERE y.time > 0 GROUP BY ALL)"""
NODE_SOURCES = "SELECT DISTINCT 1 + n_nationkey * 37 % n AS source, 1 + n_nationkey * 37 % n AS node FROM nation, dims"


def nation_trees(spark, sf_dir):
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    counts = lat[2], lon[2], r[2]
    return graph.trees(g, nation_sources(spark, sf_dir, lat[2] * lon[2] * r[2]).select(F.col("node").alias("source")).distinct(), counts, {"P": "v"}), counts


@query(travel_sql(sources=NODE_SOURCES) + BACK + " SELECT best.source, best.node AS node_ix, coalesce(prev, 0) AS prev, round(time, 6) AS time FROM best LEFT JOIN back USING (source, node)")
def shortest_time_trees(spark, sf_dir):
    return rounded(nation_trees(spark, sf_dir)[0].drop("phase"), [])


def paths_sql(receivers: str) -> str:
    return travel_sql(sources=NODE_SOURCES) + BACK + f""",
w AS (SELECT source, receiver, 0::BIGINT AS seq, receiver AS node_ix FROM ({receivers}) UNION ALL SELECT w.source, w.receiver, w.seq + 1, back.prev FROM w JOIN back ON back.source = w.source AND back.node = w.node_ix)
SELECT source, 'P' AS phase, receiver, seq, node_ix FROM w"""


@query(paths_sql("SELECT DISTINCT 1 + s_nationkey * 37 % n AS source, 1 + s_suppkey * 13 % n AS receiver FROM supplier, dims"))
def ray_paths_of_suppliers(spark, sf_dir):
    """Paths from each supplier's node to the node of its nation."""
    tree, counts = nation_trees(spark, sf_dir)
    n = counts[0] * counts[1] * counts[2]
    own = table(spark, sf_dir, "supplier").select((1 + F.col("s_nationkey") * 37 % n).cast("long").alias("source"), F.lit("P").alias("phase"), (1 + F.col("s_suppkey") * 13 % n).cast("long").alias("receiver")).distinct()
    return graph.paths(tree, own, counts=counts)


@query(paths_sql("SELECT DISTINCT 1 + c_nationkey * 37 % n AS source, 1 + c_custkey * 29 % n AS receiver FROM customer, dims"))
def ray_paths(spark, sf_dir):
    """Paths from each customer's node to the node of its nation, traced in one call."""
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    n = lat[2] * lon[2] * r[2]
    own = table(spark, sf_dir, "customer").select((1 + F.col("c_nationkey") * 37 % n).cast("long").alias("source"), F.lit("P").alias("phase"), (1 + F.col("c_custkey") * 29 % n).cast("long").alias("receiver")).distinct()
    return graph.traced(g, own, (lat[2], lon[2], r[2]), {"P": "v"})


PLACES = """
s AS (SELECT n + 1 + s_suppkey AS node_ix, top * (s_suppkey * 7 % 100 / 103) AS lat, side * (s_suppkey * 3 % 100 / 103) AS lon, 6371 - deep + (deep - shallow) * (s_suppkey * 11 % 100 / 103) AS r FROM supplier, dims, sup
  UNION ALL SELECT n + 1000000 + r_regionkey, top * (r_regionkey + 1) / 7, side * (r_regionkey + 1) / 8, 6371 - deep / (r_regionkey + 1) FROM region, dims, sup),
near AS (SELECT s.*, greatest(1, least(10, floor(lat / (top / 9) + 0.5) + 1)) AS i, greatest(1, least(10, floor(lon / (side / 9) + 0.5) + 1)) AS j, greatest(1, least(nz, floor((r - (6371 - deep)) / ((deep - shallow) / greatest(1, nz - 1)) + 0.5) + 1)) AS k FROM s, dims, sup),
links AS (SELECT near.node_ix AS a, g.node_ix AS b FROM near JOIN g ON abs(g.i - near.i) <= 1 AND abs(g.j - near.j) <= 1 AND abs(g.k - near.k) <= 1),
nodes AS (SELECT node_ix, x, y, z, v FROM p UNION ALL SELECT near.node_ix, near.r * cos(near.lat) * cos(near.lon), near.r * cos(near.lat) * sin(near.lon), near.r * sin(near.lat), g.v FROM near JOIN g ON g.i = near.i AND g.j = near.j AND g.k = near.k),
lattice_pairs AS (SELECT a, b FROM pairs UNION ALL SELECT a, b FROM links UNION ALL SELECT b, a FROM links),"""


@query(travel_sql(sources="SELECT r_regionkey::BIGINT AS source, n + 1000000 + r_regionkey AS node FROM region, dims", more=PLACES).replace("FROM pairs JOIN nodes a ON a.node_ix = pairs.a JOIN nodes b ON b.node_ix = pairs.b", "FROM lattice_pairs pairs JOIN nodes a ON a.node_ix = pairs.a JOIN nodes b ON b.node_ix = pairs.b") + " SELECT source, node - n - 1 AS s_suppkey, round(time, 6) AS time FROM best, dims WHERE node BETWEEN n + 1 AND n + 999999")
def place_times(spark, sf_dir):
    """Times from each region's own place to each supplier's own place, both off the lattice."""
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    counts = lat[2], lon[2], r[2]
    n = counts[0] * counts[1] * counts[2]
    share = lambda k: F.col("s_suppkey") * k % 100 / 103
    s = table(spark, sf_dir, "supplier").select((n + 1 + F.col("s_suppkey")).cast("long").alias("node_ix"), (lat[1] * share(7)).alias("lat"), (lon[1] * share(3)).alias("lon"), (r[0] + (r[1] - r[0]) * share(11)).alias("r"))
    region = F.col("r_regionkey") + 1
    own = table(spark, sf_dir, "region").select((n + 1_000_000 + F.col("r_regionkey")).cast("long").alias("node_ix"), (lat[1] * region / 7).alias("lat"), (lon[1] * region / 8).alias("lon"), (6371 - (6371 - r[0]) / region).alias("r"))
    # suppliers of one place are one node
    spots, spot_of = grid.distinct_places(s)
    places = spots.unionByName(own)
    whole = grid.with_places(g, places, lat, lon, r, ["v"])
    pairs = grid.neighbours(g, *counts).unionByName(grid.place_links(places, lat, lon, r))
    sources = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("source"), (n + 1_000_000 + F.col("r_regionkey")).cast("long").alias("node"))
    times = graph.lattice_trees(whole, pairs, sources, counts).join(F.broadcast(spots.select(F.col("node_ix").alias("node"))), "node", "left_semi")
    times = spot_of.join(times.withColumnRenamed("node", "first"), "first")
    return rounded(times.select("source", (F.col("node_ix") - n - 1).alias("s_suppkey"), "time"), [])


SPEED = "v{e} / sqrt(1 + 16 * e{e} / 15 + 4 * d{e} / 15) * sqrt(1 + 2 * d{e} * (1 - c{e}) * c{e} + 2 * e{e} * (1 - c{e}) ^ 2)"


@query(LATTICE + f""", m AS (SELECT *, cos(node_ix / 10) AS n1, sin(node_ix / 10) AS n2, p_size % 7 / 50 AS eps, p_size % 3 / 60 AS dlt FROM p),
c AS (SELECT pairs.a, pairs.b, {LENGTH} AS d, a.v AS va, a.eps AS ea, a.dlt AS da, b.v AS vb, b.eps AS eb, b.dlt AS db, (((b.x - a.x) * a.n1 + (b.y - a.y) * a.n2) / {LENGTH}) ^ 2 AS ca, (((b.x - a.x) * b.n1 + (b.y - a.y) * b.n2) / {LENGTH}) ^ 2 AS cb FROM pairs JOIN m a ON a.node_ix = pairs.a JOIN m b ON b.node_ix = pairs.b)
SELECT a, b, round(d * 0.5 * (1 / ({SPEED.format(e="a")}) + 1 / ({SPEED.format(e="b")})), 6) AS time FROM c""")
def directed_edge_times(spark, sf_dir):
    """Times between neighbours where every node has a symmetry axis of its own."""
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    at = F.col("node_ix") / 10
    m = g.withColumns({"n1": F.cos(at), "n2": F.sin(at), "n3": F.lit(0.0), "epsilon": F.col("p_size") % 7 / 50, "delta": F.col("p_size") % 3 / 60})
    return rounded(graph.directed_edges(m, grid.neighbours(g, lat[2], lon[2], r[2])), [])


CARVED = LATTICE + """,
gn AS (SELECT node_ix, sin(0.0) * sin(lat) + cos(0.0) * cos(lat) * cos(lon - 0.01) AS c, cos(lat) * sin(lon - 0.01) AS u, cos(0.0) * sin(lat) - sin(0.0) * cos(lat) * cos(lon - 0.01) AS v FROM q),
nodes AS (SELECT node_ix, 6371 * u / c AS x, 6371 * v / c AS y FROM gn),
spots AS (SELECT DISTINCT top * (s_suppkey % 7 + 1) / 10 AS lat, side * (s_suppkey % 5 + 2) / 11 AS lon FROM supplier, sup),
places AS (SELECT 6371 * cos(lat) * sin(lon - 0.01) / (cos(lat) * cos(lon - 0.01)) AS x, 6371 * sin(lat) / (cos(lat) * cos(lon - 0.01)) AS y FROM spots),
ring AS (SELECT row_number() OVER () AS n, x + 3 * cos(pi() * a / 4) AS x, y + 3 * sin(pi() * a / 4) AS y FROM places, (SELECT range AS a FROM range(8))),
sides AS (SELECT a.n, b.n AS m, any_value(a.x) AS ax, any_value(a.y) AS ay, any_value(b.x) AS bx, any_value(b.y) AS by_ FROM ring a, ring b, ring c WHERE a.n <> b.n AND c.n <> a.n AND c.n <> b.n GROUP BY a.n, b.n HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= -1e-9)
SELECT node_ix, bool_and((bx - ax) * (y - ay) - (by_ - ay) * (x - ax) >= 0) AS inside FROM nodes, sides GROUP BY node_ix"""


@query(CARVED)
def carved_grid(spark, sf_dir):
    """Nodes in the hull of circles about suppliers."""
    g, (lat, lon, _) = part_lattice(spark, sf_dir)
    key = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").select((lat[1] * (key % 7 + 1) / 10).alias("lat"), (lon[1] * (key % 5 + 2) / 11).alias("lon"))
    return graph.carved(g, places, 0.0, 0.01).select("node_ix", "inside")


CELL_SIDES = """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS c1, embedding[2]::DOUBLE AS c2, embedding[3]::DOUBLE AS c3 FROM embeddings),
l AS (SELECT 8 + count(*) // 250 AS n, min(c1) AS a0, max(c1) AS a1, min(c2) AS b0, max(c2) AS b1, min(c3) AS d0, max(c3) AS d1 FROM v),
g AS (SELECT i, j, k, a0 + (a1 - a0) * (i - 1) / (n - 1) AS c1, b0 + (b1 - b0) * (j - 1) / (n - 1) AS c2, d0 + (d1 - d0) * (k - 1) / (n - 1) AS c3 FROM l, (SELECT unnest(range(1, n + 1)) AS i FROM l), (SELECT unnest(range(1, n + 1)) AS j FROM l), (SELECT unnest(range(1, n + 1)) AS k FROM l)),
c AS (SELECT i, j, k, arg_min(vec_id, ((g.c1 - v.c1) * (g.c1 - v.c1) + (g.c2 - v.c2) * (g.c2 - v.c2) + (g.c3 - v.c3) * (g.c3 - v.c3), vec_id)) AS cell FROM g, v GROUP BY i, j, k)
SELECT x.cell AS a, y.cell AS b, count(*) AS faces FROM c x JOIN c y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 AND abs(x.k - y.k) <= 1 AND x.cell < y.cell GROUP BY ALL"""


@query(CELL_SIDES)
def cell_neighbours(spark, sf_dir):
    """Neighbours in space of the cells of all vectors, as a lattice resolves them."""
    names = ["c1", "c2", "c3"]
    v = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))
    k = v.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max))).first()
    n = 8 + k["n"] // 250
    axes = [(k[f"min_{c}"] or 0.0, k[f"max_{c}"] or 0.0, n) for c in names]
    return nearest.lattice_borders(v, names, axes, "vec_id")


@query(travel_sql() + """,
a AS (SELECT l_orderkey % 30 AS event_id, l_suppkey % 25 AS source, l_quantity AS observed, 1.0 + l_linenumber / 10 AS sigma FROM lineitem),
ev AS (SELECT event_id, event_id % 10 + 1 AS i, event_id * 3 % 10 + 1 AS j, event_id % 2 + 1 AS k FROM (SELECT DISTINCT event_id FROM a)),
near AS MATERIALIZED (SELECT event_id, node_ix FROM ev JOIN g ON abs(g.i - ev.i) <= 1 AND abs(g.j - ev.j) <= 1 AND abs(g.k - ev.k) <= 1),
r AS (SELECT event_id, node_ix, observed - time AS r, sigma AS s FROM a JOIN near USING (event_id) JOIN best ON best.source = a.source AND best.node = node_ix),
m AS (SELECT event_id, node_ix, sum(r / s ^ 2) / sum(1 / s ^ 2) AS shift, sum(r * r / s ^ 2) - (sum(r / s ^ 2)) ^ 2 / sum(1 / s ^ 2) AS misfit FROM r GROUP BY ALL)
SELECT event_id, node_ix, round(shift, 6) AS shift, round(misfit, 4) AS misfit FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(misfit, 6), node_ix) = 1""")
def relocate(spark, sf_dir):
    """Events move to the best node next to their own, by times from each nation's node through the lattice."""
    g, (lat, lon, r) = part_lattice(spark, sf_dir)
    counts = lat[2], lon[2], r[2]
    a = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 30).alias("event_id"), (F.col("l_suppkey") % 25).alias("station_id"), F.lit("P").alias("phase"), F.col("l_quantity").alias("observed"), (1.0 + F.col("l_linenumber") / 10).alias("sigma"))
    key = F.col("event_id")
    own = a.select("event_id").distinct().select("event_id", (key % 10 + 1).alias("i"), (key * 3 % 10 + 1).alias("j"), (key % 2 + 1).alias("k"))
    times = graph.lattice_trees(g, grid.neighbours(g, *counts), nation_sources(spark, sf_dir, counts[0] * counts[1] * counts[2]), counts)
    times = times.select(F.col("source").alias("station_id"), F.lit("P").alias("phase"), F.col("node").alias("node_ix"), "time")
    best = locate.located(locate.scored(a, locate.candidates(own, g, 0), times))
    return best.select("event_id", "node_ix", r6(F.col("shift")).alias("shift"), F.round("misfit", 4).alias("misfit"))


RUN = """
out_directory = "runs"
run_id = "suppliers"
[[DataFields]]
name = "delays"
file = "-"
forward_name = "tt_P_dlnVp"
noise_guess = 0.05
[[ParameterFields]]
name = "dlnVp"
prior = "uniform"
vlims = [-0.05, 0.05]
theta_lims = [-90.0, 90.0]
phi_lims = [-180.0, 180.0]
r_lims = [-300.0, 0.0]
[MonteCarloSolver]
num_iterations = 1000
num_chains = 4
save_interval = 100
init_dim = 10
max_dim = 100
tf_hierarchical = true
"""


def supplier_rays(spark, sf_dir):
    """A straight ray of 20 nodes below each supplier (places from its keys), and its observed delay."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ray_id"), F.radians((F.col("s_suppkey") * 37 % 160 - 80).cast("double")).alias("lat"), F.radians((F.col("s_suppkey") * 61 % 340 - 170).cast("double")).alias("lon"), (F.col("s_acctbal") / 1e5).alias("value"), F.col("s_nationkey").alias("event_id"))
    n = s.select("ray_id", "lat", "lon", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("node_ix")).withColumn("r", 6071 + 15 * F.col("node_ix").cast("double"))
    one = F.lit(0.0)
    nodes = n.withColumns({"vp1d": 8.0 - (F.col("r") - 6071) / 300, "vs1d": F.lit(4.5), "azimuth": one, "elevation": one + 1.5, "polarization": one, "seg_len": F.when(F.col("node_ix") < 20, 15.0)})
    integral = forward.predicted(nodes.withColumn("dlnVp", one), "tt_P_dlnVp").withColumnRenamed("predicted", "ref_t")
    return nodes, s.select(F.lit("delays").alias("obs_name"), "ray_id", "event_id", F.col("ray_id").alias("station_id"), "value"), integral


@query()
def rjmcmc_rays(spark, sf_dir):
    """A whole run: parameters, node table and observations to saved models; random, so without SQL."""
    nodes, observations, references = supplier_rays(spark, sf_dir)
    models_, _ = inversion.run(spark, config.parse(RUN), nodes, observations, references, seed=5)
    return models_.select("chain", "iteration", "temperature", "accepted", r6(F.col("misfit")).alias("misfit"), r6(F.col("noise")[0]).alias("noise"))
