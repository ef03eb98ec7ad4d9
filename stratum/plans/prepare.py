"""Data preparation. events stand for observations (user_id the event, event_type the phase), lineitem for arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.operators import index, interpolate, nearest, residuals, select
from stratum.plans.registry import query, rounded, table
from stratum.sources import text
from stratum.store import folder


def observations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value")).alias("value"))


OBS = "WITH o AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)"


@query("SELECT event_id, user_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS demeaned FROM events")
def event_demeaned_delays(spark, sf_dir):
    return rounded(interpolate.demeaned(table(spark, sf_dir, "events"), ["user_id"], "value").select("event_id", "user_id", "demeaned"), [], 9)


@query(OBS + "SELECT user_id, round(coalesce(avg(value) FILTER (NOT isnan(value)), 'nan'), 6) AS mean, count(*) FILTER (NOT isnan(value)) AS n FROM o GROUP BY ALL")
def event_means(spark, sf_dir):
    return rounded(interpolate.group_means(observations(spark, sf_dir), ["user_id"], "value"), [])


@query(OBS + "SELECT event_type, round(coalesce(avg(value) FILTER (NOT isnan(value)), 'nan'), 6) AS mean, count(*) FILTER (NOT isnan(value)) AS n FROM o GROUP BY ALL")
def station_means(spark, sf_dir):
    return rounded(interpolate.group_means(observations(spark, sf_dir), ["event_type"], "value"), [])


@query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 5")
def burn_in(spark, sf_dir):
    return select.drop_burn_in(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def trailing_window(spark, sf_dir):
    return select.trailing(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 10).select("event_id", "user_id", "value")


@query("SELECT event_type, round(avg(value), 6) AS noise FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 3) GROUP BY ALL")
def trailing_noise(spark, sf_dir):
    n = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("event_type").alias("obs_name"), F.col("event_id").alias("iteration"), F.col("value").alias("noise"))
    return rounded(residuals.trailing_noise(n, 3).withColumnRenamed("obs_name", "event_type"), [])


@query("SELECT o_orderkey, l_linenumber, l_suppkey, o_custkey, s_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey")
def observation_places(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("station_id"), "l_linenumber")
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    out = index.with_places(li, o.select(F.col("o_orderkey").alias("event_id"), "o_custkey"), s.select(F.col("s_suppkey").alias("station_id"), "s_name"))
    return out.select(F.col("event_id").alias("o_orderkey"), "l_linenumber", F.col("station_id").alias("l_suppkey"), "o_custkey", "s_name")


KEY = ["user_id", "event_type"]


@query("SELECT user_id, event_type, row_number() OVER (ORDER BY first) AS ray_id FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)")
def ray_surrogate_keys(spark, sf_dir):
    return index.ray_ids(table(spark, sf_dir, "events"), KEY, ["ts", "event_id"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_duplicate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(*KEY, "ts", "event_id", "value")
    return index.last_of_duplicates(e, KEY, ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id)::INT AS evt_ix FROM events")
def local_reindex(spark, sf_dir):
    return index.dense_index(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), ["event_type"], {"user_id": "evt_ix"}).select("event_id", "event_type", "evt_ix")


@query("SELECT event_type AS phase, row_number() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM events)")
def phase_codes(spark, sf_dir):
    return index.phase_codes(table(spark, sf_dir, "events").select(F.col("event_type").alias("phase")))


@query("SELECT DISTINCT l_suppkey, l_orderkey % 100 AS part, l_returnflag AS phase FROM lineitem")
def source_receiver_pairs(spark, sf_dir):
    rays = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("event_id"), F.col("l_suppkey").alias("station_id"), F.col("l_returnflag").alias("phase"), F.lit(0).alias("ray_id")).distinct()
    return index.pairs_to_rays(rays, from_events=False).select(F.col("source_id").alias("l_suppkey"), F.col("receiver_id").alias("part"), "phase")


@query("WITH s AS (SELECT DISTINCT event_type AS obs_name, user_id AS id FROM events) SELECT a.id, a.obs_name AS obs_a, b.obs_name AS obs_b FROM s a JOIN s b ON a.id = b.id AND a.obs_name < b.obs_name")
def shared_statics_all(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("obs_name"), F.lit(1).alias("group_id"), F.col("user_id").alias("id")).distinct()
    return index.shared_statics(s).drop("group_id")


@query("WITH z AS (SELECT user_id, max(value) AS zeta FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT DISTINCT e.user_id, e.event_type, z.zeta FROM events e LEFT JOIN z USING (user_id)")
def polarization_attached(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return index.attached(e.select(*KEY).distinct(), e.where("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("zeta")), ["user_id"])


@query("WITH s AS (SELECT user_id, avg(value) AS st FROM events WHERE user_id % 2 = 0 GROUP BY ALL) SELECT event_id, round(value - coalesce(st, 0), 9) AS corrected FROM events LEFT JOIN s USING (user_id)")
def statics_gather(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.avg("value").alias("value"))
    return index.gathered(e, s, ["user_id"], "st").select("event_id", (F.round(F.col("value") - F.col("st"), 9) + F.lit(0.0)).alias("corrected"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders WHERE o_custkey % 7 = 0")
def subset_renumbered(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return select.renumbered(o.select("o_orderkey"), o.where("o_custkey % 7 = 0").select("o_orderkey"), "o_orderkey")


@query("WITH e AS (SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000) SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM e))")
def in_domain_stations(spark, sf_dir):
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    _, stations = select.in_domain(o.select(F.col("o_orderkey").alias("event_id"), "o_totalprice"), li.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("station_id")), s.select(F.col("s_suppkey").alias("station_id")), select.within(F.col("o_totalprice"), 100000.0, 200000.0))
    return stations.withColumnRenamed("station_id", "s_suppkey")


@query("SELECT r_regionkey, lo, hi, (lo = hi) OR (7.0 BETWEEN lo AND hi) AS inside FROM (SELECT r_regionkey, r_regionkey * 2.0::DOUBLE AS lo, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 2.0 ELSE 9.0 END::DOUBLE AS hi FROM region)")
def degenerate_limits(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") * F.lit(2.0)).alias("lo"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") * F.lit(2.0)).otherwise(9.0).alias("hi"))
    return r.withColumn("inside", select.within(F.lit(7.0), F.col("lo"), F.col("hi")))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> n_regionkey % 3")
def active_fields(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("vlo", F.col("n_nationkey") % 3).withColumn("vhi", F.col("n_regionkey") % 3)
    return select.active_fields(n).select("n_nationkey", "n_name")


@query("SELECT n_name, 'predictive' AS kind FROM nation WHERE n_regionkey > 1 UNION ALL SELECT n_name, 'descriptive' FROM nation WHERE n_regionkey <= 1")
def observable_kinds(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("forward_name", F.when(F.col("n_regionkey") > 1, "tt_P_Vp"))
    a, b = select.split_observables(n)
    return a.select("n_name", F.lit("predictive").alias("kind")).unionByName(b.select("n_name", F.lit("descriptive").alias("kind")))


PHASES = "CASE event_id % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'Sdiff' WHEN 2 THEN 'pP' ELSE 'sS' END"


@query(f"""WITH p AS (SELECT event_id, {PHASES} AS phase, value % 180 AS dist, event_id % 5 = 0 AS missing FROM events)
SELECT event_id, CASE WHEN NOT missing THEN phase WHEN phase = 'P' AND dist >= 160 THEN 'PKIKP' WHEN phase LIKE '%diff' THEN replace(phase, 'diff', '') ELSE phase || 'diff' END AS phase,
  CASE WHEN phase IN ('pP', 'sS') THEN phase[1] || '^9' || phase[2:] ELSE phase END AS renamed FROM p""")
def phase_names(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", F.expr(PHASES).alias("phase"), F.expr("value % 180").alias("dist"), (F.col("event_id") % 5 == 0).alias("missing"))
    return p.select("event_id", select.phase_fallback(F.col("phase"), F.col("dist"), F.col("missing")).alias("phase"), select.surface_reflection(F.col("phase")).alias("renamed"))


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 100.0::DOUBLE END AS y FROM events)
SELECT event_id, least(x, y) AS predicted, CASE WHEN x IS NULL AND y IS NULL THEN 0 WHEN y IS NULL OR x <= y THEN 1 ELSE 2 END AS branch, x IS NULL AND y IS NULL AS bad FROM a""")
def arrival_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    first = F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(float("nan"))
    second = F.when(F.col("event_id") % 6 != 0, 100.0).otherwise(float("inf"))
    return residuals.quality_control(e, first, second).select("event_id", "predicted", "branch", "bad")


KNOTS = [(45.0, 1.0, 10.0), (30.0, 2.5, 12.0), (20.0, 3.0, 20.0), (5.0, 8.0, 2.0)]


@query("""WITH k(radius, vp, vs) AS (VALUES (45.0::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE), (30.0, 2.5, 12.0), (20.0, 3.0, 20.0), (5.0, 8.0, 2.0)),
i AS (SELECT radius AS hi, lead(radius) OVER (ORDER BY radius DESC) AS lo, vp AS vph, lead(vp) OVER (ORDER BY radius DESC) AS vpl, vs AS vsh, lead(vs) OVER (ORDER BY radius DESC) AS vsl FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(CASE WHEN l_quantity >= 45 THEN 1.0 WHEN l_quantity < 5 THEN 8.0 ELSE vpl + (vph - vpl) * (l_quantity - lo) / (hi - lo) END, 6) AS vp,
  round(CASE WHEN l_quantity >= 45 THEN 10.0 WHEN l_quantity < 5 THEN 2.0 ELSE vsl + (vsh - vsl) * (l_quantity - lo) / (hi - lo) END, 6) AS vs FROM lineitem LEFT JOIN i ON l_quantity >= lo AND l_quantity < hi""")
def reference_model_lookup(spark, sf_dir):
    k = spark.createDataFrame(KNOTS, "radius double, vp double, vs double")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(interpolate.reference_values(li, k, "l_quantity", "radius", ["vp", "vs"]), ["l_quantity"])


@query("WITH f AS (SELECT range AS frame, range * 50.0::DOUBLE AS t FROM range(1, 11)) SELECT event_id, frame FROM events, f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(t - value), frame) = 1")
def nearest_in_time(spark, sf_dir):
    f = spark.range(1, 11).select(F.col("id").alias("frame"), (F.col("id") * 50.0).alias("t"))
    return nearest.nearest_in_time(table(spark, sf_dir, "events").select("event_id", "value"), f, "value", "t", "frame").select("event_id", "frame")


@query("WITH f AS (SELECT range AS ix, range * 40.0::DOUBLE AS p FROM range(0, 13)) SELECT event_id, ix FROM events, f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(p - value), ix) = 1")
def nearest_on_axis(spark, sf_dir):
    axis = spark.range(0, 13).select(F.col("id").alias("ix"), (F.col("id") * 40.0).alias("p"))
    return nearest.nearest_value(table(spark, sf_dir, "events").select("event_id", "value"), axis, "value", "p", "ix").select("event_id", "ix")


@query("SELECT event_id, least(26, greatest(1, floor((value - 5) / 20 + 0.5)::BIGINT + 1)) AS frame FROM events")
def regular_frame(spark, sf_dir):
    return nearest.regular_frames(table(spark, sf_dir, "events").select("event_id", "value"), "value", 5.0, 20.0, 26).select("event_id", "frame")


POLY = "SELECT user_id, event_id, value / 10 AS x, event_id / 100.0::DOUBLE AS y FROM events"


def polylines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 10).alias("x"), (F.col("event_id") / F.lit(100.0)).alias("y"))


@query(f"""WITH p AS ({POLY}), d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2), 0) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(step, 6) AS step, round(sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS along FROM d""")
def path_lengths(spark, sf_dir):
    return rounded(interpolate.path_lengths(polylines(spark, sf_dir), "user_id", "event_id", ["x", "y"]).select("user_id", "event_id", "step", "along"), [])


@query(f"""WITH p AS ({POLY}), d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2), 0) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS along FROM d),
s AS (SELECT *, lead(along) OVER w AS nxt, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(along) OVER (PARTITION BY user_id) AS total FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT DISTINCT user_id, total, floor(total / 37.0)::INT AS n FROM s), q AS (SELECT user_id, n, total, unnest(range(0, n + 1))::INT AS seq FROM n WHERE n > 0),
j AS (SELECT q.user_id, q.seq, q.seq * (q.total / q.n) AS pos, s.* EXCLUDE (user_id) FROM q JOIN s ON s.user_id = q.user_id AND nxt > along AND q.seq * (q.total / q.n) >= along - 1e-9 AND (q.seq * (q.total / q.n) < nxt - 1e-9 OR nxt >= s.total))
SELECT user_id, seq, round(x + (pos - along) / (nxt - along) * (x2 - x), 5) AS x, round(y + (pos - along) / (nxt - along) * (y2 - y), 5) AS y FROM j QUALIFY row_number() OVER (PARTITION BY user_id, seq ORDER BY along DESC) = 1
UNION ALL SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT, round(x, 5), round(y, 5) FROM s WHERE total < 37""")
def resample_polyline(spark, sf_dir):
    return rounded(interpolate.resampled(polylines(spark, sf_dir), "user_id", "event_id", ["x", "y"], 37.0), [], 5)


SPLINE = f"""WITH RECURSIVE p AS ({POLY}), d AS (SELECT *, sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS along FROM d),
k AS (SELECT user_id, along, x, y, row_number() OVER (PARTITION BY user_id ORDER BY along) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM a WHERE step IS NULL OR step > 0),
g AS (SELECT *, along - lag(along) OVER w AS h0, lead(along) OVER w - along AS h1, (x - lag(x) OVER w) / (along - lag(along) OVER w) AS x0, (lead(x) OVER w - x) / (lead(along) OVER w - along) AS x1, (y - lag(y) OVER w) / (along - lag(along) OVER w) AS y0, (lead(y) OVER w - y) / (lead(along) OVER w - along) AS y1 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY i)),
e AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN h0 - h1 * h1 / h0 ELSE h0 END AS below, CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN h1 - h0 * h0 / h1 ELSE h1 END AS above,
  2 * (h0 + h1) + CASE WHEN i = 1 THEN h0 + h0 * h0 / h1 ELSE 0 END + CASE WHEN i = n - 2 THEN h1 + h1 * h1 / h0 ELSE 0 END AS diag, 6 * (x1 - x0) AS rx, 6 * (y1 - y0) AS ry FROM g WHERE n >= 4 AND i BETWEEN 1 AND n - 2),
f AS (SELECT user_id, i, n, above / diag AS u, rx / diag AS dx, ry / diag AS dy FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.n, above / (diag - below * u), (rx - below * dx) / (diag - below * u), (ry - below * dy) / (diag - below * u) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
b AS (SELECT user_id, i, n, dx AS mx, dy AS my FROM f WHERE i = n - 2 UNION ALL SELECT f.user_id, f.i, f.n, dx - u * mx, dy - u * my FROM b JOIN f ON f.user_id = b.user_id AND f.i = b.i - 1),
m AS (SELECT user_id, i, mx, my FROM b
  UNION ALL SELECT g.user_id, 0, s.mx + (s.mx - t.mx) * h0 / h1, s.my + (s.my - t.my) * h0 / h1 FROM g JOIN b s ON s.user_id = g.user_id AND s.i = 1 JOIN b t ON t.user_id = g.user_id AND t.i = 2 WHERE g.i = 1 AND g.n >= 4
  UNION ALL SELECT g.user_id, g.n - 1, s.mx + (s.mx - t.mx) * h1 / h0, s.my + (s.my - t.my) * h1 / h0 FROM g JOIN b s ON s.user_id = g.user_id AND s.i = g.n - 2 JOIN b t ON t.user_id = g.user_id AND t.i = g.n - 3 WHERE g.i = g.n - 2 AND g.n >= 4
  UNION ALL SELECT user_id, unnest([0, 1, 2]), 2 * (x1 - x0) / (h0 + h1), 2 * (y1 - y0) / (h0 + h1) FROM g WHERE n = 3 AND i = 1
  UNION ALL SELECT user_id, i, 0.0, 0.0 FROM g WHERE n < 3),
s AS (SELECT user_id, i, along, x, y, mx, my, lead(along) OVER w AS nxt, lead(x) OVER w AS xb, lead(y) OVER w AS yb, lead(mx) OVER w AS mxb, lead(my) OVER w AS myb, max(along) OVER (PARTITION BY user_id) AS total FROM k JOIN m USING (user_id, i) WINDOW w AS (PARTITION BY user_id ORDER BY i)),
q AS (SELECT user_id, n, total, unnest(range(0, n + 1))::INT AS seq FROM (SELECT DISTINCT user_id, total, floor(total / 37.0)::INT AS n FROM s) WHERE n > 0),
j AS (SELECT q.user_id, q.seq, s.* EXCLUDE (user_id), nxt - along AS h, q.seq * (q.total / q.n) - along AS u FROM q JOIN s ON s.user_id = q.user_id AND nxt > along AND q.seq * (q.total / q.n) >= along - 1e-9 AND (q.seq * (q.total / q.n) < nxt - 1e-9 OR nxt >= s.total))
SELECT user_id, seq, round((mx * (h - u) ^ 3 + mxb * u ^ 3) / (6 * h) + (x / h - mx * h / 6) * (h - u) + (xb / h - mxb * h / 6) * u, 5) AS x, round((my * (h - u) ^ 3 + myb * u ^ 3) / (6 * h) + (y / h - my * h / 6) * (h - u) + (yb / h - myb * h / 6) * u, 5) AS y
FROM j QUALIFY row_number() OVER (PARTITION BY user_id, seq ORDER BY along DESC) = 1
UNION ALL SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT, round(x, 5), round(y, 5) FROM (SELECT *, max(along) OVER (PARTITION BY user_id) AS total FROM a) WHERE total < 37"""


@query(SPLINE)
def spline_polyline(spark, sf_dir):
    return rounded(interpolate.splined(polylines(spark, sf_dir), "user_id", "event_id", ["x", "y"], 37.0), [], 5)


@query("""WITH p AS (SELECT user_id AS ray_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS node_ix, value, event_id / 10.0::DOUBLE AS t FROM events),
s AS (SELECT ray_id, coalesce(min(node_ix) FILTER (value > 300), max(node_ix)) AS start FROM p GROUP BY ALL), k AS (SELECT p.* FROM p JOIN s USING (ray_id) WHERE node_ix >= start)
SELECT ray_id, node_ix, round(max(t) OVER (PARTITION BY ray_id) - min(t) OVER (PARTITION BY ray_id), 6) AS elapsed FROM k""")
def domain_trim(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    n = e.select(F.col("user_id").alias("ray_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("node_ix"), "value", (F.col("event_id") / F.lit(10.0)).alias("t"))
    return rounded(index.trimmed(n, F.col("value") > 300).select("ray_id", "node_ix", "elapsed"), [])


@query("SELECT format('{:6d}  {:11.5f}  {:11.5f}  {:11.5f}', row_number() OVER (ORDER BY s_suppkey), s_acctbal, s_acctbal / 3, s_nationkey / 7.0::DOUBLE) AS line FROM supplier")
def station_export(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("latitude"), (F.col("s_acctbal") / 3).alias("longitude"), (F.col("s_nationkey") / F.lit(7.0)).alias("elevation"))
    return text.station_lines(s, ["s_suppkey"])


@query("SELECT format('{:6d}  {:11.5f}  {:11.5f}  {:11.5f}  {:11.5f}', row_number() OVER (ORDER BY s_suppkey), s_acctbal, s_acctbal / 3, -s_nationkey / 7.0::DOUBLE - 0.25, 0.0::DOUBLE) AS line FROM supplier")
def event_export(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("latitude"), (F.col("s_acctbal") / 3).alias("longitude"), (F.col("s_nationkey") / F.lit(7.0) + 0.25).alias("elevation"))
    return text.event_lines(s, ["s_suppkey"])


@query("""WITH e AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS p FROM supplier)
SELECT format('{:>6s}  {:>6s}  {:11.5f}  {:s}', e.p::VARCHAR, s.p::VARCHAR, l_quantity, l_returnflag) AS line FROM lineitem JOIN e ON o_orderkey = l_orderkey JOIN s ON s_suppkey = l_suppkey""")
def observation_export(spark, sf_dir):
    o = select.positioned(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["id"])
    s = select.positioned(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (-F.col("s_suppkey")).alias("_o")), ["_o"])
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("station_id"), F.col("l_quantity").alias("observation"), F.col("l_returnflag").alias("phase"))
    return text.observation_lines(li, o, s)


@query("SELECT format('{:>6s}  {:>6s}  {:11.5f}  {:s}', l_orderkey::VARCHAR, l_suppkey::VARCHAR, l_quantity, l_returnflag) AS line FROM lineitem")
def observation_export_ids(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("station_id"), F.col("l_quantity").alias("observation"), F.col("l_returnflag").alias("phase"))
    return text.observation_lines(li)


@query("SELECT s_suppkey AS id, round(s_acctbal / 100, 5) AS latitude, round(s_acctbal / 77, 5) AS longitude, -round(s_nationkey / 7.0::DOUBLE, 5) AS elevation FROM supplier WHERE s_suppkey % 10 <> 3")
def acquisition_round_trip(spark, sf_dir):
    """Lines written as text and read back in another column order; every tenth line is short and left out."""
    s = table(spark, sf_dir, "supplier")
    depth, lat, lon = (F.format_string("%.5f", c) for c in (F.col("s_nationkey") / F.lit(7.0), F.col("s_acctbal") / 100, F.col("s_acctbal") / 77))
    line = F.when(F.col("s_suppkey") % 10 == 3, F.concat_ws(" ", depth, lat)).otherwise(F.concat_ws("   ", depth, lat, lon, F.col("s_suppkey").cast("string")))
    path = folder(spark) + "/acquisition"
    s.select(line.alias("line")).write.mode("overwrite").text(path)
    good, _ = text.read_acquisition(spark, path, "long", order=(4, 2, 3, 1), depth=True)
    return good
