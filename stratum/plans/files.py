"""Tables written to files in the shared folder and read back by the library's sources, and what is read of saved runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.operators import grid, nearest, select
from stratum.plans.places import limits, supplier
from stratum.plans.registry import query, rounded, table
from stratum.sources import chains, text, vtk
from stratum.store import folder

PLACE = "round(s_suppkey * 7.25 % 170 - 85, 5) AS la, round(s_suppkey * 13.5 % 360 - 180, 5) AS lo, round(s_nationkey / 7.0::DOUBLE, 5) AS up"


def places(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey * 7.25D % 170 - 85").alias("latitude"), F.expr("s_suppkey * 13.5D % 360 - 180").alias("longitude"), (F.col("s_nationkey") / F.lit(7.0)).alias("elevation"))


@query(f"SELECT row_number() OVER (ORDER BY s_suppkey) AS event_id, round(radians(la), 6) AS latitude, round(radians(lo), 6) AS longitude, up AS elevation, 0.0::DOUBLE AS t0 FROM (SELECT s_suppkey, {PLACE} FROM supplier)")
def events_file(spark, sf_dir):
    """An event file: export, then the loader, which turns depths to elevations and degrees to radians."""
    path = folder(spark, "events-file")
    text.write_lines(text.event_lines(places(spark, sf_dir), ["s_suppkey"]), path)
    return rounded(text.read_events(spark, path, four_d=True), ["t0"])


@query(f"SELECT row_number() OVER (ORDER BY s_suppkey) AS station_id, round(radians(la), 6) AS latitude, round(radians(lo), 6) AS longitude, up AS elevation FROM (SELECT s_suppkey, {PLACE} FROM supplier)")
def stations_file(spark, sf_dir):
    path = folder(spark, "stations-file")
    text.write_lines(text.station_lines(places(spark, sf_dir), ["s_suppkey"]), path)
    return rounded(text.read_stations(spark, path), [])


@query("SELECT obs_name, l_orderkey AS event_id, l_suppkey AS station_id, round(sum(round(v, 5)), 6) AS value, phase FROM (SELECT 'times' AS obs_name, l_orderkey, l_suppkey, l_quantity / 8 AS v, l_returnflag AS phase FROM lineitem UNION ALL SELECT 'delays', l_orderkey, l_suppkey, l_discount, l_returnflag FROM lineitem) GROUP BY ALL")
def observations_file(spark, sf_dir):
    """Files of two observables, read as one table."""
    paths = {}
    for name, value in (("times", F.col("l_quantity") / 8), ("delays", F.col("l_discount"))):
        paths[name] = folder(spark, f"observations-{name}")
        rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("station_id"), value.alias("observation"), F.col("l_returnflag").alias("phase"))
        text.write_lines(text.observation_lines(rows), paths[name])
    read = text.read_observations(spark, paths)
    return read.groupBy("obs_name", "event_id", "station_id", "phase").agg(F.round(F.sum("value"), 6).alias("value"))


@query("SELECT 6371.0::DOUBLE - p_size AS radius, 5 + p_size / 16 AS vp, 3 + p_size / 32 AS vs FROM part GROUP BY p_size")
def reference_file(spark, sf_dir):
    """A one-dimensional model of a knot for each size of part, blank-delimited."""
    path = folder(spark, "reference-file")
    size = F.col("p_size")
    knots = table(spark, sf_dir, "part").select("p_size").distinct()
    text.write_lines(knots.select(F.concat_ws(" ", (6371.0 - size).cast("string"), (5 + size / 16).cast("string"), (3 + size / 32).cast("string")).alias("line")), path)
    return text.read_reference(spark, path)


@query("SELECT event_id::VARCHAR AS event_id, user_id AS station_id, round(value, 4) AS observation, event_type AS phase FROM events WHERE event_id % 7 <> 2")
def arrivals_file(spark, sf_dir):
    """Arrivals in another column order between semicolons; every seventh line lacks a column."""
    path = folder(spark, "arrivals-file")
    parts = [F.col("event_type"), F.format_string("%.4f", "value"), F.col("event_id").cast("string")]
    line = F.when(F.col("event_id") % 7 == 2, F.concat_ws(" ; ", *parts)).otherwise(F.concat_ws(" ; ", *parts, F.col("user_id").cast("string")))
    text.write_lines(table(spark, sf_dir, "events").select(line.alias("line")), path)
    return text.read_arrivals(spark, path, "string", "long", order=(3, 4, 2, 1), delimiter=";")[0]


@query("SELECT round(o_totalprice, 2) AS observation, o_custkey / 4 AS uncertainty, 0.5::DOUBLE AS period, o_orderpriority AS phase, o_orderkey::VARCHAR AS event_id, o_custkey::VARCHAR AS station_id, o_orderstatus AS channel FROM orders WHERE o_orderkey % 5 <> 1")
def seven_columns_file(spark, sf_dir):
    """Seven columns, exactly: lines with an eighth are left out."""
    path = folder(spark, "seven-columns")
    parts = [F.format_string("%.2f", "o_totalprice"), (F.col("o_custkey") / 4).cast("string"), F.lit("0.5"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")]
    line = F.when(F.col("o_orderkey") % 5 == 1, F.concat_ws(",", *parts, F.lit("more"))).otherwise(F.concat_ws(",", *parts))
    text.write_lines(table(spark, sf_dir, "orders").select(line.alias("line")), path)
    return text.read_seven_columns(spark, path)[0]


RUN = "m AS (SELECT user_id % 8 AS chain, event_id AS iteration, value AS misfit, CASE WHEN user_id % 8 < 3 THEN 1.0 ELSE 2.5 END::DOUBLE AS temperature, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events)"


def saved_run(spark, sf_dir):
    """Events as saved models (eight chains), and a few nuclei of two fields for each."""
    chain = F.col("user_id") % 8
    models = table(spark, sf_dir, "events").select(chain.cast("int").alias("chain"), F.col("event_id").alias("iteration"), F.col("value").alias("misfit"), F.when(chain < 3, 1.0).otherwise(2.5).alias("temperature"), F.lit(1).alias("accepted"), F.lit(0.5).alias("noise"))
    cells = models.select("chain", "iteration", F.explode(F.sequence(F.lit(1), 1 + (F.col("iteration") % 3).cast("int"))).alias("nucleus_ix")).withColumn("field", F.when(F.col("nucleus_ix") == 2, "vs").otherwise("vp"))
    path = folder(spark, "saved-run")
    chains.save({"models": models, "cells": cells}, path)
    return path


@query(f"WITH {RUN} SELECT chain::INT AS chain, iteration, misfit FROM m WHERE n > 4 AND temperature = 1")
def saved_cold_models(spark, sf_dir):
    """Models of cold chains after burn-in, from a saved run."""
    kept = chains.load(spark, saved_run(spark, sf_dir), "models", num_burn=4)
    return select.cold(kept).select("chain", "iteration", "misfit")


@query(f"WITH {RUN} SELECT chain::INT AS chain, iteration, 2::INT AS nucleus_ix, 'vs' AS field FROM m WHERE n > 4 AND iteration % 3 >= 1")
def saved_cells_of_a_field(spark, sf_dir):
    """Nuclei of one field after burn-in: the choice of field and chain reaches the scan."""
    return chains.load(spark, saved_run(spark, sf_dir), "cells", num_burn=4, fields=["vs"]).select("chain", "iteration", "nucleus_ix", "field")


@query(f"WITH {RUN} SELECT chain::INT AS chain, iteration, misfit, temperature, 1 + iteration % 3 AS nuclei FROM m WHERE n > 2")
def saved_metrics(spark, sf_dir):
    return chains.load_metrics(spark, saved_run(spark, sf_dir), num_burn=2).select("chain", "iteration", "misfit", "temperature", "nuclei")


LATTICE = """WITH s AS (SELECT s_suppkey, radians(s_suppkey * 7 % 170 - 85) AS lat, radians(s_suppkey * 13 % 360 - 180) AS lon, 6371 - s_suppkey / 10 AS r FROM supplier),
l AS (SELECT 3 + count(*) // 10 AS nz, min(lat) AS a0, max(lat) AS a1, min(lon) AS b0, max(lon) AS b1, min(r) AS r0, max(r) AS r1 FROM s),
g AS (SELECT node_ix, (node_ix - 1) % 5 + 1 AS i, (node_ix - 1) // 5 % 4 + 1 AS j, (node_ix - 1) // 20 + 1 AS k FROM (SELECT unnest(range(1, 20 * nz + 1)) AS node_ix FROM l)),
q AS (SELECT g.*, a0 + (a1 - a0) * (i - 1) / 4 AS lat, b0 + (b1 - b0) * (j - 1) / 3 AS lon, r0 + (r1 - r0) * (k - 1) / (nz - 1) AS r FROM g, l),
p AS (SELECT *, r * cos(lat) * cos(lon) AS x, r * cos(lat) * sin(lon) AS y, r * sin(lat) AS z FROM q)"""
XYZ = "round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z"


@query(LATTICE + f" SELECT node_ix, {XYZ}, round(lat * 2, 6) + 0.0 AS vp, round(x / r, 6) + 0.0 AS axis_1, round(y / r, 6) + 0.0 AS axis_2, round(z / r, 6) + 0.0 AS axis_3 FROM p")
def grid_file(spark, sf_dir):
    """A lattice over suppliers as a grid file in pieces, read back with two of its three arrays."""
    ends = limits(spark, sf_dir)
    r = F.col("r")
    g = grid.lattice(spark, *ends).select("node_ix", "x", "y", "z", (F.col("lat") * 2).alias("vp"), F.col("lon").alias("vs"), (F.col("x") / r).alias("n1"), (F.col("y") / r).alias("n2"), (F.col("z") / r).alias("n3"))
    path = folder(spark, "grid-file")
    vtk.write(g, path, tuple(e[2] for e in ends), "node_ix", vectors={"axis": ["n1", "n2", "n3"]})
    back = vtk.read(spark, path, ["vp", "axis"])[0]
    return rounded(rounded(back, ["vp", "axis_1", "axis_2", "axis_3"], 5), ["x", "y", "z"])


@query(LATTICE + " SELECT node_ix, iteration, round(CASE WHEN iteration = 10 THEN lat ELSE lon END, 6) + 0.0 AS vp FROM p, (VALUES (10), (20)) t(iteration)")
def model_grids(spark, sf_dir):
    """Snapshots of a lattice at two iterations, read as one table."""
    g, path = grid.lattice(spark, *limits(spark, sf_dir)), folder(spark, "model-grids")
    for iteration, c in ((10, "lat"), (20, "lon")):
        chains.save_model_grid(g.select("node_ix", F.col(c).alias("vp")), path, iteration)
    return rounded(spark.read.parquet(f"{path}/grid"), [])


BOX = {"lat": (-0.5, 0.75), "lon": (-1.25, 1.5), "r": (0.0, 0.0)}


@query("WITH s AS (SELECT s_suppkey, radians(s_suppkey * 7 % 170 - 85) AS lat, radians(s_suppkey * 13 % 360 - 180) AS lon FROM supplier) SELECT s_suppkey FROM s WHERE lat BETWEEN -0.5 AND 0.75 AND lon BETWEEN -1.25 AND 1.5")
def in_cartesian_box(spark, sf_dir):
    """Suppliers in a box of geographic limits, told from Cartesian places; equal limits of the radius hold all."""
    from stratum.functions.geo import to_cartesian

    s = supplier(spark, sf_dir)
    x, y, z = to_cartesian(F.col("lat"), F.col("lon"), F.col("r"))
    s = s.select("s_suppkey", x.alias("x"), y.alias("y"), z.alias("z"))
    return s.where(select.in_cartesian_box(F.col("x"), F.col("y"), F.col("z"), BOX)).select("s_suppkey")


@query(LATTICE + " SELECT node_ix FROM p WHERE lat > 0")
def without_air(spark, sf_dir):
    """Nodes that a velocity is defined for."""
    return select.without_air(grid.lattice(spark, *limits(spark, sf_dir)), "lat").select("node_ix")


@query(LATTICE + """, f AS (SELECT event_type, arg_min(event_id, event_id) % 50 AS t FROM events GROUP BY ALL), fr AS (SELECT row_number() OVER (ORDER BY event_type) AS frame, t FROM f),
one AS (SELECT frame FROM fr ORDER BY abs(t - 20), frame LIMIT 1),
o AS (SELECT *, greatest(1, least(5, floor((lat - a0) / ((a1 - a0) / 4) + 0.5) + 1)) AS oi, greatest(1, least(4, floor((lon - b0) / ((b1 - b0) / 3) + 0.5) + 1)) AS oj FROM (SELECT s_suppkey, lat, lon FROM s), l)
SELECT s_suppkey, round(1000 * frame + (oj - 1) * 5 + oi, 6) AS v FROM o, one""")
def velocity_view(spark, sf_dir):
    """Velocities at suppliers from the nearest node of a lattice, in the frame nearest in time: frames are types of events."""
    lat, lon, _ = limits(spark, sf_dir)
    t = table(spark, sf_dir, "events").groupBy("event_type").agg((F.min("event_id") % 50).cast("double").alias("t"))
    frames = select.positioned(t, ["event_type"], "frame").select("frame", "t")
    spots = supplier(spark, sf_dir).select("s_suppkey", "lat", "lon", F.lit(0.0).alias("r"))
    values = grid.lattice(spark, lat, lon, (0.0, 0.0, 1)).select("node_ix").join(F.broadcast(frames.select("frame")), F.lit(True)).withColumn("v", (1000 * F.col("frame") + F.col("node_ix")).cast("double"))
    steps = [(lat[1] - lat[0]) / 4, (lon[1] - lon[0]) / 3, 1.0]
    return nearest.velocity_view(spots, values, [lat[0], lon[0], 0.0], steps, [5, 4, 1], ["lat", "lon", "r"], 20.0, frames, ["v"]).select("s_suppkey", F.round("v", 6).alias("v"))
