"""From traced paths to the node table that forward functions read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.interpolate import last_repeated, reference_values, resampled
from stratum.operators.index import trimmed


def build(paths: DataFrame, knots: DataFrame, spacing: float | None = None, inside: Column | None = None, polarization: DataFrame | None = None) -> DataFrame:
    """paths: (ray_id, node_ix, x, y, z, t). Node table with r, reference velocities (knots: radius, vp, vs), segment length, azimuth (from east to north) and elevation of each segment, the last node repeating the one before, and the ray's polarization (ray_id, zeta; 0 where there is none).

    Rays are trimmed to the domain first and resampled to about spacing then, if asked for.
    """
    if inside is not None:
        paths = trimmed(paths, inside)
    nodes = paths.select("ray_id", "node_ix", "x", "y", "z")
    if spacing is not None:
        nodes = resampled(nodes, "ray_id", "node_ix", ["x", "y", "z"], spacing).withColumnRenamed("seq", "node_ix")
    along = Window.partitionBy("ray_id").orderBy("node_ix")
    d = {c: F.lead(c).over(along) - F.col(c) for c in "xyz"}
    n = nodes.withColumns({f"_d{c}": e for c, e in d.items()}).withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    length = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2 + F.col("_dz") ** 2)
    lon, lat = F.atan2("y", "x"), F.asin(F.col("z") / F.col("r"))
    east = -F.sin(lon) * F.col("_dx") + F.cos(lon) * F.col("_dy")
    north = -F.sin(lat) * (F.cos(lon) * F.col("_dx") + F.sin(lon) * F.col("_dy")) + F.cos(lat) * F.col("_dz")
    up = F.cos(lat) * (F.cos(lon) * F.col("_dx") + F.sin(lon) * F.col("_dy")) + F.sin(lat) * F.col("_dz")
    n = n.withColumns({"seg_len": length, "_az": F.atan2(north, east), "_el": F.when(length > 0, F.asin(F.round(up / length, 6)))})
    n = n.withColumns({"azimuth": last_repeated(F.col("_az"), "ray_id", "node_ix"), "elevation": last_repeated(F.col("_el"), "ray_id", "node_ix")})
    n = reference_values(n.drop("_dx", "_dy", "_dz", "_az", "_el"), knots, "r", "radius", ["vp", "vs"]).withColumnsRenamed({"vp": "vp1d", "vs": "vs1d"})
    if polarization is None:
        return n.withColumn("polarization", F.lit(0.0))
    return n.join(polarization.select("ray_id", F.col("zeta").alias("polarization")), "ray_id", "left").withColumn("polarization", F.coalesce("polarization", F.lit(0.0)))


def radial_neighbours(nuclei: DataFrame, model: list[str], index: str = "nucleus_ix", r: str = "r") -> DataFrame:
    """Nuclei with those next below and above in radius (null at the ends) of their model."""
    w = Window.partitionBy(*model).orderBy(r, index)
    return nuclei.withColumn("below", F.lag(index).over(w)).withColumn("above", F.lead(index).over(w))
