"""Delimited text: events, stations, observations, reference models; and fixed-width export.

Lines are split by Spark, so files of any size are read in parallel; lines with too few columns go to a side table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.index import dimension
from stratum.operators.select import positioned


def lines(spark: SparkSession, path: str, delimiter: str = r"\s+") -> DataFrame:
    """(line, cols): non-empty lines and their columns; the delimiter is a regular expression."""
    text = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return text.select("line", F.split("line", delimiter).alias("cols"))


def split_lines(table: DataFrame, columns: dict[str, tuple[int, str]], exactly: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, short): columns maps a name to its place (from 1) and type; short has the lines with too few columns (or not exactly so many)."""
    need = exactly or max(at for at, _ in columns.values())
    enough = F.size("cols") == exactly if exactly else F.size("cols") >= need
    good = table.where(enough).select(*(F.trim(F.get("cols", at - 1)).cast(kind).alias(name) for name, (at, kind) in columns.items()))
    return good, table.where(~enough).select("line")


def read_events(spark: SparkSession, path: str, four_d: bool = False) -> DataFrame:
    """(event_id, latitude, longitude in radians, elevation = -depth, t0)."""
    cols = {"event_id": (1, "long"), "latitude": (2, "double"), "longitude": (3, "double"), "depth": (4, "double")} | ({"t0": (5, "double")} if four_d else {})
    good, _ = split_lines(lines(spark, path), cols)
    t0 = F.col("t0") if four_d else F.lit(0.0)
    return good.select("event_id", F.radians("latitude").alias("latitude"), F.radians("longitude").alias("longitude"), (-F.col("depth")).alias("elevation"), t0.alias("t0"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, latitude, longitude in radians, elevation)."""
    good, _ = split_lines(lines(spark, path), {"station_id": (1, "long"), "latitude": (2, "double"), "longitude": (3, "double"), "elevation": (4, "double")})
    return good.select("station_id", F.radians("latitude").alias("latitude"), F.radians("longitude").alias("longitude"), "elevation")


def read_observations(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(obs_name, event_id, station_id, value, phase) of the files of several observables."""
    out = None
    for name, path in paths.items():
        good, _ = split_lines(lines(spark, path), {"event_id": (1, "long"), "station_id": (2, "long"), "value": (3, "double"), "phase": (4, "string")})
        good = good.select(F.lit(name).alias("obs_name"), "*")
        out = good if out is None else out.unionByName(good)
    return out


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """(radius, vp, vs) separated by single blanks."""
    return spark.read.csv(path, sep=" ", schema="radius double, vp double, vs double")


def read_acquisition(spark: SparkSession, path: str, id_type: str = "string", order: tuple[int, int, int, int] = (1, 2, 3, 4), depth: bool = False, delimiter: str = r"\s+") -> tuple[DataFrame, DataFrame]:
    """(id, latitude, longitude, elevation) from columns in any order, and the short lines; depth flips the sign of the fourth."""
    kinds = (id_type, "double", "double", "double")
    good, short = split_lines(lines(spark, path, delimiter), dict(zip(("id", "latitude", "longitude", "elevation"), zip(order, kinds, strict=True), strict=True)))
    return (good.withColumn("elevation", -F.col("elevation")) if depth else good), short


def read_arrivals(spark: SparkSession, path: str, event_type: str = "string", station_type: str = "string", order: tuple[int, int, int, int] = (1, 2, 3, 4), delimiter: str = r"\s+") -> tuple[DataFrame, DataFrame]:
    """(event_id, station_id, observation, phase) from columns in any order, and the short lines."""
    kinds = (event_type, station_type, "double", "string")
    return split_lines(lines(spark, path, delimiter), dict(zip(("event_id", "station_id", "observation", "phase"), zip(order, kinds, strict=True), strict=True)))


def read_seven_columns(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(observation, uncertainty, period, phase, event_id, station_id, channel); lines must have exactly seven columns."""
    names = ("observation", "uncertainty", "period", "phase", "event_id", "station_id", "channel")
    kinds = ("double", "double", "double", "string", "string", "string", "string")
    return split_lines(lines(spark, path, delimiter), {n: (i, k) for i, (n, k) in enumerate(zip(names, kinds, strict=True), 1)}, exactly=7)


def place_line(number: Column, latitude: Column, longitude: Column, height: Column, *more: Column) -> Column:
    return F.format_string("%6d  %11.5f  %11.5f  %11.5f" + "  %11.5f" * len(more), number, latitude, longitude, height, *more)


def event_lines(events: DataFrame, order: list[str]) -> DataFrame:
    """(line): events renumbered 1 .. n, depth = -elevation, time 0."""
    e = positioned(events, order, "_n")
    return e.select(place_line(F.col("_n"), F.col("latitude"), F.col("longitude"), -F.col("elevation"), F.lit(0.0)).alias("line"))


def station_lines(stations: DataFrame, order: list[str]) -> DataFrame:
    s = positioned(stations, order, "_n")
    return s.select(place_line(F.col("_n"), F.col("latitude"), F.col("longitude"), F.col("elevation")).alias("line"))


def observation_lines(observations: DataFrame, events: DataFrame | None = None, stations: DataFrame | None = None) -> DataFrame:
    """(line): with tables of positions (id, position) ids become positions, else they stay."""
    event, station = F.col("event_id").cast("string"), F.col("station_id").cast("string")
    if events is not None:
        observations = observations.join(dimension(events.select(F.col("id").alias("event_id"), F.col("position").alias("_e"))), "event_id")
        event = F.col("_e").cast("string")
    if stations is not None:
        observations = observations.join(dimension(stations.select(F.col("id").alias("station_id"), F.col("position").alias("_s"))), "station_id")
        station = F.col("_s").cast("string")
    return observations.select(F.format_string("%6s  %6s  %11.5f  %s", event, station, F.col("observation"), F.col("phase")).alias("line"))


def write_lines(table: DataFrame, path: str) -> None:
    """Text files; an existing folder is an error."""
    table.select("line").write.mode("errorifexists").text(path)
