"""Surrogate keys, gathers and other id joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.select import fresh, positioned

#: Most rows of a dimension that a join may broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def dimension(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint, if a count shows it to be small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def shuffled(table: DataFrame) -> DataFrame:
    """The table, for a join that broadcasts neither side. Spark judges by a file's compressed bytes and takes no account of rows that are made from others, so tables of many millions of rows would pass through the driver."""
    return table.hint("merge")


def with_places(observations: DataFrame, events: DataFrame, stations: DataFrame) -> DataFrame:
    """Observations with the columns of their event and station."""
    return observations.join(dimension(events), "event_id").join(dimension(stations), "station_id")


def ray_ids(observations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, ray_id): ids 1 .. n of distinct composite keys, in the order in which they are first seen."""
    first = observations.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return positioned(first.select(*key, "_first"), ["_first", *key], "ray_id").drop("_first")


def last_of_duplicates(observations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last observation of each key."""
    rest = [c for c in observations.columns if c not in key]
    return observations.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def dense_index(observations: DataFrame, group: list[str], ids: dict[str, str]) -> DataFrame:
    """Rank of each id among the distinct ids of its group. The ids are reduced to distinct ones before they are ranked."""
    out = observations
    for column, name in ids.items():
        distinct = observations.select(*group, column).distinct()
        ranked = distinct.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(column)))
        out = out.join(ranked, [*group, column])
    return out


def followed(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Each row that has one after it in the given order, with that one's value. Rows are numbered over range partitions and meet by number: no task takes all rows."""
    at, after = fresh(rows, "_position"), fresh(rows, "_after")
    numbered = positioned(rows, [order], at)
    following = numbered.select((F.col(at) - 1).alias(at), F.struct(F.col(value).alias("v")).alias(after))
    return numbered.join(following, at).withColumn(name, F.col(after)["v"]).drop(at, after)


def phase_codes(observations: DataFrame, phase: str = "phase") -> DataFrame:
    """(phase, code): codes 1 .. n of distinct phases, alphabetical."""
    return positioned(observations.select(phase).distinct(), [phase], "code")


def sources_are_events(n_events: int, n_stations: int, relocate: bool, four_d: bool) -> bool:
    """Which end rays are traced from: the less numerous one, stations if events may move, events if they have times of their own."""
    return four_d or (n_events <= n_stations and not relocate)


def pairs_to_rays(rays: DataFrame, from_events: bool) -> DataFrame:
    """(source_id, receiver_id, phase, ray_id)."""
    a, b = ("event_id", "station_id") if from_events else ("station_id", "event_id")
    return rays.select(F.col(a).alias("source_id"), F.col(b).alias("receiver_id"), "phase", "ray_id")


def shared_statics(statics: DataFrame) -> DataFrame:
    """statics: (obs_name, group_id, id). Pairs of observables (first name before second) that share a group and an id."""
    a, b = statics.alias("a"), statics.alias("b")
    same = (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.id") == F.col("b.id")) & (F.col("a.obs_name") < F.col("b.obs_name"))
    return a.join(b, same).select("a.group_id", "a.id", F.col("a.obs_name").alias("obs_a"), F.col("b.obs_name").alias("obs_b"))


def attached(rays: DataFrame, attributes: DataFrame, key: list[str]) -> DataFrame:
    """Rays with a descriptive attribute where there is one."""
    return rays.join(attributes, key, "left")


def gathered(observations: DataFrame, statics: DataFrame, key: list[str], name: str) -> DataFrame:
    """Observations with their static; 0 where there is none."""
    return observations.join(statics.withColumnRenamed("value", name), key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def first_inside(nodes: DataFrame, inside: Column) -> DataFrame:
    """(ray_id, first): the first node of a ray that enters a domain; null for a ray that never does."""
    return nodes.groupBy("ray_id").agg(F.min(F.when(inside, F.col("node_ix"))).alias("first"))


def outside_range(nodes: DataFrame, inside: Column) -> DataFrame:
    """(ray_id, first, last) of the nodes marked as outside: 1 .. the entering node, or the empty range 1 .. 0."""
    return first_inside(nodes, inside).select("ray_id", F.lit(1).alias("first"), F.coalesce("first", F.lit(0)).alias("last"))


def trimmed(nodes: DataFrame, inside: Column) -> DataFrame:
    """Each ray from its first node in the domain on (its last node alone, if it has none there), and elapsed: time from there to the end."""
    ray, first = Window.partitionBy("ray_id"), fresh(nodes, "_start")
    start = F.coalesce(F.min(F.when(inside, F.col("node_ix"))).over(ray), F.max("node_ix").over(ray))
    kept = nodes.withColumn(first, start).where(F.col("node_ix") >= F.col(first)).drop(first)
    return kept.withColumn("elapsed", F.max_by("t", "node_ix").over(ray) - F.min_by("t", "node_ix").over(ray))
