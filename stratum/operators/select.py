"""Selections: burn-in, trailing windows, domain boxes, phase names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.geo import to_geographic
from stratum.store import stored


def fresh(table: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of the table has it."""
    while name.lower() in {c.lower() for c in table.columns}:
        name = "_" + name
    return name


#: Most rows of a table that travels as one array to every task.
SHORT = 100_000


def short(table: DataFrame) -> DataFrame:
    """The table, if a count shows it to be short enough to travel whole; else an error."""
    if table.limit(SHORT + 1).count() > SHORT:
        raise ValueError(f"a table of more than {SHORT} rows can't travel as one array")
    return table


def drop_burn_in(models: DataFrame, chain: list[str], order: list[str], num_burn: int) -> DataFrame:
    """Each chain without its first num_burn saved models (the start model counts)."""
    w = Window.partitionBy(*chain).orderBy(*order)
    n = fresh(models, "_n")
    return models.withColumn(n, F.row_number().over(w)).where(F.col(n) > num_burn).drop(n)


def trailing(models: DataFrame, chain: list[str], order: list[str], count: int) -> DataFrame:
    """The last count saved models of each chain."""
    w = Window.partitionBy(*chain).orderBy(*(F.col(c).desc() for c in order))
    n = fresh(models, "_n")
    return models.withColumn(n, F.row_number().over(w)).where(F.col(n) <= count).drop(n)


def cold(models: DataFrame, temperature: str = "temperature") -> DataFrame:
    """Models sampled at temperature 1."""
    return models.where(F.col(temperature) == 1)


def within(value: Column, low: Column | float, high: Column | float) -> Column:
    """Inclusive bounds; equal bounds hold everything."""
    low, high = (F.lit(x) if isinstance(x, (int, float)) else x for x in (low, high))
    return (low == high) | value.between(low, high)


def in_box(lat: Column, lon: Column, r: Column, limits: dict[str, tuple[float, float]]) -> Column:
    """within() of all three coordinates; limits: lat, lon, r."""
    return within(lat, *limits["lat"]) & within(lon, *limits["lon"]) & within(r, *limits["r"])


def in_cartesian_box(x: Column, y: Column, z: Column, limits: dict[str, tuple[float, float]], geographic: bool = True) -> Column:
    """in_box() of Cartesian points, turned to geographic ones first if asked."""
    return in_box(*(to_geographic(x, y, z) if geographic else (x, y, z)), limits)


def in_domain(events: DataFrame, pairs: DataFrame, station_table: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Events inside a domain, and the stations paired with one of them. pairs: (event_id, station_id)."""
    chosen = events.where(inside)
    stations = station_table.join(pairs.join(chosen.select("event_id"), "event_id", "left_semi").select("station_id").distinct(), "station_id", "left_semi")
    return chosen, stations


def renumbered(table: DataFrame, ids: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows whose id is listed, with new positions 1 .. n in the order of ids."""
    kept = table.join(ids.select(key).distinct(), key, "left_semi")
    return positioned(kept, [key], position)


def positioned(table: DataFrame, order: list[str], position: str = "position") -> DataFrame:
    """table with positions 1 .. n in the given order. Counts of range partitions are summed on the driver (a number for each partition), so no task takes all rows."""
    if not table.columns:
        return table
    part, row, low, before = (fresh(table, x) for x in ("_part", "_row", "_low", "_before"))
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order)
    # stored, as ranges are sampled: numbers and counts must come from one and the same partitioning
    ranged = stored(ranged.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()))
    first = ranged.groupBy(part).agg(F.count("*").alias("_c"), F.min(row).alias(low))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = first.select(part, low, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(before))
    return ranged.join(F.broadcast(offset), part).withColumn(position, F.col(row) - F.col(low) + F.col(before) + 1).drop(part, row, low, before)


def active_fields(fields: DataFrame) -> DataFrame:
    """Fields whose prior limits differ."""
    return fields.where("vlo <> vhi")


def is_radial(limits: dict[str, tuple[float, float]]) -> bool:
    """Whether a field varies with radius only: its latitude and longitude limits are both degenerate."""
    return limits["lat"][0] == limits["lat"][1] and limits["lon"][0] == limits["lon"][1]


def split_observables(observables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictive ones (with a forward function) and descriptive ones."""
    name = F.coalesce(F.col("forward_name"), F.lit(""))
    return observables.where(name != ""), observables.where(name == "")


def bad_arrival(time: Column) -> Column:
    """Whether a predicted arrival is missing."""
    return time.isNull() | F.isnan(time) | (time == float("inf"))


#: Fixed names: phases whose diffracted form (with the suffix diff) stands in for them, and the other way round.
DIFFRACTED = ("P", "S", "pP", "sS", "p^9P", "s^9S")
ALTERNATIVE_PHASES = {f"{p}{a}": f"{p}{b}" for p in DIFFRACTED for a, b in (("", "diff"), ("diff", ""))}


def phase_fallback(phase: Column, distance: Column, missing: Column) -> Column:
    """The phase to use. Where its prediction is missing: PKIKP for P from 160 degrees on, else its alternative, else itself."""
    names = F.create_map(*[F.lit(x) for pair in ALTERNATIVE_PHASES.items() for x in pair])
    return F.when(~missing, phase).when((phase == "P") & (distance >= 160), "PKIKP").otherwise(F.coalesce(F.try_element_at(names, phase), phase))


def surface_reflection(phase: Column, height: str = "9") -> Column:
    """pP... and sS... with the height of the reflecting surface in their names: p^9P, s^9S."""
    return F.when(phase.rlike("^(pP|sS)"), F.concat(phase.substr(1, 1), F.lit(f"^{height}"), phase.substr(F.lit(2), F.length(phase)))).otherwise(phase)


def without_air(grid: DataFrame, velocity: str = "vp") -> DataFrame:
    """Nodes that a velocity is defined for."""
    return grid.where(F.col(velocity) > 0)
