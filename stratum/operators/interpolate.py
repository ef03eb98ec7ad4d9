"""Interpolation in one-dimensional models and along polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.let import let
from stratum.operators.select import fresh, short


def reference_values(points: DataFrame, knots: DataFrame, at: str, radius: str, values: list[str]) -> DataFrame:
    """points with values of a one-dimensional model at radius `at`: linear between knots, held at both ends. The model is a short table: its knots travel as one broadcast array, and points are neither shuffled nor multiplied."""
    held, above, below = (fresh(points, x) for x in ("_knots", "_above", "_below"))
    row = short(knots).agg(F.array_sort(F.collect_list(F.struct(F.col(radius).alias("r"), *values))).alias(held))
    p = points.join(F.broadcast(row), F.lit(True))
    r = F.col(at)
    higher, lower = F.filter(held, lambda k: k["r"] > r), F.filter(held, lambda k: k["r"] <= r)
    p = p.withColumn(above, F.get(higher, 0)).withColumn(below, F.try_element_at(lower, F.lit(-1))).drop(held)
    a, b = F.coalesce(above, below), F.coalesce(below, above)
    share = F.when(a["r"] > b["r"], (r - b["r"]) / (a["r"] - b["r"])).otherwise(0.0)
    for v in values:
        p = p.withColumn(v, b[v] + (a[v] - b[v]) * share)
    return p.drop(above, below)


def path_lengths(nodes: DataFrame, ray: str, order: str, coords: list[str]) -> DataFrame:
    """nodes with step (distance from the node before; 0 at the first) and along (distance from the first)."""
    w = Window.partitionBy(ray).orderBy(order)
    square = sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coords), F.lit(0.0))
    steps = nodes.withColumn("step", F.coalesce(F.sqrt(square), F.lit(0.0)))
    return steps.withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def resampled(nodes: DataFrame, ray: str, order: str, coords: list[str], spacing: float) -> DataFrame:
    """Each polyline at trunc(length / spacing) + 1 equally spaced places, by linear interpolation; polylines shorter than spacing stay as they are."""
    at = path_lengths(nodes, ray, order, coords)
    whole = at.groupBy(ray).agg(F.max("along").alias("_length"), F.max(order).alias("_last"))
    whole = whole.withColumn("_n", F.floor(F.col("_length") / spacing).cast("int"))
    w = Window.partitionBy(ray).orderBy(order)
    segments = at.withColumn("_next", F.lead("along").over(w))
    for c in coords:
        segments = segments.withColumn(f"_{c}", F.lead(c).over(w))
    segments = segments.join(whole, ray)
    short = segments.where("_n = 0").select(ray, (F.row_number().over(w) - 1).alias("seq"), *coords)
    # positions of a segment are generated from its own ends, so no row meets another's positions
    gap = F.col("_length") / F.col("_n")
    first = F.ceil(F.col("along") / gap - F.lit(1e-9)).cast("int")
    last = F.when(F.col("_next") >= F.col("_length"), F.col("_n")).otherwise(F.ceil(F.col("_next") / gap - F.lit(1e-9)).cast("int") - 1)
    long = segments.where("_n > 0 AND _next > along").withColumn("_first", first).withColumn("_end", last).where("_end >= _first")
    long = long.withColumn("seq", F.explode(F.sequence(F.col("_first"), F.col("_end"))))
    share = (F.col("seq") * gap - F.col("along")) / (F.col("_next") - F.col("along"))
    return short.unionByName(long.select(ray, "seq", *((F.col(c) + share * (F.col(f"_{c}") - F.col(c))).alias(c) for c in coords)))


def second_derivatives(p: Column, c: str) -> Column:
    """Of the cubic spline through coordinate c of the array p (structs with `along`, strictly ascending): an array as long as p.

    The third derivative is continuous at the second and the last but one knot (not-a-knot ends); of three knots one parabola, of two a line. The tridiagonal system is solved
    by one fold forward and one back.
    """
    n = F.size(p)
    h = lambda i: F.get(p, i + 1)["along"] - F.get(p, i)["along"]
    slope = lambda i: (F.get(p, i + 1)[c] - F.get(p, i)[c]) / h(i)
    none = F.array().cast("array<struct<u:double,d:double>>")

    def forward(acc: Column, i: Column) -> Column:
        """Row i of the system less its part below the diagonal: what is above (u) and on the right (d), over the diagonal."""

        def row(k: Column) -> Column:
            h0, h1 = k["h0"], k["h1"]
            # the ends' derivatives are linear in the next two, which changes the first and the last row
            first, last = i == 1, i == n - 2
            below = F.when(first, 0.0).when(last, h0 - h1 * h1 / h0).otherwise(h0)
            above = F.when(last, 0.0).when(first, h1 - h0 * h0 / h1).otherwise(h1)
            on = 2 * (h0 + h1) + F.when(first, h0 + h0 * h0 / h1).otherwise(0.0) + F.when(last, h1 + h1 * h1 / h0).otherwise(0.0)
            before = F.try_element_at(acc, F.lit(-1))
            u, d = F.coalesce(before["u"], F.lit(0.0)), F.coalesce(before["d"], F.lit(0.0))
            right = 6 * (slope(i) - slope(i - 1))
            return let(on - below * u, lambda m: F.struct((above / m).alias("u"), ((right - below * d) / m).alias("d")))

        return F.concat(acc, F.array(let(F.struct(h(i - 1).alias("h0"), h(i).alias("h1")), row)))

    rows = F.aggregate(F.sequence(F.lit(1), n - 2), none, forward)
    inner = F.reverse(F.aggregate(F.reverse(rows), F.array().cast("array<double>"), lambda acc, k: F.concat(acc, F.array(k["d"] - k["u"] * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))))
    end = lambda m, a, b, i, j: F.get(m, a) + (F.get(m, a) - F.get(m, b)) * h(i) / h(j)
    whole = let(inner, lambda m: F.concat(F.array(end(m, F.lit(0), F.lit(1), F.lit(0), F.lit(1))), m, F.array(end(m, n - 3, n - 4, n - 2, n - 3))))
    bend = 2 * (slope(F.lit(1)) - slope(F.lit(0))) / (h(F.lit(0)) + h(F.lit(1)))
    return F.when(n >= 4, whole).when(n == 3, F.array_repeat(bend, 3)).otherwise(F.array_repeat(F.lit(0.0), n))


def splined(nodes: DataFrame, ray: str, order: str, coords: list[str], spacing: float) -> DataFrame:
    """resampled() by cubic splines of each coordinate over the distance along the polyline, with not-a-knot ends. Nodes at the place of the one before are left out; polylines shorter than spacing stay as they are.

    A polyline's nodes are one sorted array, whose length is that of a ray, whatever the number of rays.
    """
    own = nodes.select(ray, order, *coords)
    at = path_lengths(own, ray, order, coords)
    whole = at.groupBy(ray).agg(F.array_sort(F.collect_list(F.struct("along", order, "step", *coords))).alias("_p"))
    whole = whole.withColumn("_length", F.try_element_at("_p", F.lit(-1))["along"]).withColumn("_n", F.floor(F.col("_length") / spacing).cast("int"))
    short = whole.where("_n = 0").select(ray, F.posexplode("_p").alias("seq", "_k")).select(ray, "seq", *(F.col(f"_k.{c}").alias(c) for c in coords))
    long = whole.where("_n > 0").withColumn("_p", F.filter("_p", lambda k, i: (k["step"] > 0) | (i == 0)))
    long = long.withColumns({f"_m_{i}": second_derivatives(F.col("_p"), c) for i, c in enumerate(coords)})
    ends = lambda i: F.struct(F.get("_p", i).alias("a"), F.get("_p", i + 1).alias("b"), *(F.struct(F.get(f"_m_{k}", i).alias("a"), F.get(f"_m_{k}", i + 1).alias("b")).alias(f"m{k}") for k in range(len(coords))))
    pieces = long.select(ray, "_length", "_n", F.explode(F.transform(F.sequence(F.lit(0), F.size("_p") - 2), ends)).alias("_s"))
    gap, low, high = F.col("_length") / F.col("_n"), F.col("_s.a.along"), F.col("_s.b.along")
    first = F.ceil(low / gap - F.lit(1e-9)).cast("int")
    last = F.when(high >= F.col("_length"), F.col("_n")).otherwise(F.ceil(high / gap - F.lit(1e-9)).cast("int") - 1)
    pieces = pieces.withColumn("_first", first).withColumn("_end", last).where("_end >= _first").withColumn("seq", F.explode(F.sequence(F.col("_first"), F.col("_end"))))
    h, u = high - low, F.col("seq") * gap - low
    v = h - u

    def value(k: int, c: str) -> Column:
        ya, yb, ma, mb = F.col(f"_s.a.{c}"), F.col(f"_s.b.{c}"), F.col(f"_s.m{k}.a"), F.col(f"_s.m{k}.b")
        return (ma * v * v * v + mb * u * u * u) / (6 * h) + (ya / h - ma * h / 6) * v + (yb / h - mb * h / 6) * u

    return short.unionByName(pieces.select(ray, "seq", *(value(k, c).alias(c) for k, c in enumerate(coords))))


def last_repeated(value: Column, ray: str, order: str) -> Column:
    """A per-segment value carried to a ray's last node."""
    return F.coalesce(value, F.lag(value).over(Window.partitionBy(ray).orderBy(order)))


def demeaned(rows: DataFrame, group: list[str], value: str, name: str = "demeaned") -> DataFrame:
    """Value less the mean of its group (NaN values don't count in the mean). The means are a small aggregate that joins back, so a large group is never held by one task."""
    means = group_means(rows, group, value)
    m = fresh(rows, "_m")
    return rows.join(means.select(*group, F.col("mean").alias(m)), group).withColumn(name, F.col(value) - F.col(m)).drop(m)


def group_means(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, mean, n) of values that aren't NaN; the mean of none is NaN."""
    ok = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*group).agg(F.coalesce(F.avg(ok), F.lit(float("nan"))).alias("mean"), F.count(ok).alias("n"))
