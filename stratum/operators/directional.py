"""Directional tensors: means of f n n', their principal axes, and statistics of each sample's angle to the main axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.anisotropy import delta_of_epsilon
from stratum.functions.geo import direction
from stratum.functions.let import let
from stratum.operators.moments import ratio
from stratum.operators.select import fresh
from stratum.sources import vtk
from stratum.store import stored

PARTS = ("t11", "t12", "t13", "t22", "t23", "t33")


def tensor_products(f: Column, azimuth: Column, elevation: Column) -> dict[str, Column]:
    """Components of f n n'."""
    n = direction(azimuth, elevation)
    return {f"t{i + 1}{j + 1}": f * n[i] * n[j] for i in range(3) for j in range(i, 3)}


def mean_tensor(samples: DataFrame, keys: list[str], f: Column, azimuth: Column, elevation: Column) -> DataFrame:
    """(keys, t11 .. t33): the mean directional tensor."""
    return samples.groupBy(*keys).agg(*(F.avg(c).alias(name) for name, c in tensor_products(f, azimuth, elevation).items()))


def bias(t: dict[str, Column] | None = None) -> Column:
    """Fractional anisotropy of a symmetric tensor, from its trace and the trace of its square; NaN for the zero tensor."""
    t = t or {p: F.col(p) for p in PARTS}
    trace = t["t11"] + t["t22"] + t["t33"]
    square = t["t11"] ** 2 + t["t22"] ** 2 + t["t33"] ** 2 + 2 * (t["t12"] ** 2 + t["t13"] ** 2 + t["t23"] ** 2)
    return ratio(F.sqrt(F.lit(0.5)) * F.sqrt(F.greatest(F.lit(0.0), 3 * square - trace * trace)), F.sqrt(square))


AXES = [f"{name}{k}" for name in ("lambda", "x", "y", "z") for k in (1, 2, 3)]
#: Sweeps of three rotations; off-diagonal parts shrink by their square with each, so a handful reaches the last bit.
SWEEPS = 8
#: Samples whose arrays a task makes.
TOGETHER = 200_000
VECTORS = tuple(f"v{i}{j}" for i in range(1, 4) for j in range(1, 4))


def rotated(m: Column) -> Column:
    """One Jacobi rotation that clears element (1, 2) of a symmetric matrix (struct of t11 .. t33 and of the axes v11 .. v33 so far), after which axes 2, 3, 1 become 1, 2, 3: the next rotation is of the next pair."""
    tau = (m["t22"] - m["t11"]) / (2 * m["t12"])
    t = F.when(m["t12"] == 0, 0.0).otherwise(F.when(tau >= 0, 1.0).otherwise(-1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau)))

    def turned(k: Column) -> Column:
        t, c = k["t"], k["c"]
        s = t * c
        out = {"t11": m["t22"] + t * m["t12"], "t22": m["t33"], "t33": m["t11"] - t * m["t12"], "t12": s * m["t13"] + c * m["t23"], "t13": F.lit(0.0), "t23": c * m["t13"] - s * m["t23"]}
        for i in range(1, 4):
            out |= {f"v1{i}": s * m[f"v1{i}"] + c * m[f"v2{i}"], f"v2{i}": m[f"v3{i}"], f"v3{i}": c * m[f"v1{i}"] - s * m[f"v2{i}"]}
        return F.struct(*(out[name].alias(name) for name in (*PARTS, *VECTORS)))

    return let(let(t, lambda t: F.struct(t.alias("t"), (1 / F.sqrt(1 + t * t)).alias("c"))), turned)


def principal_axes(t: dict[str, Column] | None = None) -> Column:
    """Array of three structs (size, axis, lambda, x, y, z) in ascending order of |lambda|: eigenvalues and unit eigenvectors, whose largest component is positive, by cyclic Jacobi rotations."""
    t = t or {p: F.col(p) for p in PARTS}
    start = F.struct(*(t[p].cast("double").alias(p) for p in PARTS), *(F.lit(float(v[1] == v[2])).alias(v) for v in VECTORS))
    whole = F.lit(True)
    for p in PARTS:
        whole = whole & t[p].isNotNull() & ~F.isnan(t[p])

    def axis(m: Column, k: int) -> Column:
        v = [m[f"v{k}{i}"] for i in range(1, 4)]
        x, y, z = (F.abs(c) for c in v)
        sign = F.when(F.when((x >= y) & (x >= z), v[0]).when(y >= z, v[1]).otherwise(v[2]) < 0, -1.0).otherwise(1.0)
        return F.struct(F.abs(m[f"t{k}{k}"]).alias("size"), F.lit(k).alias("axis"), m[f"t{k}{k}"].alias("lambda"), *((c * sign).alias(n) for c, n in zip(v, "xyz", strict=True)))

    # a multiple of three rotations: axes are where they were
    end = F.aggregate(F.sequence(F.lit(1), F.lit(3 * SWEEPS)), start, lambda m, _: rotated(m))
    return F.when(whole, let(end, lambda m: F.array_sort(F.array(*(axis(m, k) for k in (1, 2, 3))))))


def with_axes(tensors: DataFrame) -> DataFrame:
    """Tensors with their principal axes (columns of AXES: eigenvalues ascending in size, unit eigenvectors) and directional bias; null axes for a tensor with a null or NaN part."""
    a = fresh(tensors, "_axes")
    columns = [F.col(a)[int(name[-1]) - 1][name[:-1]].alias(name) for name in AXES]
    return tensors.withColumn(a, principal_axes()).select(*tensors.columns, *columns, bias().alias("bias"))


def deviations(samples: DataFrame, axes: DataFrame, keys: list[str], f: Column, azimuth: Column, elevation: Column) -> DataFrame:
    """Samples with strength, prj (projection on the main axis) and angle (to it, 0 .. pi/2; 0 where undefined). axes: keys, lambda3, x3, y3, z3."""
    u = [f * c for c in direction(azimuth, elevation)]
    v = [F.col("lambda3") * F.col(c) for c in ("x3", "y3", "z3")]
    dot = F.abs(u[0] * v[0] + u[1] * v[1] + u[2] * v[2])
    nu, nv = F.abs(f), F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])  # directions are of unit length
    cosine = ratio(dot, nu * nv)
    angle = F.when(nu * nv == 0, 0.0).otherwise(0.5 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * cosine * cosine - 1))))
    return samples.join(axes.select(*keys, "lambda3", "x3", "y3", "z3"), keys).withColumns({"strength": nu, "prj": F.when(nv == 0, 0.0).otherwise(dot / nv), "angle": angle}).drop("lambda3", "x3", "y3", "z3")


def directional_moments(samples: DataFrame, keys: list[str], f: Column, azimuth: Column, elevation: Column, field: str | None = None) -> DataFrame:
    """Two passes: mean tensor and its axes, then means and deviations of strength and projection, the strength-weighted mean and deviation of the angle, and the correlation of a scalar field with the projection."""
    axes = with_axes(mean_tensor(samples, keys, f, azimuth, elevation))
    d = deviations(samples, axes, keys, f, azimuth, elevation)
    w, x = F.col("strength"), F.col("angle")
    sd = lambda m, q: F.sqrt(F.greatest(F.lit(0.0), q - m * m))
    aggs = [F.avg("strength").alias("m1"), F.avg(F.col("strength") ** 2).alias("q1"), F.avg("prj").alias("m2"), F.avg(F.col("prj") ** 2).alias("q2"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx")]
    if field:
        aggs += [F.avg(field).alias("m3"), F.avg(F.col(field) ** 2).alias("q3"), F.avg(F.col(field) * F.col("prj")).alias("m23")]
    g = d.groupBy(*keys).agg(*aggs)
    c = F.col
    angle = ratio(c("swx"), c("sw"))
    out = [c("m1").alias("strength_mean"), sd(c("m1"), c("q1")).alias("strength_sd"), c("m2").alias("prj_mean"), sd(c("m2"), c("q2")).alias("prj_sd"), angle.alias("angle_mean"), sd(angle, ratio(c("swxx"), c("sw"))).alias("angle_sd")]
    if field:
        out.append(ratio(c("m23") - c("m2") * c("m3"), sd(c("m2"), c("q2")) * sd(c("m3"), c("q3"))).alias(f"pcc_{field}_prj"))
    return g.select(*keys, *out).join(axes.select(*keys, "bias"), keys)


def tracing_anisotropy(samples: DataFrame, keys: list[str], strength: Column, epsilon: Column, azimuth: Column, elevation: Column, least_bias: float = 0.75) -> DataFrame:
    """(keys, n1, n2, n3, epsilon, delta) for graph.directed_edges(): the main axis of the mean tensor of `strength`, the mean of epsilon projected on it, and delta of cracks of that epsilon. Where directions agree too little (bias under least_bias) both parameters are 0."""
    axes = with_axes(mean_tensor(samples, keys, strength, azimuth, elevation))
    n = direction(azimuth, elevation)
    onto = epsilon * F.abs(n[0] * F.col("x3") + n[1] * F.col("y3") + n[2] * F.col("z3"))
    mean = samples.join(axes.select(*keys, "x3", "y3", "z3", "bias"), keys).groupBy(*keys, "x3", "y3", "z3", "bias").agg(F.avg(onto).alias("_e"))
    e = F.when(F.col("bias") > least_bias, F.col("_e")).otherwise(0.0)
    return mean.select(*keys, F.col("x3").alias("n1"), F.col("y3").alias("n2"), F.col("z3").alias("n3"), e.alias("epsilon"), delta_of_epsilon(e).alias("delta"))


def prior_moments(spark: SparkSession, strength: tuple[float, float], azimuth: tuple[float, float], elevation: tuple[float, float], n: int = 100_000, sine: bool = False, seed: int = 1) -> DataFrame:
    """directional_moments() of n samples of uniform priors: what the data must move an ensemble away from. sine: the limits of elevation are of its sine."""
    draw = lambda limits, k: limits[0] + (limits[1] - limits[0]) * F.rand(seed + k)
    e = draw(elevation, 2)
    s = spark.range(n).select(F.lit(0).alias("prior"), draw(strength, 0).alias("f"), draw(azimuth, 1).alias("azimuth"), (F.asin(e) if sine else e).alias("elevation"))
    return directional_moments(stored(s), ["prior"], F.col("f"), F.col("azimuth"), F.col("elevation"))


def write_directional(axes: DataFrame, places: DataFrame, path: str, dims: tuple[int, int, int], point: str = "node_ix") -> None:
    """A VTK file of with_axes() at every point of a lattice: directional_bias, the eigenvalues, and symmetry_axis (the main axis times the root of its eigenvalue) as a vector. places: (point, x, y, z)."""
    size = F.sqrt(F.abs(F.col("lambda3")))
    table = axes.join(places.select(point, "x", "y", "z"), point).select(point, "x", "y", "z", F.col("bias").alias("directional_bias"), "lambda1", "lambda2", "lambda3", *((F.col(f"{c}3") * size).alias(f"axis_{c}") for c in "xyz"))
    vtk.write(table, path, dims, point, vectors={"symmetry_axis": ["axis_x", "axis_y", "axis_z"]})


def directional_tendencies(samples: DataFrame, keys: list[str], f: Column, azimuth: Column, elevation: Column, limits: dict[str, tuple[float, float]], level: float = 0.9) -> DataFrame:
    """Tendencies of strength, projection and angle (long in field), limits giving each one's prior range, with the strength-weighted mean and median of the angle; each weight stays with its sample."""
    from stratum.operators import order_stats

    fa, az, el = (fresh(samples, c) for c in ("_f", "_azimuth", "_elevation"))
    samples = samples.select(*keys, f.alias(fa), azimuth.alias(az), elevation.alias(el))
    columns = F.col(fa), F.col(az), F.col(el)
    axes = with_axes(mean_tensor(samples, keys, *columns))
    # whole groups, in as many tasks as samples ask for; both sides of the join are dealt alike, so one shuffle of samples serves it and the arrays
    tasks = max(1, -(-samples.count() // TOGETHER))
    d = deviations(samples.repartition(tasks, *keys), axes.repartition(tasks, *keys), keys, *columns)
    weight, angle = F.col("strength"), F.col("angle")
    pairs = F.array_sort(F.collect_list(F.struct(angle.alias("x"), weight.alias("w")))).alias("_pairs")
    others = [name for name in limits if name != "angle"]
    mean = ratio(F.sum(angle * weight), F.sum(weight)).alias("weighted_mean")
    g = d.groupBy(*keys).agg(pairs, F.sum(weight).alias("_total"), mean, *(F.avg(n).alias(f"_mean_{n}") for n in limits), *(F.sort_array(F.collect_list(n)).alias(f"_s_{n}") for n in others))
    # pairs are sorted by angle first
    s = {name: F.transform("_pairs", lambda p: p["x"]) if name == "angle" else F.col(f"_s_{name}") for name in limits}
    fields = F.array(*(F.struct(F.lit(name).alias("field"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.col(f"_mean_{name}").alias("mean"), s[name].alias("s")) for name, (low, high) in limits.items()))
    long = g.select(*keys, F.explode(fields).alias("_t"), "weighted_mean", order_stats.middle_weight(F.col("_pairs"), F.col("_total")).alias("weighted_median"))
    t = F.col("_t")
    own = [F.when(t["field"] == "angle", F.col(c)).alias(c) for c in ("weighted_mean", "weighted_median")]
    return long.select(*keys, t["mean"].alias("mean"), *order_stats.statistics(t["s"], t["low"], t["high"], level), t["field"].alias("field"), *own)
