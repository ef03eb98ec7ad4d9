"""Velocity and slowness of anisotropic media as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions import either as E


def axis_cosine(azimuth: Column, elevation: Column, axis_azimuth: Column, axis_elevation: Column) -> Column:
    """Cosine between propagation and symmetry axis."""
    return E.cos(azimuth - axis_azimuth) * E.cos(elevation) * E.cos(axis_elevation) + E.sin(elevation) * E.sin(axis_elevation)


def axis_twist(azimuth: Column, elevation: Column, polarization: Column, axis_azimuth: Column, axis_elevation: Column) -> Column:
    """Angle between polarization and the symmetry axis seen along the ray."""
    d = axis_azimuth - azimuth
    return E.atan2(-E.sin(d) * E.cos(axis_elevation), E.cos(d) * E.sin(elevation) * E.cos(axis_elevation) - E.cos(elevation) * E.sin(axis_elevation)) - polarization


def thomsen_p(v0: Column, dlnvp: Column, epsilon: Column, delta: Column, cosine: Column) -> Column:
    """P slowness; v0 is the isotropic mean velocity."""
    c2 = cosine * cosine
    s2 = 1 - c2
    alpha = v0 * (1 + dlnvp) / E.sqrt(1 + 16 * epsilon / 15 + 4 * delta / 15)
    return 1 / (alpha * E.sqrt(1 + 2 * delta * s2 * c2 + 2 * epsilon * s2 * s2))


def thomsen_s(vp: Column, vs: Column, epsilon: Column, delta: Column, gamma: Column, cosine: Column) -> tuple[Column, Column]:
    """Slownesses of the two S waves; vp and vs are isotropic mean velocities."""
    c2 = cosine * cosine
    s2 = 1 - c2
    alpha = vp / E.sqrt(1 + 16 * epsilon / 15 + 4 * delta / 15)
    beta = E.sqrt((vs * vs - E.lit(2 / 15) * alpha * alpha * (epsilon - delta)) / (1 + E.lit(2 / 3) * gamma))
    ratio = alpha / beta
    return 1 / (beta * E.sqrt(1 + 2 * ratio * ratio * (epsilon - delta) * c2 * s2)), 1 / (beta * E.sqrt(1 + 2 * gamma * s2))


def s_arrival(slow1: Column, slow2: Column, twist: Column) -> Column:
    """Apparent slowness of the principal S arrival."""
    return slow2 + (slow1 - slow2) * E.cos(twist) * E.cos(twist)


def splitting(slow1: Column, slow2: Column, twist: Column) -> Column:
    """Splitting intensity of a unit length."""
    return 0.5 * (slow2 - slow1) * E.sin(2 * twist)


def tracing_velocity(columns: set[str], vp: Column, vs: Column) -> tuple[Column, Column]:
    """Vp and Vs of a node from reference values and the fields there are, applied in a fixed order."""
    has = lambda name: F.col(name) if name in columns else None
    ratio = vp / vs
    if (c := has("Vp")) is not None:
        vp = c
    if (c := has("dlnVp")) is not None:
        vp = vp * (1 + c)
    if (c := has("dlnSp")) is not None:
        vp = vp / (1 + c)
    if (c := has("Vs")) is not None:
        vs = c
    if (c := has("dlnVs")) is not None:
        vs = vs * (1 + c)
    if (c := has("Vp2Vs")) is not None:
        vs = vp / c
    if (c := has("dlnVp2Vs")) is not None:
        vs = vp / (ratio * (1 + c))
    if (c := has("eta")) is not None:
        vs = vs * (1 + F.col("dlnVp") * c)
    return vp, vs


def thomsen_p_velocity(v0: Column, dlnvp: Column, epsilon: Column, delta: Column, cosine: Column) -> Column:
    return 1 / thomsen_p(v0, dlnvp, epsilon, delta, cosine)


#: Fixed values of the rational fits below (published parameters of a crack model and a melt model).
DELTA_FIT = (0.6742, -0.8169, 0.04419)
MELT_DLNVP, MELT_DLNVP_POLE = (-0.4363, -0.1672, -2.759e-5), 2.693e-2
MELT_EPSILON, MELT_DELTA = (-2.1911, 2.1881, -1.4518e-3), (-0.3302, 0.01573)


def delta_of_epsilon(epsilon: Column) -> Column:
    """Thomsen delta of aligned cracks; elliptical (delta = epsilon) where epsilon is not positive."""
    a, b, c = DELTA_FIT
    return F.when(epsilon > 0, epsilon * (a * epsilon + b) / (epsilon + c)).otherwise(epsilon)


def melt(fraction: Column, dlnvp: Column) -> tuple[Column, Column, Column]:
    """Thomsen epsilon and delta and the whole velocity change of a melt fraction."""
    square = lambda p: p[0] * fraction * fraction + p[1] * fraction + p[2]
    epsilon = square(MELT_EPSILON)
    return epsilon, epsilon * MELT_DELTA[0] / (fraction + MELT_DELTA[1]), dlnvp + square(MELT_DLNVP) / (fraction + MELT_DLNVP_POLE)
