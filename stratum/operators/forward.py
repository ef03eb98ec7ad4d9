"""Forward functions: integrals of nodal slowness along rays.

A node table has a row for each node of each ray: ray_id, node_ix, vp1d, vs1d (reference velocities), azimuth,
elevation, polarization (radians), seg_len (length to the next node; null at the last), and a column for each field
a function reads. A function's name says what it predicts: tt_ a travel time less the ray's reference time, si_ a
splitting intensity. Functions are registered by name, and unknown names or missing fields fail before any job runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import either as E
from stratum.functions.anisotropy import axis_cosine, axis_twist, s_arrival, splitting, thomsen_p, thomsen_s

C = E.col


@dataclass(frozen=True)
class Forward:
    fields: tuple[str, ...]
    slowness: Callable[[], Column]
    intensity: bool = False


REGISTRY: dict[str, Forward] = {}


def register(name: str, *fields: str):
    """Add a slowness expression under a name; the name starts with tt_ or si_."""

    def add(slowness: Callable[[], Column]):
        REGISTRY[name] = Forward(fields, slowness, name.startswith("si_"))
        return slowness

    return add


def ray_cosine(axis_azimuth: Column, axis_elevation: Column) -> Column:
    return axis_cosine(C("azimuth"), C("elevation"), axis_azimuth, axis_elevation)


def ray_twist(axis_azimuth: Column, axis_elevation: Column) -> Column:
    return axis_twist(C("azimuth"), C("elevation"), C("polarization"), axis_azimuth, axis_elevation)


def twice(cosine: Column) -> Column:
    """Cosine of the double angle."""
    return 2 * cosine * cosine - 1


def fast(strength: str, cosine: Column) -> Column:
    """Velocity factor of hexagonal symmetry."""
    return 1 + C(strength) * twice(cosine)


def vp_reference() -> Column:
    return (1 + C("dlnVp")) * C("vp1d")


def vs_reference() -> Column:
    return (1 + C("dlnVs")) * C("vs1d")


register("tt_P_Vp", "Vp")(lambda: 1 / C("Vp"))
register("tt_P_dlnVp", "dlnVp")(lambda: 1 / vp_reference())
register("tt_P_dlnVp_Vp", "dlnVp", "Vp")(lambda: 1 / ((1 + C("dlnVp")) * C("Vp")))
register("tt_P_dlnVs_Vp2Vs", "dlnVs", "Vp2Vs")(lambda: 1 / (vs_reference() * C("Vp2Vs")))
register("tt_P_dlnVp_fp", "dlnVp", "fp")(lambda: 1 / (fast("fp", E.sin(C("elevation"))) * vp_reference()))
register("tt_P_Vp_fp_psi", "Vp", "fp", "psi")(lambda: 1 / (fast("fp", E.cos(C("azimuth") - C("psi"))) * C("Vp")))
register("tt_P_dlnVp_fp_psi", "dlnVp", "fp", "psi")(lambda: 1 / (fast("fp", E.cos(C("azimuth") - C("psi"))) * vp_reference()))
register("tt_P_dlnVp_fp_psi_gamma", "dlnVp", "fp", "psi", "gamma")(lambda: 1 / (fast("fp", ray_cosine(C("psi"), C("gamma"))) * vp_reference()))
register("tt_P_dlnVp_fp_psi_v3", "dlnVp", "fp", "psi", "v3")(lambda: 1 / (fast("fp", ray_cosine(C("psi"), E.asin(C("v3")))) * vp_reference()))
register("tt_P_dlnVp_Vp_fp_psi_gamma", "dlnVp", "Vp", "fp", "psi", "gamma")(lambda: 1 / (fast("fp", ray_cosine(C("psi"), C("gamma"))) * (1 + C("dlnVp")) * C("Vp")))
register("tt_P_dlnVs_Vp2Vs_fp_psi_gamma", "dlnVs", "Vp2Vs", "fp", "psi", "gamma")(lambda: 1 / (fast("fp", ray_cosine(C("psi"), C("gamma"))) * vs_reference() * C("Vp2Vs")))


@register("tt_P_dlnVp_fp_psi_gamma_thomsen", "dlnVp", "fp", "psi", "gamma")
def p_elliptical() -> Column:
    """gamma is the sine of the axis elevation; both Thomsen parameters are -fp."""
    return thomsen_p(C("vp1d"), C("dlnVp"), -C("fp"), -C("fp"), ray_cosine(C("psi"), E.asin(C("gamma"))))


def p_magnitude(elevation: Column) -> Column:
    return thomsen_p(C("vp1d"), C("dlnVp"), C("AniMag"), C("AniMag"), ray_cosine(C("SymAzm"), elevation))


register("tt_P_dlnVp_AniMag_SymAzm_SymRad_Thomsen", "dlnVp", "AniMag", "SymAzm", "SymRad")(lambda: p_magnitude(E.asin(C("SymRad"))))
register("tt_P_dlnVp_AniMag_SymAzm_SymElv_Thomsen", "dlnVp", "AniMag", "SymAzm", "SymElv")(lambda: p_magnitude(C("SymElv")))

register("tt_S_Vs", "Vs")(lambda: 1 / C("Vs"))
register("tt_S_dlnVs", "dlnVs")(lambda: 1 / vs_reference())
register("tt_S_Vp_Vp2Vs", "Vp", "Vp2Vs")(lambda: C("Vp2Vs") / C("Vp"))
register("tt_S_dlnVp_Vp2Vs", "dlnVp", "Vp2Vs")(lambda: C("Vp2Vs") / vp_reference())
register("tt_S_dlnVp_r", "dlnVp", "r")(lambda: 1 / ((1 + C("dlnVp") * C("r")) * C("vs1d")))


def shear(fsh: Column, fsv: Column) -> tuple[Column, Column, Column]:
    """Relative slownesses of both S waves of hexagonal symmetry, and the angle of the faster one to the polarization."""
    psi, gamma = C("psi"), C("gamma")
    double = twice(ray_cosine(psi, gamma))
    d = C("azimuth") - psi
    along, across = E.cos(d) * E.sin(C("elevation")) * E.cos(gamma) - E.cos(C("elevation")) * E.sin(gamma), -E.sin(d) * E.cos(gamma)
    # a zero denominator is a right angle; the sign of the angle falls out of all that follows
    beta = E.choose(along == 0, E.lit(math.pi / 2), E.atan(across / E.choose(along == 0, E.lit(1.0), along))) - C("polarization")
    return 1 / (1 + fsh * double), (1 + fsv) / ((1 + fsh) * (1 + fsv * (2 * double * double - 1))), beta


def shear_arrival(fsh: Column, fsv: Column, velocity: Column) -> Column:
    one, two, beta = shear(fsh, fsv)
    return (E.sin(beta) * E.sin(beta) * one + E.cos(beta) * E.cos(beta) * two) / velocity


#: Fixed ratios of S to P anisotropy, and of vertical to horizontal S anisotropy.
SH_OF_P, SV_OF_SH = 0.63, 1 / -4.75


@register("tt_S_dlnVs_Vp2Vs_fp_psi_gamma", "dlnVs", "Vp2Vs", "fp", "psi", "gamma")
def s_of_p() -> Column:
    fsh = C("fp") * SH_OF_P
    return shear_arrival(fsh, fsh * SV_OF_SH, C("vp1d") * (1 + C("dlnVs")) / C("Vp2Vs"))


register("tt_S_dlnVs_fsh_psi_gamma", "dlnVs", "fsh", "psi", "gamma")(lambda: shear_arrival(C("fsh"), E.lit(0.0), vs_reference()))


@register("si_S_dlnVs_fsh_psi_gamma", "dlnVs", "fsh", "psi", "gamma")
def shear_splitting() -> Column:
    one, two, beta = shear(C("fsh"), E.lit(0.0))
    return 0.5 * E.sin(2 * beta) * (one - two) / vs_reference()


@register("tt_S_dlnVs_fsh_psi_gamma_thomsen", "dlnVs", "fsh", "psi", "gamma")
def s_elliptical() -> Column:
    """Thomsen gamma is -fsh; epsilon and delta are 0."""
    zero = E.lit(0.0)
    one, two = thomsen_s(vs_reference() * 1.8201, vs_reference(), zero, zero, -C("fsh"), ray_cosine(C("psi"), C("gamma")))
    return s_arrival(one, two, ray_twist(C("psi"), C("gamma")))


def s_magnitude(vp: Column, vs: Column, elevation: Column, combine) -> Column:
    one, two = thomsen_s(vp, vs, C("AniMag"), C("AniMag"), C("AniMag"), ray_cosine(C("SymAzm"), elevation))
    return combine(one, two, ray_twist(C("SymAzm"), elevation))


def joint() -> tuple[Column, Column]:
    vp = vp_reference()
    return vp, vp / (C("vp1d") / C("vs1d") * (1 + C("dlnVp2Vs")))


def scaled() -> tuple[Column, Column]:
    return vs_reference() * (C("vp1d") / C("vs1d")), vs_reference()


AXIS = "AniMag", "SymAzm"
register("tt_S_dlnVs_AniMag_SymAzm_SymRad_Thomsen", "dlnVs", *AXIS, "SymRad")(lambda: s_magnitude(*scaled(), E.asin(C("SymRad")), s_arrival))
register("tt_S_dlnVs_AniMag_SymAzm_SymElv_Thomsen", "dlnVs", *AXIS, "SymElv")(lambda: s_magnitude(*scaled(), C("SymElv"), s_arrival))
register("tt_S_dlnVp_dlnVp2Vs_AniMag_SymAzm_SymRad_Thomsen", "dlnVp", "dlnVp2Vs", *AXIS, "SymRad")(lambda: s_magnitude(*joint(), E.asin(C("SymRad")), s_arrival))
register("si_S_AniMag_SymAzm_SymRad_Thomsen", *AXIS, "SymRad")(lambda: s_magnitude(C("vp1d"), C("vs1d"), E.asin(C("SymRad")), splitting))
register("si_S_AniMag_SymAzm_SymElv_Thomsen", *AXIS, "SymElv")(lambda: s_magnitude(C("vp1d"), C("vs1d"), C("SymElv"), splitting))
register("si_S_dlnVp_dlnVp2Vs_AniMag_SymAzm_SymRad_Thomsen", "dlnVp", "dlnVp2Vs", *AXIS, "SymRad")(lambda: s_magnitude(*joint(), E.asin(C("SymRad")), splitting))


def slowness(name: str, columns: dict):
    """The nodal slowness (or splitting intensity) of a forward function for numpy arrays by column, as a plan computes it for Columns."""
    with E.arrays(columns):
        return REGISTRY[name].slowness()


def predicted(nodes: DataFrame, name: str, references: DataFrame | None = None) -> DataFrame:
    """(ray_id, predicted) by the forward function called name. references: (ray_id, ref_t), needed by tt_ functions only."""
    if name not in REGISTRY:
        raise ValueError(f"no forward function {name!r}; there are {sorted(REGISTRY)}")
    f = REGISTRY[name]
    if missing := [x for x in f.fields if x not in nodes.columns]:
        raise ValueError(f"{name} reads fields that the nodes lack: {missing}")
    along = Window.partitionBy("ray_id").orderBy("node_ix")
    u = nodes.select("ray_id", "node_ix", "seg_len", f.slowness().alias("u"))
    # a segment's slowness is the mean of its ends
    segments = u.withColumn("mean_u", (F.col("u") + F.lead("u").over(along)) / 2)
    out = segments.groupBy("ray_id").agg(F.coalesce(F.sum(F.col("seg_len") * F.col("mean_u")), F.lit(0.0)).alias("predicted"))
    if f.intensity or references is None:
        return out
    return out.join(references, "ray_id").select("ray_id", (F.col("predicted") - F.col("ref_t")).alias("predicted"))


def with_outside(nodes: DataFrame, field: str, first: Column, last: Column, reference: float) -> DataFrame:
    """The field's value replaced by its reference value on nodes first .. last (outside its domain); an empty range replaces nothing."""
    return nodes.withColumn(field, F.when(F.col("node_ix").between(first, last), F.lit(reference)).otherwise(F.col(field)))
