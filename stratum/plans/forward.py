"""One query for each forward function. lineitem stands for ray nodes: l_orderkey the ray, nodes numbered along it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.operators import forward
from stratum.plans.registry import query, r6, table

#: Columns of a node: SQL that both engines read alike.
NODE = {
    "vp1d": "5 + l_quantity / 25", "vs1d": "(5 + l_quantity / 25) / 1.75e0", "azimuth": "radians(l_partkey % 360)", "elevation": "radians(l_suppkey % 90 - 45)", "polarization": "radians(l_orderkey % 180)",
    "dlnVp": "l_discount - 0.05e0", "dlnVs": "l_tax - 0.04e0", "Vp": "5 + l_quantity / 20", "Vs": "3 + l_quantity / 40", "Vp2Vs": "1.6e0 + l_tax * 2", "r": "1 + l_discount", "dlnVp2Vs": "l_tax",
    "fp": "l_discount / 2", "fsh": "l_tax / 2", "psi": "radians(l_partkey % 180)", "gamma": "radians(l_suppkey % 57 - 28)", "v3": "l_discount * 5", "AniMag": "l_discount / 2", "SymAzm": "radians(l_partkey % 170)", "SymRad": "l_tax * 5", "SymElv": "radians(l_suppkey % 80 - 40)",
}
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

#: Nodal slowness in SQL. c(az, el): cosine to an axis; tw(az, el): twist; double angles and Thomsen forms below.
COS = "(cos(azimuth - {a}) * cos(elevation) * cos({e}) + sin(elevation) * sin({e}))"
HEX = "(1 + fp * (2 * {c} ^ 2 - 1))"
CG = COS.format(a="psi", e="gamma")
THOMSEN_P = "(sqrt(1 + 16 * ({k}) / 15 + 4 * ({k}) / 15) / (vp1d * (1 + dlnVp) * sqrt(1 + 2 * ({k}) * (1 - {c} ^ 2) * {c} ^ 2 + 2 * ({k}) * (1 - {c} ^ 2) ^ 2)))"
BETA = "(atan(-sin(azimuth - psi) * cos(gamma) / (cos(azimuth - psi) * sin(elevation) * cos(gamma) - cos(elevation) * sin(gamma))) - polarization)"
D = f"(2 * {CG} ^ 2 - 1)"
TWIST = "(atan2(-sin({a} - azimuth) * cos({e}), cos({a} - azimuth) * sin(elevation) * cos({e}) - cos(elevation) * sin({e})) - polarization)"
# elliptical: epsilon = delta, so the first wave is isotropic in angle
S1 = "(sqrt(1 + 2 * ({g}) / 3) / ({vs}))"
S2 = "(sqrt(1 + 2 * ({g}) / 3) / (({vs}) * sqrt(1 + 2 * ({g}) * (1 - {c} ^ 2))))"


def arrival(g, vs, a, e):
    c, t = COS.format(a=a, e=e), TWIST.format(a=a, e=e)
    one, two = S1.format(g=g, vs=vs), S2.format(g=g, vs=vs, c=c)
    return f"({two} + ({one} - {two}) * cos({t}) ^ 2)"


def intensity(g, vs, a, e):
    c, t = COS.format(a=a, e=e), TWIST.format(a=a, e=e)
    return f"(0.5 * ({S2.format(g=g, vs=vs, c=c)} - {S1.format(g=g, vs=vs)}) * sin(2 * {t}))"


VS, JOINT = "vs1d * (1 + dlnVs)", "vp1d * (1 + dlnVp) / ((vp1d / vs1d) * (1 + dlnVp2Vs))"
SLOWNESS = {
    "tt_P_Vp": "1 / Vp",
    "tt_P_dlnVp": "1 / ((1 + dlnVp) * vp1d)",
    "tt_P_dlnVp_Vp": "1 / ((1 + dlnVp) * Vp)",
    "tt_P_dlnVs_Vp2Vs": "1 / ((1 + dlnVs) * vs1d * Vp2Vs)",
    "tt_P_dlnVp_fp": "1 / ((1 + fp * (2 * sin(elevation) ^ 2 - 1)) * (1 + dlnVp) * vp1d)",
    "tt_P_Vp_fp_psi": "1 / ((1 + fp * (2 * cos(azimuth - psi) ^ 2 - 1)) * Vp)",
    "tt_P_dlnVp_fp_psi": "1 / ((1 + fp * (2 * cos(azimuth - psi) ^ 2 - 1)) * (1 + dlnVp) * vp1d)",
    "tt_P_dlnVp_fp_psi_gamma": f"1 / ({HEX.format(c=CG)} * (1 + dlnVp) * vp1d)",
    "tt_P_dlnVp_fp_psi_v3": f"1 / ({HEX.format(c=COS.format(a='psi', e='asin(v3)'))} * (1 + dlnVp) * vp1d)",
    "tt_P_dlnVp_Vp_fp_psi_gamma": f"1 / ({HEX.format(c=CG)} * (1 + dlnVp) * Vp)",
    "tt_P_dlnVs_Vp2Vs_fp_psi_gamma": f"1 / ({HEX.format(c=CG)} * (1 + dlnVs) * vs1d * Vp2Vs)",
    "tt_P_dlnVp_fp_psi_gamma_thomsen": THOMSEN_P.format(k="-fp", c=COS.format(a="psi", e="asin(gamma)")),
    "tt_P_dlnVp_AniMag_SymAzm_SymRad_Thomsen": THOMSEN_P.format(k="AniMag", c=COS.format(a="SymAzm", e="asin(SymRad)")),
    "tt_P_dlnVp_AniMag_SymAzm_SymElv_Thomsen": THOMSEN_P.format(k="AniMag", c=COS.format(a="SymAzm", e="SymElv")),
    "tt_S_Vs": "1 / Vs",
    "tt_S_dlnVs": "1 / ((1 + dlnVs) * vs1d)",
    "tt_S_Vp_Vp2Vs": "Vp2Vs / Vp",
    "tt_S_dlnVp_Vp2Vs": "Vp2Vs / ((1 + dlnVp) * vp1d)",
    "tt_S_dlnVp_r": "1 / ((1 + dlnVp * r) * vs1d)",
    "tt_S_dlnVs_Vp2Vs_fp_psi_gamma": f"(sin({BETA}) ^ 2 / (1 + 0.63e0 * fp * {D}) + cos({BETA}) ^ 2 * (1 - 0.63e0 * fp / 4.75e0) / ((1 + 0.63e0 * fp) * (1 - 0.63e0 * fp / 4.75e0 * (2 * {D} ^ 2 - 1)))) * Vp2Vs / (vp1d * (1 + dlnVs))",
    "tt_S_dlnVs_fsh_psi_gamma": f"(sin({BETA}) ^ 2 / (1 + fsh * {D}) + cos({BETA}) ^ 2 / (1 + fsh)) / ({VS})",
    "si_S_dlnVs_fsh_psi_gamma": f"0.5 * sin(2 * {BETA}) * (1 / (1 + fsh * {D}) - 1 / (1 + fsh)) / ({VS})",
    "tt_S_dlnVs_fsh_psi_gamma_thomsen": arrival("-fsh", VS, "psi", "gamma"),
    "tt_S_dlnVs_AniMag_SymAzm_SymRad_Thomsen": arrival("AniMag", VS, "SymAzm", "asin(SymRad)"),
    "tt_S_dlnVs_AniMag_SymAzm_SymElv_Thomsen": arrival("AniMag", VS, "SymAzm", "SymElv"),
    "tt_S_dlnVp_dlnVp2Vs_AniMag_SymAzm_SymRad_Thomsen": arrival("AniMag", JOINT, "SymAzm", "asin(SymRad)"),
    "si_S_AniMag_SymAzm_SymRad_Thomsen": intensity("AniMag", "vs1d", "SymAzm", "asin(SymRad)"),
    "si_S_AniMag_SymAzm_SymElv_Thomsen": intensity("AniMag", "vs1d", "SymAzm", "SymElv"),
    "si_S_dlnVp_dlnVp2Vs_AniMag_SymAzm_SymRad_Thomsen": intensity("AniMag", JOINT, "SymAzm", "asin(SymRad)"),
}


def nodes(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    cols = [F.expr(sql.replace("e0", "D")).alias(name) for name, sql in NODE.items()]
    out = table(spark, sf_dir, "lineitem").withColumn("_n", F.row_number().over(w)).select(F.col("l_orderkey").alias("ray_id"), F.col("_n").alias("node_ix"), F.col("l_discount").alias("_d"), *cols)
    last = F.lead("node_ix").over(Window.partitionBy("ray_id").orderBy("node_ix")).isNull()
    return out.withColumn("seg_len", F.when(~last, 100 * (1 + F.col("_d")))).drop("_d")


NODES_SQL = "WITH n AS (SELECT l_orderkey AS ray_id, row_number() OVER w AS node_ix, CASE WHEN lead(l_orderkey) OVER w IS NOT NULL THEN 100 * (1 + l_discount) END AS seg_len, " + ", ".join(f"{sql} AS {name}" for name, sql in NODE.items()) + f" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}))"


def references(spark, sf_dir):
    """A reference time of each ray: 1 s for every million of its id."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ray_id"), (F.col("l_orderkey") / 1e6).alias("ref_t")).distinct()


def add(name: str) -> None:
    late = "" if name.startswith("si_") else " - ray_id / 1e6"
    sql = NODES_SQL + f", u AS (SELECT ray_id, node_ix, seg_len, {SLOWNESS[name]} AS u FROM n), s AS (SELECT ray_id, seg_len * (u + lead(u) OVER (PARTITION BY ray_id ORDER BY node_ix)) / 2 AS dt FROM u) SELECT ray_id, round(coalesce(sum(dt), 0){late}, 6) AS predicted FROM s GROUP BY ray_id"

    def run(spark, sf_dir):
        out = forward.predicted(nodes(spark, sf_dir), name, references(spark, sf_dir))
        return out.select("ray_id", r6(F.col("predicted")).alias("predicted"))

    query(sql, f"path_integral_{name}")(run)


for _name in SLOWNESS:
    add(_name)


@query(NODES_SQL + """, f AS (SELECT ray_id, min(CASE WHEN vp1d <= 6 THEN node_ix END) AS first FROM n GROUP BY ray_id),
o AS (SELECT n.ray_id, node_ix, seg_len, 1 / ((1 + CASE WHEN node_ix BETWEEN 1 AND coalesce(first, 0) THEN 0.01 ELSE dlnVp END) * vp1d) AS u FROM n JOIN f USING (ray_id)),
s AS (SELECT ray_id, seg_len * (u + lead(u) OVER (PARTITION BY ray_id ORDER BY node_ix)) / 2 AS dt FROM o)
SELECT ray_id, round(coalesce(sum(dt), 0), 6) AS predicted FROM s GROUP BY ray_id""")
def path_integral_outside_domain(spark, sf_dir):
    from stratum.operators.index import outside_range

    n = nodes(spark, sf_dir)
    out = outside_range(n, F.col("vp1d") <= 6).withColumnsRenamed({"first": "_first", "last": "_last"})
    n = forward.with_outside(n.join(out, "ray_id"), "dlnVp", F.col("_first"), F.col("_last"), 0.01)
    return forward.predicted(n, "tt_P_dlnVp").select("ray_id", r6(F.col("predicted")).alias("predicted"))
