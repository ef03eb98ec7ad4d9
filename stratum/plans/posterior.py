"""Posterior statistics. lineitem stands for samples: l_suppkey the point, l_returnflag the field, l_linenumber the chain, l_quantity the value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratum.functions import special
from stratum.operators import counted, moments, nearest, order_stats
from stratum.operators.select import in_box
from stratum.plans.registry import query, rounded, table, tendencies_sql

KEYS = ["l_suppkey", "l_returnflag"]


def x():
    return F.col("l_quantity")


def samples(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""
WITH s AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS s1, sum(l_quantity^2) AS s2, sum(l_quantity^3) AS s3 FROM lineitem GROUP BY ALL),
m AS (SELECT *, s1 / n AS mean, sqrt(greatest(0, s2 / n - (s1 / n) ^ 2)) AS sd FROM s)
SELECT l_suppkey, l_returnflag, n, round(mean, 6) AS mean, round(sd, 6) AS sd,
  round(CASE WHEN sd <> 0 THEN (s3 / n - 3 * mean * sd ^ 2 - mean ^ 3) / sd ^ 3 ELSE 'nan'::DOUBLE END, 6) AS skewness FROM m
""")
def posterior_moments(spark, sf_dir):
    return rounded(moments.moments(samples(spark, sf_dir), KEYS, x()), KEYS)


@query("""
SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS s1, sum(l_quantity^2) AS s2, sum(l_quantity^3) AS s3, sum(l_quantity^4) AS s4 FROM lineitem GROUP BY ALL
""")
def power_sums(spark, sf_dir):
    return moments.power_sums(samples(spark, sf_dir), KEYS, x(), 4)


@query("""
WITH g AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_quantity * l_quantity) AS xx, avg(l_discount * l_discount) AS yy, avg(l_quantity * l_discount) AS xy FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(sqrt(xx - mx * mx), 6) AS sd_x, round(sqrt(yy - my * my), 6) AS sd_y,
  round((xy - mx * my) / (sqrt(xx - mx * mx) * sqrt(yy - my * my)), 6) AS pcc FROM g
""")
def posterior_correlation(spark, sf_dir):
    return rounded(moments.correlation(samples(spark, sf_dir), ["l_suppkey"], x(), F.col("l_discount")), ["l_suppkey"])


@query("""
WITH g AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_quantity * l_quantity) AS xx, avg(l_discount * l_discount) AS yy,
  coalesce(sum(CASE WHEN l_tax <= 0.04 AND l_linenumber <= 5 THEN l_quantity * l_discount END), 0) / count(*) AS xy FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(sqrt(xx - mx * mx), 6) AS sd_x, round(sqrt(yy - my * my), 6) AS sd_y,
  round((xy - mx * my) / (sqrt(xx - mx * mx) * sqrt(yy - my * my)), 6) AS pcc FROM g
""")
def correlation_in_domain(spark, sf_dir):
    inside = (F.col("l_tax") <= 0.04) & (F.col("l_linenumber") <= 5)
    return rounded(moments.correlation(samples(spark, sf_dir), ["l_suppkey"], x(), F.col("l_discount"), inside), ["l_suppkey"])


@query("""
WITH g AS (SELECT l_suppkey AS point, count(*) AS n, avg(l_quantity) AS a1, avg(l_quantity^2) AS a2, avg(l_quantity^3) AS a3, avg(l_discount) AS b1, avg(l_discount^2) AS b2, avg(l_discount^3) AS b3, avg(l_quantity * l_discount) AS ab FROM lineitem GROUP BY ALL),
s AS (SELECT *, sqrt(a2 - a1 * a1) AS sa, sqrt(b2 - b1 * b1) AS sb FROM g)
SELECT point, round(a1, 6) AS u1_a, round(sa, 6) AS u2_a, round((a3 - 3 * a1 * sa ^ 2 - a1 ^ 3) / sa ^ 3, 6) AS u3_a, round(b1, 6) AS u1_b, round(sb, 6) AS u2_b, round((b3 - 3 * b1 * sb ^ 2 - b1 ^ 3) / sb ^ 3, 6) AS u3_b, round((ab - a1 * b1) / (sa * sb), 6) AS pcc_a_b FROM s
""")
def wide_moments(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("l_suppkey").alias("point"), x().alias("a"), F.col("l_discount").alias("b"))
    return rounded(moments.all_moments(s, "point", ["a", "b"]), ["point"])


@query("""
SELECT l_suppkey, l_returnflag, round(avg(CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN l_quantity ELSE 25.0 END), 6) AS mean FROM lineitem GROUP BY ALL
""")
def squeezed_mean(spark, sf_dir):
    v = moments.squeezed(x(), F.col("l_discount").between(0.02, 0.08), 25.0)
    return rounded(samples(spark, sf_dir).groupBy(*KEYS).agg(F.avg(v).alias("mean")), KEYS)


@query("SELECT l_suppkey, l_returnflag, round(1 / avg(1 / l_quantity), 6) AS velocity FROM lineitem GROUP BY ALL")
def slowness_mean(spark, sf_dir):
    return rounded(moments.harmonic_mean(samples(spark, sf_dir), KEYS, x()), KEYS)


@query("""
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1)
SELECT event_type, extract(hour FROM ts)::BIGINT AS frame, round(1 / avg(1 / value), 6) AS velocity FROM last GROUP BY ALL
""")
def slowness_mean_by_frame(spark, sf_dir):
    from stratum.operators.select import trailing

    last = trailing(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 1).withColumn("frame", F.hour("ts").cast("long"))
    return rounded(moments.harmonic_mean(last, ["event_type", "frame"], F.col("value")), [])


@query("SELECT l_suppkey, l_returnflag, round(avg((l_quantity > 10 AND l_quantity < 30)::INT), 6) AS probability FROM lineitem GROUP BY ALL")
def probability_interval(spark, sf_dir):
    return rounded(moments.probability(samples(spark, sf_dir), KEYS, (x() > 10) & (x() < 30)), KEYS)


@query("SELECT l_suppkey, l_returnflag, round(avg((l_quantity < 20)::INT), 6) AS probability FROM lineitem GROUP BY ALL")
def probability_tail(spark, sf_dir):
    return rounded(moments.probability(samples(spark, sf_dir), KEYS, x() < 20), KEYS)


def sorted_(spark, sf_dir):
    return order_stats.sorted_samples(samples(spark, sf_dir), KEYS, x())


@query("""
SELECT l_suppkey, l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.05), 6) AS mi_lo, round(quantile_cont(l_quantity, 0.95), 6) AS mi_hi,
  round(quantile_cont(l_quantity, 0.9), 6) AS lhi_a, round(quantile_cont(l_quantity, 0.1), 6) AS lhi_b FROM lineitem GROUP BY ALL
""")
def posterior_quantiles(spark, sf_dir):
    s = F.col("s")
    (a, b), (c, d) = order_stats.median_interval(s, 0.9), order_stats.low_high_interval(s, 0.9)
    return rounded(sorted_(spark, sf_dir).select(*KEYS, order_stats.quantile(s, 0.5).alias("median"), a.alias("mi_lo"), b.alias("mi_hi"), c.alias("lhi_a"), d.alias("lhi_b")), KEYS)


HDI = """
WITH r AS (SELECT l_suppkey, l_returnflag, l_quantity AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity)),
k AS (SELECT *, greatest(1, floor(0.9::DOUBLE * n))::BIGINT AS m FROM r),
p AS (SELECT a.l_suppkey, a.l_returnflag, a.i, a.x AS lo, b.x AS hi FROM k a JOIN k b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND b.i = a.i + a.m - 1),
h AS (SELECT l_suppkey, l_returnflag, lo, hi FROM p QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY hi - lo, i) = 1)
"""


@query(HDI + "SELECT l_suppkey, l_returnflag, lo AS hdi_lo, hi AS hdi_hi FROM h")
def posterior_hdi(spark, sf_dir):
    lo, hi = order_stats.densest_interval(F.col("s"), 0.9)
    return sorted_(spark, sf_dir).select(*KEYS, lo.alias("hdi_lo"), hi.alias("hdi_hi"))


MODE = """
WITH q AS (SELECT l_suppkey, l_returnflag, round(2 * (quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) / cbrt(count(*)), 9) AS w, median(l_quantity) AS med FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, l_returnflag, w, med, CASE WHEN w > 0 THEN round_even(l_quantity / w, 0) END AS bin, count(*) AS c FROM lineitem JOIN q USING (l_suppkey, l_returnflag) GROUP BY ALL),
m AS (SELECT l_suppkey, l_returnflag, coalesce(bin * w, med) AS mode FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY c DESC, bin) = 1)
"""


@query(MODE + "SELECT l_suppkey, l_returnflag, round(mode, 6) AS mode FROM m")
def posterior_binned_mode(spark, sf_dir):
    return rounded(order_stats.binned_mode(sorted_(spark, sf_dir), KEYS), KEYS)


HELLINGER = """
n AS (SELECT l_suppkey, l_returnflag, count(*) AS n, round_even(sqrt(count(*)), 0) AS k FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, l_returnflag, n, k, greatest(ceil(l_quantity / (50 / k)) - 1, 0) AS bin, count(*) AS c FROM lineitem JOIN n USING (l_suppkey, l_returnflag) GROUP BY ALL),
hv AS (SELECT l_suppkey, l_returnflag, sqrt(least(1, greatest(0, 1 - sqrt(1 / k) * sum(sqrt(c / n))))) AS hval FROM c GROUP BY l_suppkey, l_returnflag, k)
"""


@query("WITH " + HELLINGER + "SELECT l_suppkey, l_returnflag, round(hval, 6) AS hval FROM hv")
def hellinger_uniform(spark, sf_dir):
    return rounded(sorted_(spark, sf_dir).select(*KEYS, order_stats.hellinger_uniform(F.col("s"), 0.0, 50.0).alias("hval")), KEYS)


@query("""
WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_quantity) AS low, 5.0::DOUBLE AS w FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, l_returnflag, n, low, w, greatest(ceil((l_quantity - low) / w) - 1, 0) AS bin, count(*) AS c FROM lineitem JOIN m USING (l_suppkey, l_returnflag) GROUP BY ALL)
SELECT l_suppkey, l_returnflag, round(sqrt(least(1, greatest(0, 1 - sum(sqrt(c / n * greatest(0, least(1, greatest(0, (low + (bin + 1) * w) / 50)) - least(1, greatest(0, (low + bin * w) / 50)))))))), 6) AS hval FROM c GROUP BY ALL
""")
def hellinger_prior_function(spark, sf_dir):
    cdf = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 50.0))
    return rounded(sorted_(spark, sf_dir).select(*KEYS, order_stats.hellinger(F.col("s"), cdf, F.lit(5.0)).alias("hval")), KEYS)


#: The error function by its series, whose terms x^(2n+1) / gamma(n + 3/2) are all positive.
ERF = "(CASE WHEN abs({x}) > 5.9 THEN sign({x}) ELSE sign({x}) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 110), lambda k: abs({x}) ^ (2 * k + 1) / gamma(k + 1.5))) END)"


@query(f"""
WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_quantity) AS low, round(2 * (quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) / cbrt(count(*)), 9) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT l_suppkey, l_returnflag, n, low, w, greatest(ceil((l_quantity - low) / w) - 1, 0) AS bin, count(*) AS c FROM lineitem JOIN m USING (l_suppkey, l_returnflag) WHERE w > 0 GROUP BY ALL),
e AS (SELECT *, (low + (bin + 1) * w - 25) / (15 * sqrt(2.0)) AS b, (low + bin * w - 25) / (15 * sqrt(2.0)) AS a FROM c),
h AS (SELECT l_suppkey, l_returnflag, sqrt(least(1, greatest(0, 1 - sum(sqrt(c / n * greatest(0, ({ERF.format(x="b")} - {ERF.format(x="a")}) / 2)))))) AS hval FROM e GROUP BY ALL)
SELECT l_suppkey, l_returnflag, round(hval, 6) AS hval FROM m LEFT JOIN h USING (l_suppkey, l_returnflag)
""")
def hellinger_prior_normal(spark, sf_dir):
    """Distance of each point's samples from a normal prior of mean 25 and deviation 15."""
    return rounded(sorted_(spark, sf_dir).select(*KEYS, order_stats.hellinger(F.col("s"), lambda x: special.normal_cdf(x, 25.0, 15.0)).alias("hval")), KEYS)


@query("""
WITH r AS (SELECT l_suppkey, l_returnflag, l_quantity / 50 AS u, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem)
SELECT l_suppkey, l_returnflag, round(max(greatest(abs((i - 1) / n - u), abs(i / n - u))), 6) AS ks FROM r GROUP BY ALL
""")
def ks_uniform(spark, sf_dir):
    return rounded(sorted_(spark, sf_dir).select(*KEYS, order_stats.kolmogorov_uniform(F.col("s"), 0.0, 50.0).alias("ks")), KEYS)


STATS = ["mean", "median", "q1", "q2", "mi_lo", "mi_hi", "lhi_a", "lhi_b", "hdi_lo", "hdi_hi", "hval", "mode"]


@query(
    HDI.rstrip() + ", " + MODE.strip().removeprefix("WITH ") + ", " + HELLINGER.strip() + """,
g AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q2,
  quantile_cont(l_quantity, 0.05) AS mi_lo, quantile_cont(l_quantity, 0.95) AS mi_hi, quantile_cont(l_quantity, 0.9) AS lhi_a, quantile_cont(l_quantity, 0.1) AS lhi_b FROM lineitem GROUP BY ALL),
t AS (SELECT g.*, lo AS hdi_lo, hi AS hdi_hi, hval, mode FROM g JOIN h USING (l_suppkey, l_returnflag) JOIN m USING (l_suppkey, l_returnflag) JOIN hv USING (l_suppkey, l_returnflag))
SELECT l_suppkey, """ + ", ".join(f"max(CASE WHEN l_returnflag = '{f}' THEN round({s}, 6) END) AS {s}_{f}" for f in "ANR" for s in STATS) + " FROM t GROUP BY ALL"
)
def posterior_tendencies(spark, sf_dir):
    long = order_stats.tendencies(samples(spark, sf_dir), KEYS, x(), 0.0, 50.0)
    return order_stats.pivoted(rounded(long, KEYS), "l_suppkey", "l_returnflag", ["A", "N", "R"], STATS)


@query("WITH all_ AS (SELECT 1 AS grp, l_extendedprice AS x FROM lineitem)," + tendencies_sql("all_", "grp", "0", "120000") + " SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in STATS) + " FROM t_all")
def pooled_tendencies(spark, sf_dir):
    """The samples of all points as one group, which no task holds."""
    return rounded(counted.tendencies(samples(spark, sf_dir), [], F.col("l_extendedprice"), 0.0, 120_000.0), [])


@query("WITH all_ AS (SELECT l_returnflag, l_extendedprice AS x FROM lineitem), r AS (SELECT l_returnflag, x / 120000 AS u, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM all_), s AS (SELECT l_returnflag, round(max(greatest(abs((i - 1) / n - u), abs(i / n - u))), 6) AS ks FROM r GROUP BY ALL)," + tendencies_sql("all_", "l_returnflag", "0", "120000") + " SELECT l_returnflag, " + ", ".join(f"round({c}, 6) AS {c}" for c in STATS) + ", ks FROM t_all JOIN s USING (l_returnflag)")
def field_tendencies(spark, sf_dir):
    """Each field over all points: groups of a third of all samples, by counts."""
    s = samples(spark, sf_dir)
    return rounded(counted.tendencies(s, ["l_returnflag"], F.col("l_extendedprice"), 0.0, 120_000.0, kolmogorov=True), [])


@query("""
WITH r AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS w, sum(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS run, sum(l_extendedprice) OVER (PARTITION BY l_suppkey) AS total FROM lineitem),
a AS (SELECT l_suppkey, min(x) AS weighted_median FROM r WHERE run >= total / 2 GROUP BY ALL), b AS (SELECT l_suppkey, sum(l_quantity * l_extendedprice) / sum(l_extendedprice) AS weighted_mean FROM lineitem GROUP BY ALL)
SELECT l_suppkey, weighted_median, round(weighted_mean, 6) AS weighted_mean FROM a JOIN b USING (l_suppkey)
""")
def weighted_tendencies(spark, sf_dir):
    s, w = samples(spark, sf_dir), F.col("l_extendedprice")
    mean = rounded(order_stats.weighted_mean(s, ["l_suppkey"], x(), w), ["l_suppkey"])
    return order_stats.weighted_median(s, ["l_suppkey"], x(), w).join(mean, "l_suppkey")


COORDS = [f"c{i}" for i in range(1, 5)]
CELLS = """
WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS c1, embedding[2]::DOUBLE AS c2, embedding[3]::DOUBLE AS c3, embedding[4]::DOUBLE AS c4 FROM embeddings),
n AS (SELECT vec_id % 3 AS chain, vec_id AS nucleus_ix, label::DOUBLE AS v, c1, c2, c3, c4 FROM v),
d AS (SELECT v.vec_id, n.chain, n.nucleus_ix, n.v, (v.c1 - n.c1) * (v.c1 - n.c1) + (v.c2 - n.c2) * (v.c2 - n.c2) + (v.c3 - n.c3) * (v.c3 - n.c3) + (v.c4 - n.c4) * (v.c4 - n.c4) AS d2 FROM v, n),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id, chain ORDER BY d2, nucleus_ix) = 1)
"""


def vectors(spark, sf_dir):
    """Every vector is a nucleus of one of three models, and every vector is a point."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COORDS)))
    n = v.select((F.col("vec_id") % 3).alias("chain"), F.col("vec_id").alias("nucleus_ix"), F.col("label").cast("double").alias("v"), *COORDS)
    return v.select("vec_id", *COORDS), n


@query(CELLS + "SELECT vec_id, chain, nucleus_ix, v, round(d2, 6) AS d2 FROM b")
def nearest_cell_all_nuclei(spark, sf_dir):
    return rounded(nearest.nearest_cells(*vectors(spark, sf_dir), ["chain"], COORDS, point="vec_id"), ["v"])


@query(CELLS + ", s AS (SELECT vec_id, count(*) AS n, sum(v) AS s1, sum(v^2) AS s2 FROM (SELECT vec_id, CASE WHEN d2 <= 0.1 THEN v ELSE 4.5 END AS v FROM b) GROUP BY ALL) SELECT vec_id, n, round(s1 / n, 6) AS mean, round(sqrt(greatest(0, s2 / n - (s1 / n) ^ 2)), 6) AS sd FROM s")
def nearest_cell_moments_all(spark, sf_dir):
    """Values further than the root of 0.1 from their nucleus are replaced by 4.5."""
    sums = nearest.nearest_cell_sums(*vectors(spark, sf_dir), ["chain"], COORDS, [], lambda v, d2: np.where(d2 <= 0.1, v, 4.5), point="vec_id")
    return rounded(moments.finished(sums, ["vec_id"]).drop("skewness"), [])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE radians((l_partkey % 180) - 90) BETWEEN radians(-30) AND radians(30) AND radians((l_suppkey * 37) % 360 - 180) BETWEEN radians(-90) AND radians(90) AND l_quantity BETWEEN 10 AND 40
""")
def in_field_box(spark, sf_dir):
    import math

    lat, lon = F.radians(F.pmod("l_partkey", F.lit(180)) - 90), F.radians(F.pmod(F.col("l_suppkey") * 37, F.lit(360)) - 180)
    limits = {"lat": (math.radians(-30), math.radians(30)), "lon": (math.radians(-90), math.radians(90)), "r": (10.0, 40.0)}
    return samples(spark, sf_dir).where(in_box(lat, lon, x(), limits)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
