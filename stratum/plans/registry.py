"""Where queries register with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name; sql gives the same rows in DuckDB."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, but for the columns to keep; -0 becomes 0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def tendencies_sql(source: str, keys: str, low: str, high: str, level: float = 0.9) -> str:
    """Tables t_r .. t_all of the tendencies of source(keys, x, lo_, hi_): t_all has the keys and every statistic. low and high: the prior's limits, by the source's columns."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    tail = (1 - level) / 2
    q = lambda f, name: f"quantile_cont(x, {f!r}) AS {name}"
    return f"""
t_r AS (SELECT {keys}, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY x)),
t_k AS (SELECT *, greatest(1, floor({level}::DOUBLE * n))::BIGINT AS m FROM t_r),
t_p AS (SELECT a.*, b.x AS hi FROM t_k a JOIN t_k b ON {on} AND b.i = a.i + a.m - 1),
t_h AS (SELECT {keys}, x AS hdi_lo, hi AS hdi_hi FROM t_p QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY hi - x, i) = 1),
t_w AS (SELECT {keys}, round(2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / cbrt(count(*)), 9) AS w, median(x) AS med FROM {source} GROUP BY ALL),
t_b AS (SELECT {keys}, w, med, CASE WHEN w > 0 THEN round_even(x / w, 0) END AS bin, count(*) AS c FROM {source} JOIN t_w USING ({keys}) GROUP BY ALL),
t_m AS (SELECT {keys}, coalesce(bin * w, med) AS mode FROM t_b QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, bin) = 1),
t_n AS (SELECT {keys}, count(*) AS n, round_even(sqrt(count(*)), 0) AS k FROM {source} GROUP BY ALL),
t_c AS (SELECT {keys}, n, k, greatest(ceil((x - {low}) / (({high} - {low}) / k)) - 1, 0) AS bin, count(*) AS c FROM {source} JOIN t_n USING ({keys}) GROUP BY ALL),
t_v AS (SELECT {keys}, sqrt(least(1, greatest(0, 1 - sqrt(1 / k) * sum(sqrt(c / n))))) AS hval FROM t_c GROUP BY {keys}, k),
t_q AS (SELECT {keys}, avg(x) AS mean, {q(0.5, "median")}, {q(0.25, "q1")}, {q(0.75, "q2")}, {q(tail, "mi_lo")}, {q(1 - tail, "mi_hi")}, {q(level, "lhi_a")}, {q(1 - level, "lhi_b")} FROM {source} GROUP BY ALL),
t_all AS (SELECT * FROM t_q JOIN t_h USING ({keys}) JOIN t_m USING ({keys}) JOIN t_v USING ({keys}))"""
